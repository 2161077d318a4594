"""Archives with a single member, read as lines by tasks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import batched
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

LARGEST = 2 * 1024**3
_LINES = pa.schema([("path", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("value", pa.string())])


def unsafe(name: str) -> bool:
    """Whether a member's name could lead outside its folder."""
    parts = PurePosixPath(name).parts
    return not parts or name.startswith("/") or ".." in parts or "\\" in name or ":" in name


def member_lines(spark: SparkSession, path: str | list[str], name: str, largest: int = LARGEST) -> DataFrame:
    """(path, member, line, value): the lines of the file `name` in each archive, from line 0.

    An archive must hold exactly that file, as `name` or as its last part, of `largest` bytes at most; else the read raises. An archive
    is read by one task, its member in batches of lines.
    """
    if unsafe(name):
        raise ValueError("unsafe name")
    wanted = {name, PurePosixPath(name).name}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    files = [i for i in archive.infolist() if not i.is_dir()]
                    if len(files) != 1 or unsafe(files[0].filename) or files[0].filename not in wanted:
                        raise ValueError("the archive does not hold just the wanted file")
                    if files[0].file_size > largest:
                        raise ValueError("the member is too large")
                    with io.TextIOWrapper(archive.open(files[0]), "utf-8", newline="\n") as text:
                        for part in batched(enumerate(text), 10_000):
                            lines = [v.removesuffix("\n").removesuffix("\r") for _, v in part]
                            n = len(lines)
                            yield pa.RecordBatch.from_pydict({"path": [where] * n, "member": [files[0].filename] * n, "line": [i for i, _ in part], "value": lines}, schema=_LINES)

    content = spark.read.format("binaryFile").load(path).select("path", "content")
    return content.mapInArrow(read, "path string, member string, line long, value string")
