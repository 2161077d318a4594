"""Files of a run: fingerprints, manifests, write-once outputs, stored stages, an event log."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sha256_file(path: Path) -> str:
    with Path(path).open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def dumps(value: object) -> str:
    return json.dumps(value, sort_keys=True, allow_nan=False, indent=1) + "\n"


def write_once(path: Path, text: str) -> bool:
    """Put a new file in place whole; accept equal content, reject another, and links. True if written."""
    path = Path(path)
    if path.is_symlink():
        raise ValueError(f"{path} is a link")
    path.parent.mkdir(parents=True, exist_ok=True)
    draft = path.with_name(f".{uuid.uuid4().hex}")
    draft.write_text(text, encoding="utf-8", newline="\n")
    try:
        os.link(draft, path)  # fails where the name is taken, so no writer replaces another's file
    except FileExistsError:
        if path.read_text(encoding="utf-8") != text:
            raise ValueError(f"{path} exists with other content") from None
        return False
    finally:
        draft.unlink()
    return True


def safe_member(root: Path, name: str) -> Path:
    """A relative path below root, without `..` and without links on its way."""
    part = Path(name)
    if part.is_absolute() or ".." in part.parts or not part.parts:
        raise ValueError(f"unsafe path {name!r}")
    at = Path(root)
    for p in part.parts:
        at = at / p
        if at.is_symlink():
            raise ValueError(f"{at} is a link")
    return at


def manifest(spark: SparkSession, path: str, leave_out: Sequence[str] = ("manifest.json",)) -> DataFrame:
    """(file, bytes, sha256) of every file below a path, hashed on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(~name.isin(*leave_out)).select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def fingerprint(root: Path, inputs: Sequence[str], parameters: dict) -> str:
    """Digest of input files and parameters."""
    parts = {name: sha256_file(safe_member(root, name)) for name in sorted(inputs)}
    return hashlib.sha256(dumps({"inputs": parts, "parameters": parameters}).encode()).hexdigest()


def log_event(path: Path, event: str, error: BaseException | None = None, **fields: object) -> None:
    """Append one JSON line. Of an error only the type is kept: its message may hold addresses or credentials."""
    known = {"event": event, "time": datetime.now(UTC).isoformat(), **fields}
    if error is not None:
        known["error"] = type(error).__name__
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("a", encoding="utf-8") as f:
        f.write(json.dumps(known, sort_keys=True, allow_nan=False) + "\n")


def stored(spark: SparkSession, root: str, name: str, signature: str, build: Callable[[], DataFrame], log: Path | None = None) -> DataFrame:
    """A stage's table, built unless a committed one of this signature is there with the files it was committed with.

    The path holds the signature, Spark's committer leaves its marker last, and a listing of the files' digests lies
    beside: a table without them, or with other files, is built anew. Works on any file system that Spark reads.
    """
    path = f"{root.rstrip('/')}/{name}-{signature}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.files/_SUCCESS")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(place):
        now, then = manifest(spark, path, ()), spark.read.parquet(f"{path}.files")
        if now.exceptAll(then).isEmpty() and then.exceptAll(now).isEmpty():
            if log:
                log_event(log, "reused", stage=name)
            return spark.read.parquet(path)
    try:
        build().write.mode("overwrite").parquet(path)
        manifest(spark, path, ()).write.mode("overwrite").parquet(f"{path}.files")
    except Exception as error:
        if log:
            log_event(log, "failed", error, stage=name)
        raise
    if log:
        log_event(log, "built", stage=name)
    return spark.read.parquet(path)
