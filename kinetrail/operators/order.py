"""The order of requests as a column: partitions have none, so it is stored, compared and sorted by at the sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _address(path: Column) -> Column:
    """A file's address with one slash behind the scheme, however many it was given."""
    return F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*):/*", "$1:/")


def _place(rows: DataFrame, files: Sequence[str] | None) -> Column:
    """A file's place among `files`, as named to the reader; without them, files go by name."""
    if files is None:
        return F.lit(0)
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in files]
    named = [F.lit(p.getFileSystem(conf).makeQualified(p).toUri().toString()) for p in paths]
    return F.array_position(F.transform(F.array(*named), _address), F.col("_file"))


def written_order(rows: DataFrame, files: Sequence[str] | None = None) -> DataFrame:
    """Adds request_order, each row's place as written, from 0: files in the order of `files` (default: by name), rows as they stand in them.

    `rows` must come straight from a reader of files. Places are counts of earlier files and blocks plus the place inside. Parquet
    files know a row's index; of other formats, the rows of each block are numbered in the order its task reads them. Offsets take a row
    per file and block. A file that `files` doesn't name raises when it is read.
    """
    try:
        seen = rows.select("*", _address(F.col("_metadata.file_path")).alias("_file"), F.lit(0).cast("long").alias("_block"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        place = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at")) - 1
        read = rows.select("*", _address(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
        seen = read.withColumn("_row", place).drop("_at")
    blocks = seen.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    inside = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_n")
    at = _place(rows, files)
    whole = blocks.groupBy("_file").agg(F.sum("_n").alias("_n")).withColumn("_at", at)
    if files is not None:
        unknown = F.raise_error(F.concat(F.lit("not among the files: "), F.col("_file")))
        whole = whole.withColumn("_at", F.when(F.col("_at") > 0, F.col("_at")).otherwise(unknown))
    first = whole.select("_file", (F.sum("_n").over(Window.orderBy("_at", "_file")) - F.col("_n")).alias("_first"))
    offsets = blocks.select("_file", "_block", inside.alias("_before")).join(first, "_file")
    order = (F.col("_first") + F.col("_before") + F.col("_row")).cast("long").alias("request_order")
    return seen.join(offsets, ["_file", "_block"]).select(*rows.columns, order)


def key_order(rows: DataFrame, group: Sequence[str], inside: Sequence[str], name: str = "request_order") -> DataFrame:
    """Adds each row's place in the order of the group columns, then those inside, from 0.

    Places are counts of earlier groups plus the place in the group: groups meet in one window by their first column, a row each.
    """
    top, *rest = group
    groups = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(top).orderBy(*rest)) - F.col("_n") if rest else F.lit(0)
    tops = groups.groupBy(top).agg(F.sum("_n").alias("_n"))
    first = tops.select(top, (F.sum("_n").over(Window.orderBy(top)) - F.col("_n")).alias("_first"))
    offsets = groups.select(*group, before.alias("_before")).join(first, top)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*inside)) - 1
    numbered = rows.withColumn("_row", place).join(offsets, list(group))
    return numbered.select(*rows.columns, (F.col("_first") + F.col("_before") + F.col("_row")).cast("long").alias(name))


def in_request_order(rows: DataFrame) -> DataFrame:
    """For the sink alone: a range sort."""
    return rows.orderBy("request_order")


def order_mismatches(predictions: DataFrame, requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Places whose prediction is absent, additional or has other keys than the request: (request_order, wanted, given)."""
    key = F.struct(*keys)
    wanted = requests.select("request_order", key.alias("wanted"))
    given = predictions.select("request_order", key.alias("given"))
    return wanted.join(given, "request_order", "full_outer").where(~F.col("wanted").eqNullSafe(F.col("given")))
