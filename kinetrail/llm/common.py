"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space (space, tab, LF, VT, FF, CR).
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_local_dir: list[str] = []
_own: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves, but only in local mode: on a
    cluster a machine's own folder would lose what executors write.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="kinetrail-"))
        atexit.register(lambda: __import__("shutil").rmtree(_local_dir[0], ignore_errors=True))
    return f"file://{_local_dir[0]}"


def _own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/kinetrail-{spark.sparkContext.applicationId}"
    if path not in _own:
        _own.add(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return path


def saved(df: DataFrame, label: str, **options: str | int) -> DataFrame:
    """df written as Parquet to the shared folder (with options of the writer) and read again.

    This cuts the lineage, survives lost executors and, since Spark knows the
    size of the files, lets it broadcast the table only if it is small.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kt_path = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table that saved() made."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kt_path)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that saved() made and nothing needs any longer."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._kt_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch, unless the session asks for fewer.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes that one Arrow batch holds, so that long texts don't fill a worker.

    This is a setting of the session: it also holds for the caller's other Arrow batches, which it can
    only make smaller. A single longer text is a batch of its own.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def without(columns: list[str], made: tuple[str, ...]) -> list[str]:
    """The columns but for those that an operator makes; names differ by more than case, as in Spark."""
    names = {m.lower() for m in made}
    return [c for c in columns if c.lower() not in names]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def word_count(text: Column) -> Column:
    """Number of white-space separated words as long; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
