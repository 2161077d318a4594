"""Additive statistics of arriving files, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluate import rmse, squared


def accumulate(spark: SparkSession, folder: str, schema: T.StructType, out: str, checkpoint: str) -> StreamingQuery:
    """Start a query over error files (model, keys, dx, dy) that appends (model, game, n, sse) per batch.

    Sums add up, so a replayed batch overwrites its own partition and totals stay exact.
    """

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("model", "game_id").agg(F.count("*").alias("n"), F.sum(squared()).alias("sse"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    sums = spark.read.parquet(out).groupBy("model").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"))
    return sums.withColumn("rmse", rmse(F.col("sse"), F.col("n")))
