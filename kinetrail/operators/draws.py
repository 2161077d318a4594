"""NumPy's seeded draws, made in tasks: each finds its place in the generator's stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of 32 bits of a chunk; even, as the generator makes two at a time.
CHUNK = 1 << 18


def threshold(n: int) -> int:
    """Words whose product with n has a low half under this are rejected, so that all results are equally likely."""
    return (1 << 32) % n


def accepted(seed: int, start: int, count: int, n: int) -> np.ndarray:
    """Results from 0 to n - 1 of the words `start` (even) and on that aren't rejected: the high halves of word * n."""
    bits = np.random.PCG64(seed)
    bits.advance(start // 2)
    words = np.ascontiguousarray(bits.random_raw(count // 2)).astype("<u8").view("<u4").astype(np.uint64)  # low halves come first
    product = words * np.uint64(n)
    return (product[(product & np.uint64(0xFFFFFFFF)) >= np.uint64(threshold(n))] >> np.uint64(32)).astype(np.int64)


def resample_counts(spark: SparkSession, seed: int, repeats: int, n: int, chunk: int = CHUNK) -> DataFrame:
    """(rep, g, times): how often each of n is drawn in each repetition by numpy.random.default_rng(seed).integers(0, n, (repeats, n)).

    The stream is cut into chunks of words. A word is rejected or not whatever stands before it, so tasks first count what each
    chunk accepts; sums of the counts are the places of its results, which tasks then make again and count by repetition.
    """
    if not 1 <= n < 1 << 32:
        raise ValueError("n must be 1 to 2**32 - 1")
    need = repeats * n
    if n == 1:  # nothing is drawn
        return spark.range(repeats).select(F.col("id").alias("rep"), F.lit(0).cast("long").alias("g"), F.lit(1).cast("long").alias("times"))
    spare = need * threshold(n) / (1 << 32)
    chunks = -(-int(need + spare + 20 * spare**0.5 + 64) // chunk)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            found = [len(accepted(seed, i * chunk, chunk, n)) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["id", "n"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, first in zip(batch.column("id").to_pylist(), batch.column("first").to_pylist(), strict=True):
                drawn = accepted(seed, i * chunk, chunk, n)[: max(0, need - first)]
                pair, times = np.unique((first + np.arange(len(drawn))) // n * n + drawn, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (pair // n, pair % n, times)], ["rep", "g", "times"])

    per = spark.range(chunks).mapInArrow(count, "id long, n long")
    enough = F.when(F.sum("n").over(Window.partitionBy(F.lit(0))) >= need, F.sum("n").over(Window.orderBy("id")) - F.col("n"))
    placed = per.select("id", F.coalesce(enough, F.raise_error(F.lit("more words were rejected than expected"))).cast("long").alias("first"))
    made = placed.repartition(min(chunks, 200), "id").mapInArrow(make, "rep long, g long, times long")
    return made.groupBy("rep", "g").agg(F.sum("times").alias("times"))
