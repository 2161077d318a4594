"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, saved, without, word_count

#: Parameters of the registered query.
WEIGHTS, SHARE, EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 2026


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """Targets for (key, size, weight) rows: adds `target`.

    Sources in order of the level at which they reach their cap form a prefix of
    clamped ones; the first source that stays under its cap fixes the level of
    all later ones. This is the fixed point of clamping and resharing the excess
    by weight. One row per source, so the unpartitioned window is small.
    """
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    levels = (
        sources.withColumn("cap", F.lit(float(epochs)) * F.col("size"))
        .withColumn("budget", F.lit(float(share)) * F.sum("size").over(every))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(after))
        .withColumn("rank", F.row_number().over(rising))
        .withColumn("free", F.col("cap") * F.col("weights") >= F.col("left") * F.col("weight"))
    )
    first = F.min_by(F.struct("left", "weights", "rank"), F.when(F.col("free"), F.col("rank"))).over(every)
    return (
        levels.withColumn("first", first)
        .withColumn(
            "target",
            F.when(
                F.col("rank") >= F.col("first.rank"),
                F.least("cap", F.col("first.left") * F.col("weight") / F.col("first.weights")),
            ).otherwise(F.col("cap")),
        )
        .drop("cap", "budget", "left", "weights", "rank", "free", "first")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: float = EPOCHS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    prefix: int = 3,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """How often each document enters a mixture of its sources.

    Sources, by code point with null last, weigh `weights` in turn and share
    `share` times all words; none gets more than `epochs` times its words. Each
    document is taken floor(target / size) times; in a seeded order of the
    source's documents, those up to the rest of the target are taken once more.
    The order is cut at the first `prefix` hex digits of the seeded hash: offsets
    come from sums per (source, prefix), so a source with a third of all rows is
    dealt over 16**prefix windows, each with narrow rows if `keep` is narrow.

    Returns the columns `keep` (default: all) and size, source_size (long), target
    (double), copies, taken (long); columns of these names are replaced.
    Null or empty text: size 0, copies as the rate's whole part, taken 0. Null source:
    a source of its own. Null or repeated ids are rows like others; equal rows
    order by id and size, so the result does not depend on their order. Empty table: no rows.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    keep = without(keep or docs.columns, made)
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    rows = docs.select(
        *keep,
        word_count(F.col(text_col)).alias("size"),
        seeded.alias("_kt_hash"),
        F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("_kt_key"),
        F.col(id_col).alias("_kt_id"),
    ).withColumn("_kt_part", F.substring("_kt_hash", 1, prefix))

    parts = saved(rows.groupBy("_kt_key", "_kt_part").agg(F.sum("size").alias("size")), "mix-parts")
    n = len(weights)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    order = F.row_number().over(Window.orderBy("key")) - 1
    sources = (
        parts.groupBy(F.col("_kt_key").alias("key"))
        .agg(F.sum("size").alias("size"))
        .withColumn("weight", F.element_at(listed, (order % n + 1).cast("int")))
    )
    filled = water_fill(sources, share, epochs).select(
        F.col("key").alias("_kt_key"), F.col("size").alias("source_size"), "target"
    )
    earlier = Window.partitionBy("_kt_key").orderBy("_kt_part").rowsBetween(Window.unboundedPreceding, -1)
    plan = saved(
        parts.withColumn("_kt_offset", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .drop("size")
        .join(filled, "_kt_key")
        .withColumn("_kt_whole", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)))
        .withColumn("_kt_rest", F.col("target") - F.col("_kt_whole") * F.col("source_size")),
        "mix-plan",
    )
    before = (
        Window.partitionBy("_kt_key", "_kt_part")
        .orderBy("_kt_hash", "_kt_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.col("_kt_offset") + F.coalesce(F.sum("size").over(before), F.lit(0))
    return (
        rows.join(plan, ["_kt_key", "_kt_part"])
        .withColumn("_kt_more", (F.col("size") > 0) & (start + F.col("size") / 2.0 < F.col("_kt_rest")))
        .withColumn("copies", F.col("_kt_whole") + F.col("_kt_more").cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select(*keep, *made)
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents, one row each."""
    return mix(documents(spark, sf_dir), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH rows AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('2026:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k
  FROM documents),
sources AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY k) - 1 AS i FROM rows GROUP BY k),
weighed AS (
  SELECT k, source_size, ([5.0::DOUBLE, 2.0, 1.0])[(i % 3) + 1] AS w, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM sources),
levels AS (
  SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws,
         row_number() OVER (ORDER BY cap / w, k) AS r
  FROM weighed),
level AS (SELECT r, rest, ws FROM levels WHERE cap * ws >= rest * w ORDER BY r LIMIT 1),
targets AS (
  SELECT l.k, l.source_size,
         CASE WHEN v.r IS NOT NULL AND l.r >= v.r THEN least(l.cap, v.rest * l.w / v.ws) ELSE l.cap END AS target
  FROM levels l LEFT JOIN level v ON true),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size) END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.k ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM rows d JOIN targets t USING (k))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN size > 0 AND start + size / 2.0::DOUBLE < target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""
