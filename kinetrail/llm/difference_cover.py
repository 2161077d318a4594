"""Suffix arrays of many texts by the skew algorithm (difference cover modulo 3), as DataFrame jobs.

Exact, and every step is a distributed sort or join, but each byte is a row in some twenty sorts and joins.
See the README for what that costs; `repeats` samples suffixes instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct keys with their dense rank from 0, by a range sort and a sum over its partitions."""
    ordered = saved(
        rows.select(*keys)
        .distinct()
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id()),
        "numbered",
    ).select(*keys, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    return ordered.join(parts.select("_part", "_before"), "_part").select(*keys, (F.col("_row") + F.col("_before")).alias(name))


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.join(numbered(rows, keys, name), keys)


def _sorted_suffixes(text: DataFrame) -> DataFrame:
    """(doc, i, rank) of every position of the strings (doc, i, sym).

    All symbols are positive, and each string ends with a symbol that stands nowhere else, so that no two suffixes are equal.
    """
    order = Window.partitionBy("doc").orderBy("i")
    rows = saved(
        text.select(
            "doc",
            "i",
            F.col("sym").alias("a"),
            F.lead("sym", 1, 0).over(order).alias("b"),
            F.lead("sym", 2, 0).over(order).alias("c"),
            (F.col("i") % 3).alias("m"),
        ),
        "triples",
    )
    sample = rows.where("m != 0")
    named = saved(_ranked(sample, ["a", "b", "c"], "name"), "names")
    if named.count() == named.select("name").distinct().count():
        ranks = named.select("doc", "i", F.col("name").alias("rank"))
    else:
        # positions 1, 4, 7, ... and then 2, 5, 8, ... of each string; a string's own last symbol keeps both halves apart
        half = rows.groupBy("doc").agg(F.count_if(F.col("m") == 1).alias("half"))
        place = F.when(F.col("m") == 1, (F.col("i") - 1) / 3).otherwise(F.col("half") + 1 + (F.col("i") - 2) / 3).cast("long")
        inner = named.join(half, "doc").select("doc", place.alias("i"), (F.col("name") + 2).alias("sym"))
        gap = half.select("doc", F.col("half").alias("i"), F.lit(1).cast("long").alias("sym"))
        deep = _sorted_suffixes(_closed(inner.unionByName(gap)))
        ranks = named.join(half, "doc").select("doc", "i", place.alias("j")).join(
            deep.select("doc", F.col("i").alias("j"), "rank"), ["doc", "j"]
        ).select("doc", "i", "rank")
        ranks = _ranked(saved(ranks, "deep"), ["rank"], "dense").select("doc", "i", F.col("dense").alias("rank"))
    ranks = saved(ranks, "ranks")

    def behind(by: int, name: str) -> DataFrame:
        return ranks.select("doc", (F.col("i") - by).alias("i"), (F.col("rank") + 1).alias(name))

    full = saved(
        rows.join(behind(1, "r1"), ["doc", "i"], "left").join(behind(2, "r2"), ["doc", "i"], "left").fillna(0, ["r1", "r2"]),
        "full",
    )
    # where a remaining suffix stands among those of either kind of sample, and among its own
    one = _ranked(full.where("m IN (0, 1)"), ["a", "r1"], "p")
    two = _ranked(full.where("m IN (0, 2)"), ["a", "b", "r2"], "p")
    rest = _ranked(full.where("m = 0"), ["a", "r1"], "p0").select("doc", "i", "p0")
    first = _ranked(one.where("m = 1"), ["p"], "q").select("doc", "i", (F.col("p") - F.col("q")).alias("zeros"))
    second = _ranked(two.where("m = 2"), ["p"], "q").select("doc", "i", (F.col("p") - F.col("q")).alias("zeros"))
    sampled = ranks.join(first.unionByName(second), ["doc", "i"]).select("doc", "i", (F.col("rank") + F.col("zeros")).alias("rank"))
    remaining = (
        rest.join(one.where("m = 0").select("doc", "i", F.col("p").alias("p1")), ["doc", "i"])
        .join(two.where("m = 0").select("doc", "i", F.col("p").alias("p2")), ["doc", "i"])
        .select("doc", "i", (F.col("p1") + F.col("p2") - F.col("p0")).alias("rank"))
    )
    out = saved(sampled.unionByName(remaining), "suffixes")
    discard(full, ranks, named, rows)
    return out


def _closed(text: DataFrame) -> DataFrame:
    """Ends each string with a symbol of its own, smaller than all others."""
    ends = saved(text.groupBy("doc").agg(F.max("i").alias("last")), "ends")
    own = numbered(ends, ["doc"], "sym")
    count = ends.count()
    tail = ends.join(own, "doc").select("doc", (F.col("last") + 1).alias("i"), (F.col("sym") + 1).alias("sym"))
    return text.select("doc", "i", (F.col("sym") + count).alias("sym")).unionByName(tail)


def suffix_array(docs: DataFrame) -> DataFrame:
    """(doc, i, rank) of each byte position of (doc long, text binary), and of each end, in suffix order.

    Documents must have distinct ids; null and empty texts have no positions. Equal suffixes of several
    documents stand in the order of their ids.
    """
    n = F.octet_length("text")
    at = docs.where(n > 0).select("doc", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    symbol = F.conv(F.hex(F.substr(F.col("text"), F.col("i") + 1, F.lit(1))), 16, 10).cast("long") + 1
    return _sorted_suffixes(_closed(at.select("doc", F.col("i").cast("long").alias("i"), symbol.alias("sym"))))


def repeated_positions(docs: DataFrame, length: int) -> DataFrame:
    """(doc, i) where a string of `length` bytes starts that starts elsewhere too, by comparing neighbours."""
    order = suffix_array(docs)
    prefix: Column = F.substr(F.col("text"), (F.col("i") + 1).cast("int"), F.lit(length))
    own = order.join(docs, "doc").select("doc", "i", "rank", F.when(F.octet_length(prefix) == length, prefix).alias("p"))
    after = own.select((F.col("rank") - 1).alias("rank"), F.col("p").alias("next"))
    before = own.select((F.col("rank") + 1).alias("rank"), F.col("p").alias("last"))
    both = own.join(after, "rank", "left").join(before, "rank", "left")
    return both.where("p = next OR p = last").select("doc", "i")
