"""Benchmark decontamination by word windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, documents, saved, small_batches, without

#: Runs of digits, lower-cased letters and anything beyond ASCII, over UTF-8 bytes.
NORMAL = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Entries that one broadcast holds at most: pairs of item and window, or windows of a benchmark that has more pairs.
BROADCAST = 1_000_000


def words_of(text: bytes) -> list[bytes]:
    return NORMAL.findall(text.lower())  # bytes.lower() leaves all but A-Z


def item_windows(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    n = len(words)
    return {b" ".join(words[i : i + size]) for i in range(max(1, n - size + 1))} if n else set()


class Grams:
    """A hash set of windows and what each stands for, with the words that open and close one as quick tests."""

    def __init__(self, windows: dict[bytes, list]):
        self.windows = windows
        self.by_size: dict[int, tuple[frozenset, frozenset]] = {}
        split = [w.split(b" ") for w in windows]
        for n in {len(w) for w in split}:
            same = [w for w in split if len(w) == n]
            self.by_size[n] = frozenset(w[0] for w in same), frozenset(w[-1] for w in same)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, merged runs of hit words (end exclusive), what the windows found stand for."""
        words = words_of(text)
        found, items = [], set()
        for n, (opens, closes) in self.by_size.items():
            for i in [i for i, w in enumerate(words[: len(words) - n + 1 or None]) if w in opens] if len(words) >= n else ():
                if words[i + n - 1] in closes and (of := self.windows.get(b" ".join(words[i : i + n]))):
                    found.append((i, i + n))
                    items.update(of)
        runs: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if runs and a <= runs[-1][1]:
                runs[-1] = runs[-1][0], max(b, runs[-1][1])
            else:
                runs.append((a, b))
        return len(words), runs, items


_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan_column(text: Column, grams, of: T.DataType, arrow: pa.DataType) -> Column:
    """(n_words, runs, found) of each text; `found` is a sorted array of what its windows stand for."""
    made = pa.struct([("n_words", pa.int64()), ("runs", _RUNS_ARROW), ("found", pa.list_(arrow))])

    @F.arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", _RUNS), T.StructField("found", T.ArrayType(of))]))
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            n, runs, found = grams.value.scan(t or b"")
            out.append({"n_words": n, "runs": [{"start": a, "end": b} for a, b in runs], "found": sorted(found)})
        return pa.array(out, made)

    return scan(text.cast("binary"))


@F.arrow_udf(T.LongType())
def _n_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(words_of(t or b"")) for t in texts.to_pylist()], pa.int64())


def _item_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grams = [], []
            for item, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                found = sorted(item_windows(words_of(text or b""), size))
                ids += [item] * len(found)
                grams += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(grams, pa.binary())], ["item", "gram"])

    return rows


def _without(text: Column, runs: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if t is not None and found:
                words = [m.span() for m in NORMAL.finditer(t.lower())]
                for run in reversed(found):
                    t = t[: words[run["start"]][0]] + t[words[run["end"] - 1][1] :]
            out.append(None if t is None else t.decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return cut(text.cast("binary"), runs)


@F.arrow_udf(_RUNS)
def _merged(runs: pa.Array) -> pa.Array:
    """Sorted runs with overlapping and touching ones made one."""
    out = []
    for row in runs.to_pylist():
        one: list[dict] = []
        for r in row or ():
            if one and r["start"] <= one[-1]["end"]:
                one[-1]["end"] = max(one[-1]["end"], r["end"])
            else:
                one.append(dict(r))
        out.append(one)
    return pa.array(out, _RUNS_ARROW)


def _broadcast(spark: SparkSession, rows: list) -> object:
    part: dict[bytes, list] = {}
    for meant, gram in rows:
        part.setdefault(bytes(gram), []).append(meant)
    return spark.sparkContext.broadcast(Grams(part))


def _hit_texts(texts: DataFrame, pairs: DataFrame, bound: int) -> DataFrame:
    """(h1, h2, runs, items) of the texts (h1, h2, text) with a window of (item, gram), however many of these there are.

    Windows are numbered and dealt by hash into slices of about `bound`; each slice is broadcast for a pass
    that writes only its hits. Items come in at the end, by a join on the window's number.
    """
    spark = texts.sparkSession
    windows = saved(pairs.select("gram").distinct().withColumn("id", F.monotonically_increasing_id()), "benchmark-grams")
    slices = max(1, -(-windows.count() // bound))
    passes = []
    for k in range(slices):
        held = _broadcast(spark, windows.where(F.pmod(F.xxhash64("gram"), F.lit(slices)) == k).select("id", "gram").collect())
        found = texts.select("h1", "h2", _scan_column(F.col("text"), held, T.LongType(), pa.int64()).alias("s"))
        hit = found.where(F.size("s.found") > 0).select("h1", "h2", "s.runs", "s.found")
        passes.append(saved(hit.dropDuplicates(["h1", "h2"]), "leaks"))
        held.unpersist()
    hits = passes[0]
    for more in passes[1:]:
        hits = hits.unionByName(more)
    # texts with the same windows have the same items: each such set of windows meets the items once
    sets = saved(
        hits.groupBy("h1", "h2")
        .agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"), F.sort_array(F.flatten(F.collect_list("found"))).alias("found"))
        .withColumns({"s1": F.xxhash64("found"), "s2": F.xxhash64(F.lit(1), "found")}),
        "leaks-sets",
    )
    of = sets.select("s1", "s2", "found").dropDuplicates(["s1", "s2"]).select("s1", "s2", F.explode("found").alias("id"))
    named = pairs.join(windows, "gram").select("id", "item")
    items = of.join(named, "id").groupBy("s1", "s2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = saved(sets.join(items, ["s1", "s2"]).select("h1", "h2", "runs", "items"), "leaks-items")
    discard(windows, sets, *passes)
    return out


def scan_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    bound: int = BROADCAST,
    item_col: str = "item_id",
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Which words of each document stand in windows of benchmark items.

    The benchmark's pairs of item and window (size consecutive words, or all of a shorter item's) are counted
    first. Up to `bound` of them are broadcast as a hash set, and one Arrow pass over the documents
    looks at every window. Of more, the distinct windows alone are broadcast, in slices of about `bound` for a pass each over
    the texts, which stay where they are; only hits are written, and their items and rows come in by joins.

    Returns the columns `keep` (default: all) and n_words, n_hit (long), hit_runs (array of
    start, end in words), items (array<string>, sorted); such columns, in either case, are replaced. Null or
    empty text: no words, no hits. Null or wordless items have no windows; a null item id reads "null";
    repeated items count once. Empty documents or benchmark: no rows, or no hits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = ("n_words", "n_hit", "hit_runs", "items")
    keep = without(keep or docs.columns, made)
    named = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("binary").alias("text")
    )
    pairs = saved(named.mapInArrow(_item_rows(size), "item string, gram binary").distinct(), "benchmark-windows")
    rows = docs.select(*keep, F.col(text_col).alias("_kt_text"))
    if pairs.count() <= bound:
        held = _broadcast(spark, pairs.collect())
        rows = rows.withColumn("_kt_s", _scan_column(F.col("_kt_text"), held, T.StringType(), pa.string()))
        words, runs, items = F.col("_kt_s.n_words"), F.col("_kt_s.runs"), F.col("_kt_s.found")
    else:
        keys = {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}
        texts = docs.where(F.col(text_col) != "").select(F.col(text_col).alias("text")).withColumns(keys)
        found = _hit_texts(texts, pairs, bound).select(*[F.col(c).alias(f"_kt_{c}") for c in ("h1", "h2", "runs", "items")])
        both = (F.xxhash64("_kt_text") == F.col("_kt_h1")) & (F.xxhash64(F.lit(1), "_kt_text") == F.col("_kt_h2"))
        rows = rows.join(found, both, "left")
        words = _n_words(F.col("_kt_text").cast("binary"))
        runs = _merged(F.col("_kt_runs"))
        items = F.coalesce("_kt_items", F.array().cast("array<string>"))
    n_hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return (
        rows.select(
            *[F.col("_kt_text").alias(c) if c == text_col else F.col(c) for c in keep],
            words.alias("n_words"),
            runs.alias("hit_runs"),
            items.alias("items"),
        )
        .withColumn("n_hit", n_hit)
        .select(*keep, *made)
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", text_col: str = "text", **options) -> DataFrame:
    """Remove leaked documents ("document") or just their hit runs of words ("span").

    Rows and columns are as in scan_leaks; a cut text loses the characters
    from a run's first to its last word.
    """
    found = scan_leaks(docs, benchmark, text_col=text_col, **options)
    if mode == "document":
        return found.where(F.col("n_hit") == 0)
    cut = F.when(F.col("n_hit") > 0, _without(F.col(text_col), F.col("hit_runs"))).otherwise(F.col(text_col))
    return found.withColumn(text_col, cut)


def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What benchmark windows each document holds."""
    found = scan_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.rid, dw.i, dw.n, g.item_id FROM dw JOIN g USING (gram, n)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
       FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
