"""Importance resampling towards a target distribution: hashed features, sparse counts in CSR blocks, gains, seeded draws."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, saved, small_batches
from .texts import PLAIN, PLAIN_GAP, word_slices

#: Longest run of words that is a feature, buckets of features, fewest words of a document that is drawn, hundredths drawn, seed.
ORDER, BUCKETS, WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: Scores of one step of the ranks' offsets.
STEP = 256
#: A block ends with the document that brings it to so many entries. Bytes of its files' row groups and pages: writers hold a
#: row group in memory, readers a page and up to 4,096 rows of a row group, and both look at sizes every 100 rows unless told otherwise.
ENTRIES, ROW_GROUP, PAGE = 1 << 14, 8 << 20, 1 << 20


def bucket_counts(text: bytes, order: int = ORDER, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and how many runs of up to `order` words fall into each bucket."""
    total, n, tail = np.zeros(buckets, np.int64), 0, []
    for words in word_slices(text, PLAIN, PLAIN_GAP):
        n += len(words)
        words, old = tail + words, len(tail)
        spaced = [b" " + w for w in words]
        runs = list(map(crc32, words))  # of the run of k words that begins at each place
        for k in range(1, order + 1):
            if k > 1:
                runs = list(map(crc32, spaced[k - 1 :], runs))
            new = np.array(runs[max(0, old - k + 1) :], np.int64)
            total += np.bincount(new % buckets, minlength=buckets)
        tail = words[-(order - 1) :] if order > 1 else []
    return n, total


def _index_type(buckets: int) -> np.dtype:
    return np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def count_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """The sparse matrix of documents by buckets, in CSR blocks of fewer than ENTRIES + `buckets` entries each.

    A row is a block: ids and n_words (arrays with an entry per document), indptr (int64), buckets (uint16, or uint32 of
    over 65,536) and counts (uint32) as little-endian binaries. Document k's entries stand at indptr[k] to indptr[k + 1], by bucket.
    Null and wordless texts have empty rows. Empty table: no blocks.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    index = _index_type(buckets)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, n_words, ends, at, n = 0, [], [0], [], []
            for k, text in enumerate(batch.column("text"), 1):
                words, total = bucket_counts(text.as_py() or b"", order, buckets)
                hit = np.flatnonzero(total)
                n_words.append(words)
                ends.append(ends[-1] + len(hit))
                at.append(hit.astype(index))
                n.append(total[hit].astype(np.uint32))
                if ends[-1] < ENTRIES and k < batch.num_rows:
                    continue
                ids = pa.ListArray.from_arrays(pa.array([0, k - first], pa.int32()), batch.column("id").slice(first, k - first))
                binary = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (at, n)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([n_words], pa.list_(pa.int64())), pa.array([np.array(ends, np.int64).tobytes()], pa.binary()), *binary],
                    ["ids", "n_words", "indptr", "buckets", "counts"],
                )
                first, n_words, ends, at, n = k, [], [0], [], []

    return rows.mapInArrow(build, f"ids array<{kind}>, n_words array<long>, indptr binary, buckets binary, counts binary")


def saved_matrix(matrix: DataFrame) -> DataFrame:
    """A count_matrix in files whose writers and readers hold a few MB of it, however large the input's splits are."""
    sizes = {"parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE}
    return saved(matrix, "sample-matrix", **sizes, **{f"parquet.{x}.size.row.check.min": 4 for x in ("block", "page")})


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the buckets that hold a feature: sums of each task's blocks first, so at most `buckets` rows of a task meet."""
    index = _index_type(buckets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, n in zip(batch.column("buckets"), batch.column("counts"), strict=True):
                weights = np.frombuffer(n.as_py(), np.uint32)
                total += np.bincount(np.frombuffer(at.as_py(), index), weights, buckets).astype(np.int64)  # whole below 2^53
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(total[hit], pa.int64())], ["bucket", "n"])

    return matrix.select("buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from two tables of column_sums.

    With s of S features of the source and t of T of the target in the bucket, gain is
    floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))): how much likelier the target makes it, smoothed by one.
    """
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    each = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    sums = both.unionByName(each).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    every = Window.partitionBy(F.lit(0))  # `buckets` rows
    total = lambda c: F.sum(c).over(every) + buckets
    return sums.select("bucket", F.floor(1000 * F.log((F.col("t") + 1) * total("s") / ((F.col("s") + 1) * total("t")))).alias("gain"))


def row_weights(matrix: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of each document: the matrix times the gains, divided by the document's features, rounded down; 0 of none."""
    kind, index = matrix.schema["ids"].dataType.elementType.simpleString(), _index_type(len(gains))

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[], []]
            for k in range(batch.num_rows):
                ends = np.frombuffer(batch.column("indptr")[k].as_py(), np.int64)
                at = np.frombuffer(batch.column("buckets")[k].as_py(), index)
                n = np.frombuffer(batch.column("counts")[k].as_py(), np.uint32).astype(np.int64)
                features, gained = (np.diff(np.append(0, np.cumsum(x))[ends]) for x in (n, n * gains[at]))
                found[0].append(features)
                found[1].append(np.where(features > 0, gained // np.maximum(features, 1), 0))
            if found[0]:
                own = [batch.column(c).flatten() for c in ("ids", "n_words")]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(np.concatenate(x), pa.int64()) for x in found)], ["id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(product, f"id {kind}, n_words long, n_features long, weight long")


def seeded_noise(id_: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variate) of an id: the k highest sums with log weights are k draws in proportion to weights, none twice."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def with_rank(rows: DataFrame, drawable: Column, percent: int, score_col: str = "score", id_col: str = "id") -> DataFrame:
    """Adds rank: 1, 2, 3... of the floor(percent hundredths) highest scores among drawable rows, ties to smaller ids, null elsewhere.

    `rows` must be cheap to read twice. Ranks are a score's offset plus the place in it. Offsets come from counts per score and per STEP scores;
    scores are thousandths of logarithms, some ten thousand values however many rows, so both tables stay small.
    """
    score = F.col(score_col)
    tally = rows.where(drawable).groupBy(score.alias("_score")).agg(F.count("*").alias("_n")).withColumn("_step", F.floor(F.col("_score") / STEP))
    tally = saved(tally, "sample-tally")
    steps = tally.groupBy("_step").agg(F.sum("_n").alias("_of_step"))
    before = F.coalesce(F.sum("_of_step").over(Window.orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("_n").over(Window.partitionBy("_step").orderBy(F.desc("_score"))) - F.col("_n")
    wanted = (tally.agg(F.sum("_n")).first()[0] or 0) * percent // 100
    offsets = tally.join(steps.select("_step", before.alias("_before")), "_step").select("_score", (F.col("_before") + inside).cast("long").alias("_first"))
    places = saved(offsets.where(F.col("_first") < wanted), "sample-places")
    placed = rows.withColumn("_in", F.coalesce(drawable, F.lit(False))).join(places, F.col("_score") == score, "left")
    taken = F.col("_in") & F.col("_first").isNotNull()
    rank = F.col("_first") + F.row_number().over(Window.partitionBy("_score").orderBy(F.col(id_col).asc_nulls_last()))
    drawn = placed.where(taken).withColumn("rank", F.when(rank <= wanted, rank).cast("long"))
    rest = placed.where(~taken).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*rows.columns, "rank")


def resample(
    docs: DataFrame,
    target: DataFrame,
    order: int = ORDER,
    buckets: int = BUCKETS,
    words: int = WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """How likely the target makes each document, and a seeded draw of those that it makes likeliest.

    Features are runs of 1 to `order` words, by crc32 in `buckets` buckets. 1. One pass over whole texts (a long one in slices) writes the
    matrix of documents by buckets as CSR blocks. 2. Its column sums, and the target's, give gains (bucket_gains), the
    only thing that reaches the driver and the tasks: `buckets` numbers. 3. The matrix times the gains gives weights. 4. A document's score is its
    weight plus seeded noise of its id, and the `percent` hundredths of highest scores among documents of `words` words or more are ranked.

    Returns one row per input row: id_col, n_features, weight, score, rank (long; rank null if not drawn). Null or
    wordless texts: no features, weight 0, never drawn. Null ids share one noise ("null"), as repeated ids do; repeated rows each have a rank,
    in any order. Other columns are ignored, whatever their names. Empty documents: no rows; an empty target: all gains from counts of 0.
    """
    matrix = saved_matrix(count_matrix(docs, id_col, text_col, order, buckets))
    wanted = column_sums(count_matrix(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), "id", "text", order, buckets), buckets)
    gains = np.zeros(buckets, np.int64)
    for row in bucket_gains(column_sums(matrix, buckets), wanted, buckets).collect():
        gains[row["bucket"]] = row["gain"]
    scored = row_weights(matrix, gains).withColumn("score", F.col("weight") + seeded_noise(F.col("id"), seed))
    rows = saved(scored, "sample-weights")
    discard(matrix)
    out = with_rank(rows, F.col("n_words") >= words, percent)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with their columns; rows of a drawn id all stay, rows of a null id never do."""
    drawn = resample(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(id_col).distinct()
    return docs.join(drawn, id_col, "left_semi").select(*docs.columns)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document towards the benchmark's texts."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: crc32 byte by byte over distinct features, from a table of 256 entries made by its rule: for tables of a few thousand documents.
OP11_SQL = r"""
WITH RECURSIVE step AS (
  SELECT i AS n, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS crcs FROM step WHERE k = 8),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT side, id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT side, rid, w[i] AS one, w[i] || ' ' || w[i + 1] AS two
  FROM (SELECT side, rid, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0)),
features AS (
  SELECT side, rid, f, count(*) AS n
  FROM (SELECT side, rid, one AS f FROM runs UNION ALL SELECT side, rid, two FROM runs WHERE two IS NOT NULL) GROUP BY ALL),
named AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), i * 2 + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), crc_table),
counts AS (SELECT side, rid, bucket, sum(n) AS n FROM features JOIN named USING (f) GROUP BY ALL),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM counts GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (big_s + 10000) / ((s::DOUBLE + 1) * (big_t + 10000))))::BIGINT AS gain FROM sums, totals),
weights AS (
  SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM counts JOIN gains USING (bucket) WHERE side = 'd' GROUP BY rid),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE))))::BIGINT AS score
  FROM words LEFT JOIN weights USING (rid) WHERE side = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r,
         (25 * count(*) FILTER (n_words >= 20) OVER ()) // 100 AS wanted FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= wanted THEN r END::BIGINT AS rank FROM ranked
"""
