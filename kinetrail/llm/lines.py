"""Line dedup over all documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, discard, documents, saved, stored_bytes, without

MIN_CHARS, MIN_DOCS = 40, 5
#: Bytes of the files of drops that are broadcast, up to some ten times as many in memory; more meet their rows by a sort-merge join.
BROADCAST = 8 << 20


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(WHITE))


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Drop lines that many documents share, but in the document of the largest id.

    Lines (split at \\n) are exploded; a line's key is the line stripped of ASCII white space
    with A-Z lower-cased, held as two 64-bit hashes. A count of rows per first
    hash, combined map-side, leaves the hashes that can reach min_docs; over
    their lines alone distinct documents are counted exactly. Positions to drop
    go back to their rows, and the other lines are joined again by position, in time linear in the lines. The drops
    are a written table: it is broadcast if its files are small (BROADCAST, or what Spark is set to), so that texts stay where they are; else
    rows meet them by a sort-merge join.

    Returns the input's columns with text_col replaced by the kept text, and n_lines, n_dropped
    (long; such columns, in either case, are replaced). Null or empty text: one empty line, kept, and
    the text becomes empty. Rows of equal id are one document for the count; null ids
    are one document below all others. Repeated rows get equal results. Empty table: no rows.
    """
    kept = without(docs.columns, ("n_lines", "n_dropped"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    row_hash = F.xxhash64(text)
    keyed = (
        docs.select(F.col(id_col).alias("id"), row_hash.alias("row"), F.split(text, "\n", -1).alias("lines"))
        .select("id", "row", F.posexplode("lines").alias("pos", "line"))  # the row's hash above, or it is made for each line
        .withColumn("line", _stripped(F.col("line")))
        .where(F.length("line") >= min_chars)
        .withColumn("line", ascii_lower(F.col("line")))
        .select("id", "row", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )
    often = saved(keyed.groupBy("h1").count().where(F.col("count") >= min_docs).select("h1"), "lines-often")
    found = saved(keyed.join(often, "h1"), "lines-found")
    holders = (
        found.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "last")
    )
    holders = saved(holders, "lines-holders")
    drops = (
        found.join(holders, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("last")))
        .groupBy("id", "row")
        .agg(F.collect_set("pos").alias("_kt_drop"))
        .select(F.col("id").alias("_kt_id"), F.col("row").alias("_kt_row"), "_kt_drop")
    )
    drops = saved(drops, "lines-drops")
    discard(often, found, holders)
    if stored_bytes(drops) <= BROADCAST:
        drops = F.broadcast(drops)
    rows = docs.select(*kept).withColumn("_kt_lines", F.split(text, "\n", -1)).withColumn("_kt_h", row_hash)
    joined = rows.join(drops, (F.col(id_col).eqNullSafe(F.col("_kt_id"))) & (F.col("_kt_h") == F.col("_kt_row")), "left")
    # the positions that stay, by hash set; looking each position up in the array of drops would be quadratic
    stay = F.array_except(F.sequence(F.lit(0), F.size("_kt_lines") - 1), F.col("_kt_drop"))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("_kt_lines"), i)), "\n")
    return joined.select(
        *[F.when(F.col("_kt_drop").isNull(), text).otherwise(left).alias(c) if c == text_col else F.col(c) for c in kept],
        F.size("_kt_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_kt_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document without the lines that five or more documents share."""
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
bad AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT d.*, b.k IS NOT NULL AND d.doc_id <> b.last AS gone FROM keyed d LEFT JOIN bad b USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
