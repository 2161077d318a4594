"""Near-duplicate documents: banded minwise signatures, sequential Bayesian verification, components."""

from __future__ import annotations

import math
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, documents, saved, small_batches
from .components import components
from .shingles import SHINGLE, MinHash, band_keys, shingle_hashes

#: 40 bands of 5: a pair of similarity 0.75 shares no band with probability 2e-5.
BANDS, ROWS = 40, 5
#: Similarity in hundredths; signature positions compared at a time; probability of losing a pair at a test.
PERCENT, BATCH, MISS = 75, 40, 1e-6
#: Rounds of stars before all pairs across components are compared; size of a block for that, and bytes of text that count as one row.
STARS, BLOCK, UNIT = 4, 256, 16_384
#: Pivots of one document in a round of stars.
PIVOTS = 12


def words_of(text: bytes) -> list[bytes]:
    """White-space separated words with A-Z lower-cased."""
    return text.lower().split()


@cache
def _least_matches(count: int, percent: int, batch: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(positions seen, fewest matches to go on): below, P(similarity >= threshold) < miss.

    With a uniform prior and m of n positions equal, the posterior is Beta(m + 1, n - m + 1), whose
    upper tail at t is the chance of at most m hits in n + 1 trials of probability t.
    """
    t, out = percent / 100, []
    for n in range(batch, count + 1, batch):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def surviving(left: np.ndarray, right: np.ndarray, percent: int = PERCENT, batch: int = BATCH, miss: float = MISS) -> np.ndarray:
    """Indexes of the pairs of signatures (rows) that no batch prunes."""
    alive, matches, seen = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, least in _least_matches(left.shape[1], percent, batch, miss):
        matches = matches + (left[alive, seen:n] == right[alive, seen:n]).sum(axis=1)
        on = matches >= least
        alive, matches, seen = alive[on], matches[on], n
    return alive


def shingle_set(text: bytes, size: int) -> frozenset:
    words = words_of(text)
    size = min(size, len(words))
    return frozenset(zip(*(words[k:] for k in range(size)), strict=False)) if words else frozenset()


def alike(x: frozenset, y: frozenset, percent: int) -> bool:
    """Whether two sets have that similarity, in hundredths; an empty one is like nothing."""
    if not x or not y or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(x & y)
    return 100 * common >= percent * (len(x) + len(y) - common)


class _Sets(dict):
    """Shingle sets of texts; emptied when they hold many shingles."""

    def __init__(self, size: int, bound: int = 300_000):
        self.size, self.bound, self.held = size, bound, 0

    def __missing__(self, text: bytes) -> frozenset:
        found = shingle_set(text, self.size)
        if self.held + len(found) > self.bound:
            self.clear()
            self.held = 0
        self.held += len(found)
        self[text] = found
        return found


_SIGNED = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("words", T.BinaryType()),
        T.StructField("sig", T.BinaryType()),
    ]
)


def _sign(text: Column, count: int, size: int) -> Column:
    minhash = MinHash(count)

    @F.arrow_udf(_SIGNED)
    def sign(texts: pa.Array) -> pa.Array:
        ns, digests, sigs = [], [], []
        for t in texts.to_pylist():
            words = words_of(t or b"")
            h = np.unique(shingle_hashes(words, size))
            ns.append(len(h))
            digests.append(blake2b(b" ".join(words), digest_size=16).digest())
            sigs.append(minhash.stored(minhash.minima(h)).tobytes() if len(h) else b"")
        return pa.StructArray.from_arrays([pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=_SIGNED.names)

    return sign(text.cast("binary"))


def _bands(sig: Column, bands: int, rows: int) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def keys(sigs: pa.Array) -> pa.Array:
        return pa.array([band_keys(np.frombuffer(s, np.uint16), bands, rows) for s in sigs.to_pylist()], pa.list_(pa.int64()))

    return keys(sig)


def _matrix(sigs: pa.Array, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint16).reshape(-1, count)


def _links(pairs: DataFrame, known: DataFrame, count: int, percent: int, size: int, miss: float) -> DataFrame:
    """The linked ones of candidate pairs (a, b), written: signatures first; only the survivors fetch their whole texts."""

    @F.arrow_udf(T.BooleanType())
    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), bool)
        if len(out):
            out[surviving(_matrix(left, count), _matrix(right, count), percent, BATCH, miss)] = True
        return pa.array(out)

    @F.arrow_udf(T.BooleanType())
    def linked(texts: pa.Array, others: pa.Array) -> pa.Array:
        sets = _Sets(size)
        return pa.array([alike(sets[x.as_py()], sets[y.as_py()], percent) for x, y in zip(texts, others, strict=True)], pa.bool_())

    def both(rows: DataFrame, column: str) -> DataFrame:
        b = known.select(F.col("id").alias("b"), F.col(column).alias(f"{column}_b"))
        a = known.select(F.col("id").alias("a"), F.col(column).alias(f"{column}_a"))
        return rows.join(b, "b").join(a, "a")

    alive = saved(both(pairs, "sig").where(near("sig_a", "sig_b")).select("a", "b").distinct(), "near-alive")
    out = saved(both(alive, "text").where(linked("text_a", "text_b")).select("a", "b").distinct(), "near-links")
    discard(alive)
    return out


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _numbers(block: pa.Table, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """asks, id, comp and the matrix of signatures of a block."""
    asks, ids, comps = (block.column(c).to_numpy() for c in ("asks", "id", "comp"))
    return asks, ids, comps, np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint16).reshape(-1, count)


def _shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many positions each row of left has in common with each row of right; at most 255 positions."""
    columns, out = np.ascontiguousarray(right.T), np.zeros((len(left), len(right)), np.uint8)
    for k, column in enumerate(columns):
        out += left[:, k, None] == column
    return out


def _likely(block: pa.Table, band: int, bands: int, rows: int, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (asking, asked) of a block that signatures don't rule out: of other components, in their first common band only.

    The first batch of positions is counted for all pairs of the block at once, later ones for what it leaves.
    In the order of the asking rows, likeliest partners first.
    """
    asks, _, comps, sigs = _numbers(block, bands * rows)
    of, to = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(of) or not len(to):
        return of[:0], to[:0]
    here = int(np.flatnonzero(band_keys(sigs[of[0]], bands, rows) == band)[0])
    (seen, least), *later = _least_matches(bands * rows, percent, BATCH, miss) or ((0, 0),)
    common = _shared(sigs[of, :seen], sigs[to, :seen])
    i, k = np.nonzero((common >= least) & (comps[of, None] != comps[to]))
    matches, i, k = common[i, k].astype(np.int64), of[i], to[k]
    for n, least in later:
        matches = matches + (sigs[i, seen:n] == sigs[k, seen:n]).sum(axis=1)
        on = matches >= least
        i, k, matches, seen = i[on], k[on], matches[on], n
    earlier = (sigs[i, : here * rows] == sigs[k, : here * rows]).reshape(len(i), here, rows).all(axis=2).any(axis=1)
    here_too = (sigs[i, here * rows : (here + 1) * rows] == sigs[k, here * rows : (here + 1) * rows]).all(axis=1)
    first = np.flatnonzero(here_too & ~earlier)
    first = first[np.lexsort((-matches[first], i[first]))]
    return i[first], k[first]


def _matched(bands: int, rows: int, percent: int, miss: float):
    """Who of a block of outsiders, and of a block of a band's members, has a pair that signatures don't rule out."""

    def compare(key: tuple, block: pa.Table) -> pa.Table:
        partner = np.zeros(block.num_rows, bool)
        for side in _likely(block, key[0].as_py(), bands, rows, percent, miss):
            partner[side] = True
        return block.drop_columns("sig").filter(pa.array(partner))

    return compare


def _across(bands: int, rows: int, percent: int, size: int, miss: float):
    """Links between components of a block of outsiders with a block of a band's members.

    A pair is compared in its first common band only: signatures first, then whole texts, likeliest
    pairs first. Components that a link of this block has joined already need no second one.
    """

    def compare(key: tuple, block: pa.Table) -> pa.Table:
        ids, comps = (block.column(c).to_pylist() for c in ("id", "comp"))
        texts, found, joined, sets = block.column("text").to_pylist(), [], {}, _Sets(size)

        def find(comp: int) -> int:
            while comp in joined:
                comp = joined[comp]
            return comp

        for i, k in zip(*(x.tolist() for x in _likely(block, key[0].as_py(), bands, rows, percent, miss)), strict=True):
            a, b = find(comps[i]), find(comps[k])
            if a != b and alike(sets[texts[i]], sets[texts[k]], percent):
                joined[max(a, b)] = min(a, b)
                found.append({"a": min(ids[i], ids[k]), "b": max(ids[i], ids[k])})
        return pa.Table.from_pylist(found, schema=_LINK)

    return compare


def near_groups(
    docs: DataFrame,
    percent: int = PERCENT,
    size: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = MISS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups of documents linked by shingle sets of `percent` hundredths similarity.

    1. One Arrow pass signs whole texts; those of the same words in the same order, by a cryptographic digest of 128 bits, are a class, a
       numbered node from here on, with the text of its smallest id. Other texts with an equal set are compared like any others. 2. Band keys of the classes are counted, and members of
       bands with two or more stay. 3. Each is compared with the first members of its bands, PIVOTS at most (stars):
       batches of signature positions, pruned as soon as the posterior probability of reaching the
       threshold falls below `miss`, then the exact sets of whole texts. 4. Links become components.
       Bands that still hold several components get stars around other members of their largest
       component; what is left after STARS rounds, or a round that hardly links any, is compared
       completely, but only across components: blocks of members outside a band's largest component
       with blocks of all its members. Blocks, bounded in rows and in bytes of text, first hold signatures alone; whole texts
       come only to members that they leave with a partner, and are compared until a link joins two components. Just
       members and links become rows. So a group of n near copies costs about n comparisons, and no link between components is lost.

    Returns one row per input row: id_col, n_shingles (long, distinct by hashes of 64 bits), component_id (long), kept (boolean, id =
    component_id). Null, empty or blank text: 0 shingles, linked with nothing. Rows of equal id are one
    document: their texts are in one component; a null id is linked with nothing, component_id null, kept true. Other
    columns are ignored. Empty table: no rows. Ids must cast to long.
    """
    small_batches(docs.sparkSession)
    count = bands * rows
    source = docs.select(F.col(id_col).alias("own"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    weight = (1 + F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / UNIT)).cast("int").alias("w")
    text_hash = F.xxhash64(F.col("text").cast("binary"))
    signed = source.select("own", "id", weight, text_hash.alias("h"), _sign(F.col("text"), count, size).alias("s"))
    signed = saved(signed.select("own", "id", "w", "h", "s.*"), "near-signed")
    usable = signed.where("n > 0 AND id IS NOT NULL")
    first = usable.groupBy("words").agg(F.min(F.struct("id", "h")).alias("first"))
    classes = saved(first.select("words", "first.*").withColumn("node", F.monotonically_increasing_id()), "near-classes")
    # node, where its text is, and what is known of it: a row per class, however many texts an id has
    reps = saved(usable.join(classes, ["words", "id", "h"]).select(F.col("node").alias("id"), F.col("id").alias("doc"), "h", "w", "sig").dropDuplicates(["id"]), "near-reps")
    several = usable.groupBy("id").agg(F.min("words").alias("low"), F.max("words").alias("high")).where("low != high").select("id")
    mine = usable.join(several, "id", "left_semi").select("id", "words").distinct().join(classes.select("words", "node"), "words")
    mine = saved(mine.select("id", "node"), "near-mine")
    own = mine.join(mine.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b").where("a != b")
    keyed = reps.select("id", "w", F.explode(_bands(F.col("sig"), bands, rows)).alias("band"))
    shared = keyed.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("band", "low")
    member = saved(keyed.join(shared, "band").distinct(), "near-members")
    ids = saved(member.select("id").distinct().join(reps.select("id", "doc", "h", "sig"), "id"), "near-ids")
    texts = source.where("text IS NOT NULL").select(F.col("id").alias("doc"), text_hash.alias("h"), F.col("text").cast("binary").alias("text"))
    known = saved(texts.join(ids, ["doc", "h"]).dropDuplicates(["id"]).select("id", "text", "sig"), "near-known")
    discard(ids, reps)

    def verified(pairs: DataFrame) -> DataFrame:
        return _links(pairs, known, count, percent, size, miss)

    def stars(rows: DataFrame, order: Column) -> DataFrame:
        """(a, b) of each document with its first few pivots: linear in the documents, whatever the bands."""
        few = F.slice(F.sort_array(F.collect_set(F.struct(order.alias("o"), F.col("pivot")))), 1, PIVOTS)
        near = rows.groupBy("id").agg(few.alias("p")).select("id", F.explode("p.pivot").alias("pivot"))
        return near.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()

    def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels of components that further links join: what the labels say stands for the links behind them."""
        return saved(components(labels.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(links)), "near-labels")

    links = own.unionByName(verified(stars(member.where("id != low").withColumnRenamed("low", "pivot"), F.col("pivot"))))
    labels = saved(components(links), "near-labels")
    links = own.limit(0)
    for star in range(1, STARS + 1):
        labelled = member.select("band", "id", "w").join(labels, "id", "left").select("band", "id", "w", F.coalesce("comp", "id").alias("comp"))
        split = (
            labelled.groupBy("band", "comp")
            .agg(F.sum("w").alias("n"), F.min_by("id", F.xxhash64("id", F.lit(star))).alias("pivot"))
            .groupBy("band")
            .agg(
                F.max_by(F.struct("comp", "pivot"), F.struct("n", "comp")).alias("main"),
                F.max("n").alias("most"),
                F.sum("n").alias("n"),
            )
            .where("n > most")
            .select("band", "n", (F.col("n") - F.col("most")).alias("asking"), F.col("main.comp").alias("main"), F.col("main.pivot").alias("pivot"))
        )
        open_ = saved(labelled.join(split, "band"), "near-open")
        pairs = saved(stars(open_.where("comp != main"), F.xxhash64("pivot", F.lit(star))), "near-pairs")
        tried, more = pairs.count(), verified(pairs)
        gained = more.count()
        discard(pairs)
        if gained * 20 <= tried:  # labels that miss a few links cost some comparisons below, nothing else
            links = more
            break
        labels = joined(labels, more)
    if tried:
        blocks = open_.withColumns(
            {
                "of": F.ceil(F.col("n") / BLOCK).cast("int"),
                "in": F.ceil(F.col("asking") / BLOCK).cast("int"),
                "h": F.xxhash64("id", F.lit(0)),
            }
        )
        every = F.transform(F.sequence(F.lit(0), F.col("in") - 1), lambda i: F.struct(i.alias("x"), F.pmod("h", F.col("of")).cast("int").alias("y")))
        outer = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda i: F.struct(F.pmod("h", F.col("in")).cast("int").alias("x"), i.alias("y")))
        cells = blocks.select("band", "id", "comp", F.lit(False).alias("asks"), F.explode(every).alias("cell")).unionByName(
            blocks.where("comp != main").select("band", "id", "comp", F.lit(True).alias("asks"), F.explode(outer).alias("cell"))
        )
        parts = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        place = ["band", "x", "y"]
        dealt = cells.select("band", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), "id", "comp", "asks")
        matched = saved(
            dealt.join(known.select("id", "sig"), "id")
            .select(*place, "id", "comp", "asks", "sig")
            .repartition(parts, *place)
            .groupBy(*place)
            .applyInArrow(_matched(bands, rows, percent, miss), "band long, x int, y int, id long, comp long, asks boolean"),
            "near-matched",
        )
        pairs = (
            matched.join(known, "id")
            .repartition(parts, *place)
            .groupBy(*place)
            .applyInArrow(_across(bands, rows, percent, size, miss), "a long, b long")
            .distinct()
        )
        labels = joined(labels, links.unionByName(saved(pairs, "near-links")))
    discard(known, member, open_, mine)
    labelled = classes.select("words", "node", F.col("id").alias("rep")).join(labels.select(F.col("id").alias("node"), "comp"), "node", "left")
    labelled = saved(labelled.select("words", "rep", F.coalesce("comp", "node").alias("comp")), "near-labelled")
    least = labelled.groupBy("comp").agg(F.min("rep").alias("least"))
    named = labelled.join(least, "comp").select("words", F.col("least").alias("comp"))
    out = signed.select("own", "id", "n", "words").join(named, "words", "left")
    comp = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("comp")).otherwise(F.col("id"))
    return out.select(F.col("own").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col).cast("long") == F.col("component_id"), F.lit(True))
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without all but one, of the smallest id, of each group; rows without id stay."""
    gone = near_groups(docs, id_col=id_col, **options).where("NOT kept").select(id_col).distinct()
    return docs.join(saved(gone, "near-gone"), id_col, "left_anti").select(*docs.columns)


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and verdict of every document."""
    return near_groups(documents(spark, sf_dir))


#: By an inverted index of shingles: for tables of a few thousand documents.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT DISTINCT a AS id, a AS other FROM link UNION SELECT id, b FROM reach JOIN link ON a = other),
least AS (SELECT id, min(other) AS m FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, doc_id) AS component_id, doc_id = coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON id = doc_id
"""
