"""Near-duplicate documents by SimHash: fingerprints, balls of half the radius that meet in the middle, components."""

from __future__ import annotations

import math
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, documents, saved, small_batches
from .components import components, forest
from .texts import SPACED, SPACED_GAP, word_slices

BITS, SHINGLE, SEED = 64, 4, 42
#: Differing bits of a link; half of them is the radius of a ball.
RADIUS = 4
#: Leading bits that name a bucket at first, bits by which a large one is split, and variants of a bucket that is not split.
PREFIX, DEEPER, VARIANTS = 10, 6, 4_000_000


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The bits set in over half of the hashes of all runs of `size` words (fewer words: of all of them); 0 without words."""
    ones, n, tail = np.zeros(BITS, np.int64), 0, []
    for words in word_slices(text, SPACED, SPACED_GAP):
        words = tail + words
        if len(words) >= size:
            ends = list(accumulate(map(len, words), lambda at, w: at + 1 + w))
            starts, joined = [0, *(e + 1 for e in ends)], b" ".join(words)
            hashes = [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)]
            ones += _ones(np.array(hashes, np.uint64))
            n += len(hashes)
            tail = words[-(size - 1) :] if size > 1 else []
        else:
            tail = words
    if not n and tail:
        return xxhash.xxh64_intdigest(b" ".join(tail), seed)
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def _ones(hashes: np.ndarray, part: int = 1 << 14) -> np.ndarray:
    """How many hashes have each bit, the lowest first."""
    total, rows = np.zeros(BITS, np.int64), hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(rows), part):
        total += np.unpackbits(rows[at : at + part], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def _fingerprints(text: Column, size: int, seed: int) -> Column:
    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t or b"", size, seed) for t in texts.to_pylist()]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return of(text.cast("binary"))


@cache
def masks(low: int, high: int, radius: int) -> np.ndarray:
    """All words of 64 bits with at most `radius` bits set, all of them from bit `low` to below bit `high`; by number of bits."""
    bits = [1 << k for k in range(low, high)]
    return np.array([sum(c) for k in range(radius + 1) for c in combinations(bits, k)], np.uint64)


def _ball(bits: int, radius: int) -> int:
    return sum(math.comb(bits, k) for k in range(radius + 1))


def _spread(rows: DataFrame, depth: int, deeper: int, most: int) -> DataFrame:
    """Each row (at, left, rep) once for every change of at most `left` (`most` at most) of the `deeper` bits behind the first `depth`.

    at: the fingerprint with the changes so far; left: changes that remain; bucket: the first depth + deeper bits.
    """
    low = BITS - depth - deeper
    changes = masks(low, BITS - depth, min(most, deeper)).view(np.int64).tolist()
    literal = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit((m % (1 << BITS)).bit_count()).alias("k")) for m in changes])
    changed = rows.select("at", "left", "rep", F.explode(literal).alias("c")).where("c.k <= left")
    at = F.col("at").bitwiseXOR(F.col("c.m"))
    return changed.select(F.shiftrightunsigned(at, low).alias("bucket"), at.alias("at"), (F.col("left") - F.col("c.k")).alias("left"), "rep")


def _variants(depth: int, most: int) -> Column:
    """Variants that a row still stands for behind the first `depth` bits."""
    out = F.lit(1)
    for k in range(1, most + 1):
        out = F.when(F.col("left") == k, _ball(BITS - depth, k)).otherwise(out)
    return out


def star_edges(at: np.ndarray, left: np.ndarray, rep: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (rep, rep) that link all fingerprints sharing a variant of their last `bits` bits, not more than they are."""
    variants, owners = [], []
    for k in np.unique(left).tolist():
        of = np.flatnonzero(left == k)
        change = masks(0, bits, min(k, bits))
        variants.append((at[of, None] ^ change).ravel())
        owners.append(np.repeat(of.astype(np.int32), len(change)))
    key, own = np.concatenate(variants), np.concatenate(owners)
    del variants, owners
    # most variants stand alone and needn't be sorted: those that share some bits of a hash with another one stay
    width = min(23, max(10, len(key).bit_length() + 2))
    slot, place = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(BITS - width), np.arange(len(key), dtype=np.int32)
    last, several = np.empty(1 << width, np.int32), np.zeros(1 << width, bool)
    last[slot] = place
    several[slot[last[slot] != place]] = True
    stay = np.flatnonzero(several[slot])
    key, own = key[stay], own[stay]
    del last, several, slot, place, stay
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    opens = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
    first = own[opens][np.cumsum(opens) - 1]
    pair = np.unique((first[~opens].astype(np.int64) << 32) | own[~opens])
    return forest(rep[pair >> 32], rep[pair & 0xFFFFFFFF])


def _bucket_links(depth: int):
    bits = BITS - depth

    def links(key: tuple, block: pa.Table) -> pa.Table:
        at = block.column("at").to_numpy().view(np.uint64)
        left, rep = block.column("left").to_numpy(), block.column("rep").to_numpy()
        a, b = star_edges(at, left, rep, bits) if len(at) > 1 else (rep[:0], rep[:0])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def ball_links(prints: DataFrame, radius: int = RADIUS, prefix: int = PREFIX, deeper: int = DEEPER, bound: int = VARIANTS) -> DataFrame:
    """(a, b): links of `rep`s that join all rows of prints (fp long, rep long; fp distinct) within `radius` differing bits, and no others.

    Two words differ in at most `radius` (even) bits just if the balls of half the radius around them share a variant:
    change half of the differing bits. So every fingerprint emits its ball, and those that meet at a variant are linked: any two of them
    are within the radius, so a star to the first holds all the links of a variant without its pairs, and no verification can fail.

    The ball is emitted in two steps: variants are dealt by their first `prefix` bits, and until it is there, the part of a
    ball behind one such prefix travels as one row: the changed fingerprint and the changes it has left. A task spells
    out, sorts and links the variants of a bucket. Buckets of over `bound` variants, as around a large group of near copies, are split by
    `deeper` more bits, again and again: at all 64 bits a bucket is one variant, which a ball's number of fingerprints (2,081 at 2 of 64) can share.
    """
    half, spark = radius // 2, prints.sparkSession
    n, parts = prints.count(), max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    depth = prefix  # more where the buckets would be too large for their mean already
    while depth < 40 and n * _ball(BITS, half) > (bound << depth) // 4:
        depth += 1
    rows = prints.select(F.col("fp").alias("at"), F.lit(half).alias("left"), "rep")
    rows, found = _spread(rows, 0, depth, half), None
    while True:
        here, split = rows, False
        if depth < BITS:
            sizes = rows.groupBy("bucket").agg(F.sum(_variants(depth, half).cast("long")).alias("n"))
            large = saved(sizes.where(F.col("n") > bound).select("bucket"), "sim-large")
            if split := not large.isEmpty():
                here = rows.join(large, "bucket", "left_anti")
        links = here.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_bucket_links(depth), "a long, b long")
        links = saved(links, "sim-links")
        found = links if found is None else found.unionByName(links)
        if not split:
            return found
        deep, step = saved(rows.join(large, "bucket", "left_semi"), "sim-deep"), min(deeper, BITS - depth)
        rows, depth = _spread(deep, depth, step, half), depth + step


def simhash_groups(
    docs: DataFrame,
    radius: int = RADIUS,
    size: int = SHINGLE,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    **options,
) -> DataFrame:
    """Groups of documents whose fingerprints are linked by at most `radius` (even) differing bits.

    1. One Arrow pass over whole texts makes fingerprints: a bit is set if over half the XXH64 hashes of all `size`-word
       shingles (lower-cased A-Z, repeats included, fewer words: all of them) have it. 2. Documents of equal fingerprints are a class, which its
       smallest id stands for from here on. 3. Balls of half the radius meet in the middle (ball_links). 4. Links become components.

    Returns one row per input row: id_col, fingerprint (16 lower-case hex digits), component_id (long). Null, empty or blank
    texts: fingerprint zero, linked like any other. A null id is linked with nothing: component_id null. Rows of an equal id are one
    document: its fingerprints are in one component. Other columns are ignored. Empty table: no rows. Ids must cast to long.
    """
    if radius % 2 or not 0 <= radius <= 8:
        raise ValueError("radius must be even, 8 at most")
    small_batches(docs.sparkSession)
    signed = saved(docs.select(F.col(id_col).alias("own"), _fingerprints(F.col(text_col), size, seed).alias("fp")), "sim-signed")
    usable = signed.where("own IS NOT NULL").select(F.col("own").cast("long").alias("id"), "fp")
    prints = saved(usable.groupBy("fp").agg(F.min("id").alias("rep")), "sim-prints")
    links = ball_links(prints, radius, **options)
    several = usable.groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low != high").select("id")
    own = usable.join(several, "id", "left_semi").join(prints, "fp").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    labels = saved(components(links.unionByName(own)), "sim-labels")
    named = saved(prints.join(labels, F.col("id") == F.col("rep"), "left").select("fp", F.coalesce("comp", "rep").alias("comp")), "sim-named")
    discard(prints, labels)
    comp = F.when(F.col("own").isNotNull(), F.col("comp")).alias("component_id")
    return signed.join(named, "fp", "left").select(F.col("own").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), comp)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_groups(documents(spark, sf_dir))


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_TWO64 = 1 << 64


def _wide(v: int) -> str:
    return f"{v % _TWO64}::UHUGEINT"


def _times(a: str, p: int) -> str:
    return f"(({a}) * {_wide(p)} % {_TWO64}::UHUGEINT)"


def _turned(a: str, r: int) -> str:
    return f"(({a}) * {_wide(1 << r)} % {_TWO64}::UHUGEINT + ({a}) // {_wide(1 << (64 - r))})"


def _plus(*terms: str) -> str:
    return f"(({' + '.join(terms)}) % {_TWO64}::UHUGEINT)"


def _lane(offset: str, size: int = 8) -> str:
    """The number that `size` bytes of the hexadecimal text x make from a byte on, the lowest first."""
    digits = " || ".join(f"substr(x, 2 * ({offset} + {k}) + 1, 2)" for k in reversed(range(size)))
    return f"('0x' || {digits})::UBIGINT::UHUGEINT"


def _xxh64_sql() -> str:
    """Common tables from `x0` (s: a text, x: its bytes as hexadecimal text, n: their number) to `xh` (s, h: XXH64 with SEED)."""
    stripe = "{" + ", ".join(f"'{c}': {_lane(f'32 * i + {8 * k}')}" for k, c in enumerate("abcd")) + "}"
    first = dict(zip("abcd", (SEED + _P1 + _P2, SEED + _P2, SEED, SEED - _P1), strict=True))
    start = "{" + ", ".join(f"'{c}': {_wide(v)}" for c, v in first.items()) + "}"
    mixed = lambda at, lane: _times(_turned(_plus(at, _times(lane, _P2)), 31), _P1)
    fold = "{" + ", ".join(f"'{c}': {mixed(f'held.{c}', f'lanes.{c}')}" for c in "abcd") + "}"
    steps = [
        f"x1 AS (SELECT *, list_reduce(list_prepend({start}, list_transform(range(n // 32), lambda i: {stripe})), lambda held, lanes: {fold}) AS v FROM x0)",
        f"x2 AS (SELECT *, {_plus(*[_turned(f'v.{c}', r) for c, r in zip('abcd', (1, 7, 12, 18), strict=True)])} AS m FROM x1)",
    ]
    for k, c in enumerate("abcd"):
        steps.append(f"x{3 + k} AS (SELECT * REPLACE ({_plus(_times(f'xor(m, {mixed(_wide(0), f"v.{c}")})', _P1), _wide(_P4))} AS m) FROM x{2 + k})")
    tail = "(n // 32 * 32)"
    eight = _plus(_times(_turned(f"xor(a, {mixed(_wide(0), 'b')})", 27), _P1), _wide(_P4))
    four = _plus(_times(_turned(f"xor(h, {_times(_lane('(n // 8 * 8)', 4), _P1)})", 23), _P2), _wide(_P3))
    one = _times(_turned(f"xor(a, {_times('b', _P5)})", 11), _P1)
    steps += [
        f"x7 AS (SELECT *, {_plus(f'CASE WHEN n >= 32 THEN m ELSE {_wide(SEED + _P5)} END', 'n::UHUGEINT')} AS h FROM x6)",
        f"x8 AS (SELECT * REPLACE (list_reduce(list_prepend(h, list_transform(range((n - {tail}) // 8), lambda i: {_lane(f'{tail} + 8 * i')})), lambda a, b: {eight}) AS h) FROM x7)",
        f"x9 AS (SELECT * REPLACE (CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h) FROM x8)",
        f"x10 AS (SELECT * REPLACE (list_reduce(list_prepend(h, list_transform(range(n - n % 4, n), lambda i: {_lane('i', 1)})), lambda a, b: {one}) AS h) FROM x9)",
        f"x11 AS (SELECT * REPLACE ({_times(f'xor(h, h // {_wide(1 << 33)})', _P2)} AS h) FROM x10)",
        f"x12 AS (SELECT * REPLACE ({_times(f'xor(h, h // {_wide(1 << 29)})', _P3)} AS h) FROM x11)",
        f"xh AS (SELECT s, xor(h, h // {_wide(1 << 32)})::UBIGINT AS h FROM x12)",
    ]
    return ",\n".join(steps)


#: XXH64 in numbers of 128 bits, all pairs of fingerprints: for tables of a few thousand documents.
OP12_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
sh AS (SELECT rid, array_to_string(words[i:i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT rid, words, unnest(range(1, greatest(len(words) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
x0 AS (SELECT s, hex(encode(s)) AS x, strlen(s) AS n FROM (SELECT DISTINCT s FROM sh)),
{_xxh64_sql()},
ones AS (SELECT rid, count(*) AS n, {", ".join(f"sum((h >> {k}) & 1) AS b{k}" for k in range(BITS))} FROM sh JOIN xh USING (s) GROUP BY rid),
fp AS (SELECT doc_id, coalesce({" + ".join(f"(2 * b{k} > n)::UHUGEINT * {_wide(1 << k)}" for k in range(BITS))}, 0)::UBIGINT AS f FROM w LEFT JOIN ones USING (rid)),
fs AS (SELECT f, min(doc_id) AS id FROM fp GROUP BY f),
link AS (SELECT a.id AS a, b.id AS b FROM fs a JOIN fs b ON a.id <> b.id AND bit_count(xor(a.f, b.f)) <= {RADIUS}),
reach AS (SELECT DISTINCT a AS id, a AS other FROM link UNION SELECT reach.id, b FROM reach JOIN link ON a = other),
least AS (SELECT id, min(other) AS m FROM reach GROUP BY id)
SELECT doc_id, lower(lpad(to_hex(f), 16, '0')) AS fingerprint, coalesce(m, fs.id) AS component_id
FROM fp JOIN fs USING (f) LEFT JOIN least ON least.id = fs.id
"""
