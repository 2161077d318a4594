"""Removal of long byte strings that occur more than once, by suffixes sampled with a content-defined cover."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, documents, saved, small_batches, without
from .shingles import scramble

#: Bytes of a repeat; bytes of the samples' names; windows of a piece of text.
LENGTH, NAME, PIECE = 200, 100, 1 << 18
#: Bits of a filter of names, as a power of two: the least and the most (16 MB), and how many there are for a name up to the most.
LEAST_BITS, MOST_BITS, BITS_A_NAME = 20, 27, 8
#: Samples of one name that one task compares; the windows around a name with more are dealt by themselves.
HOT = 10_000
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 20) - 1)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


_VALUES = scramble(np.arange(1, 257, dtype=np.uint64))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every stretch of `width` bytes."""
    n = len(data)
    up, down = _powers(1 << max(19, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
    return scramble((sums[width:] - sums[:-width]) * down[: n - width + 1])


def samples(data: np.ndarray, length: int = LENGTH, name: int = NAME) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sampled position of every window, as runs of windows that share one.

    A window is `length` bytes. Its sample is the position of the least hash among its
    stretches of `name` bytes, the last of equal ones: equal windows have it at the
    same offset, wherever they stand. Returns each run's first and last window, sample and name.
    """
    hashes = rolling(data, name)
    span = length - name + 1
    keys = (hashes & ~_PLACE) | (_PLACE - np.arange(len(hashes), dtype=np.uint64))
    blocks = np.concatenate([keys, np.full(-len(keys) % span, ~np.uint64(0))]).reshape(-1, span)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - span + 1
    place = (_PLACE - (np.minimum(back[:n], fore[span - 1 : span - 1 + n]) & _PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return first, last, place[first], hashes[place[first]].view(np.int64)


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of a text whose windows together are all its windows, each once."""
    for at in range(0, len(text) - length + 1, PIECE):
        yield at, np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - at), at)


def _names(length: int, name: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                samples(data, length, name)[3] for text in batch.column(0).to_pylist() for _, data in _pieces(text, length)
            ]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["name"])

    return run


_CONTEXT = pa.schema(
    [("name", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("offset", pa.int64()), ("context", pa.binary())]
)


def _held(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether a filter holds each name: its length says how many low bits of a name count."""
    bit = names & (8 * len(bitmap) - 1)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _contexts(length: int, name: int, held, without=None):
    """For each sample whose name is in a filter, and not in another: where its windows start, and the bytes they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, hot = np.frombuffer(held.value, np.uint8), None if without is None else np.frombuffer(without.value, np.uint8)
        for batch in batches:
            ids, hashes, texts = (batch.column(k) for k in range(3))
            for i, text in enumerate(texts.to_pylist()):
                for at, data in _pieces(text, length):
                    first, last, place, names = samples(data, length, name)
                    on = np.flatnonzero(_held(often, names) if hot is None else _held(often, names) & ~_held(hot, names))
                    if len(on):
                        raw = [text[at + a : at + b] for a, b in zip(first[on].tolist(), (last[on] + length).tolist(), strict=True)]
                        pick = pa.array(np.full(len(on), i))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(names[on]),
                                ids.take(pick),
                                hashes.take(pick),
                                pa.array(first[on] + at),
                                pa.array(place[on] - first[on]),
                                pa.array(raw, pa.binary()),
                            ],
                            schema=_CONTEXT,
                        )

    return run


#: Contexts whose windows are hashed at a time.
SLICE = 1000


def _window_keys(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, row and place in the row of every window; a slice's bytes and hashes are gone before the next."""
    names = rows.column("name").to_numpy().astype(np.int64).view(np.uint64)
    offsets = rows.column("offset").to_numpy()
    keys, owners, steps = [], [], []
    for at in range(0, rows.num_rows, SLICE):
        raw = rows.column("context").slice(at, SLICE).to_pylist()
        sizes = np.array([len(x) for x in raw])
        starts = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        owner = np.repeat(np.arange(len(raw)), count)
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        windows = rolling(np.frombuffer(b"".join(raw), np.uint8), length)[starts[owner] + step]
        owner += at
        keys.append(scramble(windows ^ scramble(names[owner] + (offsets[owner] - step).astype(np.uint64))))
        owners.append(owner.astype(np.int32))
        steps.append(step.astype(np.int32))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(steps)


def _same_bytes(raw: list[bytes], owner: np.ndarray, step: np.ndarray, former: np.ndarray, later: np.ndarray, length: int) -> bool:
    """Whether the windows of equal keys, former[i] and later[i], are equal bytes; windows in a row are compared at once."""
    if not len(later):
        return True
    by = np.argsort(later)
    former, later = former[by], later[by]
    breaks = (np.diff(later) != 1) | (np.diff(former) != 1) | (np.diff(owner[later]) != 0) | (np.diff(owner[former]) != 0)
    first = np.flatnonzero(np.concatenate([[True], breaks]))
    last = np.concatenate([first[1:] - 1, [len(later) - 1]])
    size = (step[later[last]] - step[later[first]] + length).tolist()
    one, other = later[first], former[first]
    return all(
        raw[i][a : a + n] == raw[j][b : b + n]
        for i, a, j, b, n in zip(owner[one].tolist(), step[one].tolist(), owner[other].tolist(), step[other].tolist(), size, strict=True)
    )


def repeated(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Stretches (id, row, begin, end) that windows found twice cover, of whole groups of one name.

    Windows are sorted by a 64-bit key, and neighbours of equal keys compared byte by byte; should any differ, all
    of these rows' windows are counted as bytes.
    """
    keys, owner, step = _window_keys(rows, length)
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    former, later = order[same], order[same + 1]
    raw = rows.column("context").to_pylist()
    if _same_bytes(raw, owner, step, former, later, length):
        twice = np.zeros(len(order), bool)
        twice[former] = True
        twice[later] = True
    else:
        windows = [raw[i][a : a + length] for i, a in zip(owner.tolist(), step.tolist(), strict=True)]
        seen = Counter(windows)
        twice = np.array([seen[w] > 1 for w in windows])
    begin, end = _runs_of(twice, step == 0)
    at = rows.column("start").to_numpy()
    take = pa.array(owner[begin])
    return pa.RecordBatch.from_arrays(
        [
            pc.take(rows.column("id").combine_chunks(), take),
            pc.take(rows.column("row").combine_chunks(), take),
            pa.array(at[owner[begin]] + step[begin]),
            pa.array(at[owner[end]] + step[end] + length),
        ],
        ["id", "row", "begin", "end"],
    )


_WINDOW = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "id", "row", "begin", "end")] + [("window", pa.binary()), ("done", pa.bool_())])
#: A window's name on the way to its equals; what is equal is decided by bytes.
_digest = xxhash.xxh3_128_digest


def _runs_of(marked: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of marked windows; a fresh window begins another context."""
    begin = np.flatnonzero(marked & (fresh | ~np.concatenate([[False], marked[:-1]])))
    end = np.flatnonzero(marked & (np.concatenate([fresh[1:], [True]]) | ~np.concatenate([marked[1:], [False]])))
    return begin, end


def _hot_rows(ids: pa.Array, places: np.ndarray, raw: list[bytes], length: int) -> pa.RecordBatch:
    """The windows of some contexts (row and start are `places`), those that are equal combined.

    A window found once is a row with 128 bits of its bytes' hash, the bytes, and its place. Of windows found several times one row goes on,
    without a place; their places are done, as stretches. Windows are equal if their bytes are.
    """
    sizes = np.array([len(x) for x in raw])
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(raw)), count)
    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    digests = b"".join([_digest(raw[i][a : a + length]) for i, a in zip(owner.tolist(), step.tolist(), strict=True)])
    w1, w2 = np.frombuffer(digests, np.int64).reshape(-1, 2).T
    order = np.lexsort((w2, w1))
    same = (w1[order[1:]] == w1[order[:-1]]) & (w2[order[1:]] == w2[order[:-1]])
    if not _same_bytes(raw, owner, step, order[:-1][same], order[1:][same], length):  # hashes met that bytes don't
        windows = [raw[i][a : a + length] for i, a in zip(owner.tolist(), step.tolist(), strict=True)]
        order = np.array(sorted(range(len(order)), key=lambda k: (w1[k], w2[k], windows[k])))
        same = np.array([windows[j] == windows[i] for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)], bool)
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    one = np.flatnonzero(~twice)
    group = order[:-1][same & ~np.concatenate([[False], same[:-1]])]
    row, start = places[:, 0], places[:, 1]
    begin, end = _runs_of(twice, step == 0)
    # contexts of a text follow each other: stretches that touch become one
    a, b = start[owner[begin]] + step[begin], start[owner[end]] + step[end] + length
    text = row[owner[begin]]
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (a[1:] <= a[:-1]) | (a[1:] > b[:-1])
    begin, b = begin[fresh], b[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(b) - 1]])] if len(b) else b
    at = np.concatenate([one, group, begin])
    done = np.arange(len(at)) >= len(one) + len(group)
    ghost = (np.arange(len(at)) >= len(one)) & ~done
    first = start[owner[at]] + step[at]
    last = first + length
    last[done] = b
    sent = [b"" if d else raw[i][a : a + length] for i, a, d in zip(owner[at].tolist(), step[at].tolist(), done.tolist(), strict=True)]
    spread = scramble((row[owner[at]] ^ first).view(np.uint64)).view(np.int64)  # places that are done go anywhere
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(done, spread, w1[at])),
            pa.array(np.where(done, 0, w2[at])),
            pc.take(ids, pa.array(owner[at])),
            pa.array(row[owner[at]]),
            pa.array(np.where(ghost, -1, first)),
            pa.array(np.where(ghost, -1, last)),
            pa.array(sent, pa.binary()),
            pa.array(done),
        ],
        schema=_WINDOW,
    )


def _hot_windows(length: int, most: int):
    """Rows of _hot_rows, from up to `most` contexts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def rows() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            places = np.stack([table.column(c).to_numpy() for c in ("row", "start")], axis=1)
            return _hot_rows(table.column("id").combine_chunks(), places, table.column("context").to_pylist(), length)

        for batch in batches:
            waiting.append(batch)
            n += len(batch)
            if n >= most:
                yield rows()
                waiting, n = [], 0
        if n:
            yield rows()

    return run


def _hot_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of windows found twice, and those done, from rows sorted by window, hash and bytes; one row of the last window is carried over."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not table.num_rows:
            continue
        begin, done, window = table.column("begin").to_numpy(), table.column("done").to_numpy(), table.column("window").combine_chunks()
        same = pc.equal(window.slice(1), window.slice(0, len(window) - 1)).to_numpy(zero_copy_only=False) & ~done[1:] & ~done[:-1]
        out = done.copy()
        out[1:] |= same
        out[:-1] |= same
        yield from table.filter(pa.array(out & (begin >= 0))).select(["id", "row", "begin", "end"]).to_batches()
        k = len(out) - 1
        tail = table.slice(k, 1)
        if done[k]:
            held = None
        else:
            if out[k]:  # its place is out already; the window itself stays
                tail = tail.set_column(4, "begin", pa.array([-1], pa.int64()))
            held = tail.to_batches()[0]


def _compare(length: int, least: int = 3000):
    """Works through groups sorted by name, several whole ones at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            names = batch.column(0).to_numpy()
            cut = int(np.searchsorted(names, names[-1])) if len(names) else 0
            if n >= least and (cut or names[0] != waiting[-1].column(0)[-1].as_py()):
                yield repeated(pa.Table.from_batches([*waiting, batch.slice(0, cut)]), length)
                waiting, n, batch = [], 0, batch.slice(cut)
            waiting.append(batch)
            n += len(batch)
        if n:
            yield repeated(pa.Table.from_batches(waiting), length)

    return run


_CUT = T.StructType(
    [T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]
)


def _cut(text: Column, runs: Column) -> Column:
    @F.arrow_udf(_CUT)
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        removed, counts, kept = [], [], []
        for t, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            out, at, n = [], 0, 0
            for a, b in sorted((x["begin"], x["end"]) for x in found or ()):
                if a > at or not n:
                    out.append(t[at:a])
                    n += 1
                at = max(at, b)
            left = b"".join([*out, t[at:]]) if n else t
            removed.append(len(t) - len(left) if n else 0)
            counts.append(n)
            kept.append(left)
        return pa.StructArray.from_arrays(
            [pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary())], names=_CUT.names
        )

    return cut(text, runs)


def _filter(names: DataFrame):
    """A broadcast filter with a name's low bits set: BITS_A_NAME bits a name and more, 2**MOST_BITS (16 MB) at most, whatever the input.

    Up to 16 million names one other name in eight passes at most; beyond, more pass, and a full filter lets all pass: then
    contexts that stand alone travel too, and are found to be alone where they meet.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_NAME * names.count() - 1).bit_length()))
    bit = F.col("name").bitwiseAND(F.lit((1 << bits) - 1)) + 1  # Spark's bitmaps count from 1
    filled = (
        names.select(bit.alias("bit"))
        .groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bitmap"))
        .collect()
    )
    out = bytearray(max(4096, (1 << bits) // 8))
    for bucket, bitmap in filled:
        out[(bucket - 1) * 4096 : bucket * 4096] = bytes(bitmap)
    return names.sparkSession.sparkContext.broadcast(bytes(out))


def drop_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    name: int = NAME,
    most: int = HOT,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Remove every byte that a string of `length` bytes covers which starts anywhere else too.

    Suffixes of all texts are sampled at content-defined positions that cover every window of `length` bytes,
    and named by a hash of the `name` bytes that stand there. Names are counted over all
    samples; those found twice set bits in a filter whose size is that of their count, and bounded. What passes is dealt by name, and each window is placed
    by its sample's name and its offset from it, so that equal windows meet; sorting them and comparing neighbours, by key and then by bytes,
    tells which occur twice. A name with over `most` samples is hot: its windows are dealt by 128 bits of their own bytes' hash,
    with the bytes, and equal ones combined before they are, so that no task holds all of a name; bytes decide there, too. Their stretches go back to
    their texts. Windows never cross documents.

    Returns the columns `keep` (default: all) and n_bytes, n_removed, n_spans (long; maximal removed runs), kept (binary: the
    rest may end within a character); such columns, in either case, are replaced. Null or empty text: 0 bytes, empty rest. Repeated
    rows are documents that repeat each other. Empty table: no rows. Ids must be long; null ids are allowed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made = ("n_bytes", "n_removed", "n_spans", "kept")
    keep = without(keep or docs.columns, made)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    long = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text")).where(
        F.octet_length("text") >= length
    )
    names = long.select("text").mapInArrow(_names(length, name), "name long")
    twice = saved(names.groupBy("name").count().where("count > 1"), "repeats-names")
    crowded = twice.where(F.col("count") > most)
    often, hot = _filter(twice), None if crowded.isEmpty() else _filter(crowded)
    context = "name long, id long, row long, start long, offset long, context binary"
    found = (
        long.mapInArrow(_contexts(length, name, often, hot), context)
        .repartition("name")
        .sortWithinPartitions("name")
        .mapInArrow(_compare(length), "id long, row long, begin long, end long")
    )
    if hot is not None:
        windows = long.mapInArrow(_contexts(length, name, hot), context).mapInArrow(
            _hot_windows(length, most), "w1 long, w2 long, id long, row long, begin long, end long, window binary, done boolean"
        )
        found = found.unionByName(
            windows.repartition("w1").sortWithinPartitions("w1", "w2", "window").mapInArrow(_hot_found, "id long, row long, begin long, end long")
        )
    discard(twice)
    runs = saved(
        found.groupBy("id", "row").agg(F.collect_set(F.struct("begin", "end")).alias("_kt_runs")).select(
            F.col("id").alias("_kt_id"), F.col("row").alias("_kt_row"), "_kt_runs"
        ),
        "repeats",
    )
    rows = docs.select(*keep, F.col(id_col).cast("long").alias("_kt_own"), text.alias("_kt_text")).withColumn(
        "_kt_hash", F.xxhash64("_kt_text")
    )
    joined = rows.join(runs, F.col("_kt_own").eqNullSafe(F.col("_kt_id")) & (F.col("_kt_hash") == F.col("_kt_row")), "left")
    some = F.col("_kt_runs").isNotNull()
    cut = joined.withColumn("_kt_cut", _cut(F.when(some, F.col("_kt_text")).otherwise(F.lit(b"")), F.col("_kt_runs")))
    return cut.select(
        *keep,
        F.octet_length("_kt_text").cast("long").alias("n_bytes"),
        F.col("_kt_cut.n_removed").alias("n_removed"),
        F.col("_kt_cut.n_spans").alias("n_spans"),
        F.when(some, F.col("_kt_cut.kept")).otherwise(F.col("_kt_text")).alias("kept"),
    )


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that occur again."""
    out = drop_repeats(documents(spark, sf_dir), keep=["doc_id"])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window, in pieces of 4096 bytes: for tables of a few megabytes.
OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (
  SELECT doc_id, c, substring(h, 2 * c + 1, 8590) AS h
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2, 4096)) AS c FROM d)),
spot AS (
  SELECT doc_id, c + o AS p, md5_number(substring(h, 2 * o + 1, 400)) AS k
  FROM (SELECT doc_id, c, h, unnest(range(0, least(len(h) // 2 - 199, 4096))) AS o FROM piece)),
hit AS (SELECT doc_id, p FROM spot JOIN (SELECT k FROM spot GROUP BY k HAVING count(*) > 1) USING (k)),
edge AS (SELECT *, p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 200 AS fresh FROM hit),
run AS (SELECT *, sum(fresh::int) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM edge),
span AS (SELECT doc_id, min(p) AS b, max(p) + 200 AS e FROM run GROUP BY doc_id, r),
gap AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM span),
cut AS (
  SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last,
    string_agg(substring(h, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS kept
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""
