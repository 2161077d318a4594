"""Ranked lexical search: an inverted index in windows of documents, scored window by window in cache-sized arrays."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, saved, small_batches
from .texts import PLAIN, PLAIN_GAP, word_slices

#: Documents of a window (their scores take 64 KB) and postings at which one ends early; results of an item.
WINDOW, POSTINGS, TOP = 8192, 1_000_000, 10
#: Pairs of item and term that one pass broadcasts.
BROADCAST = 500_000
#: Weight of a document's length, in hundredths, and a posting's largest part of the score.
LENGTH, PART = 90, 1_000_000_000

_INDEX = "ids array<{}>, lengths binary, terms binary, ends binary, slots binary, tfs binary"


def index_windows(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bound: int = POSTINGS) -> DataFrame:
    """The inverted index of a vocabulary, in windows of up to `window` consecutive documents of a task with a term of any kind.

    A row is a window: ids (array) and lengths (int64: terms of a document, repeats and terms beyond the vocabulary included) by slot;
    terms (int32, ascending) and ends (int64): term k's postings are slots (uint16, ascending) and tfs (uint32) from ends[k] to
    ends[k + 1]. Long texts are read in slices. A window of over `bound` postings ends early. Documents without terms have no slot.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def flush(ids: list, lengths: list[int], found: list[np.ndarray], tfs: list[np.ndarray], of: pa.DataType) -> pa.RecordBatch:
        slots = np.repeat(np.arange(len(ids), dtype=np.uint16), [len(x) for x in found])
        term, tf = np.concatenate(found), np.concatenate(tfs)
        order = np.argsort(term, kind="stable")
        term, slots, tf = term[order], slots[order], tf[order]
        terms, ends = np.unique(term, return_index=True)
        packed = [np.array(lengths, np.int64), terms.astype(np.int32), np.append(ends, len(term)).astype(np.int64), slots, tf.astype(np.uint32)]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(of)), *[pa.array([x.tobytes()], pa.binary()) for x in packed]],
            ["ids", "lengths", "terms", "ends", "slots", "tfs"],
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, of = held.value.get, None
        ids, lengths, found, tfs, n = [], [], [], [], 0
        for batch in batches:
            of = batch.column("id").type
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                length, hits = 0, []
                for words in word_slices(text.as_py() or b"", PLAIN, PLAIN_GAP):
                    length += len(words)
                    hits += [np.array([t for t in map(number, words) if t is not None], np.int32)]
                if length:
                    terms, tf = np.unique(np.concatenate(hits), return_counts=True)
                    ids.append(id_)
                    lengths.append(length)
                    found.append(terms)
                    tfs.append(tf)
                    n += len(terms)
                    if len(ids) == window or n >= bound:
                        yield flush(ids, lengths, found, tfs, of)
                        ids, lengths, found, tfs, n = [], [], [], [], 0
        if ids:
            yield flush(ids, lengths, found, tfs, of)

    return rows.mapInArrow(build, _INDEX.format(kind))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) with the documents of each term of a task's windows; -1: documents, -2: their lengths."""
    docs, total, count = 0, 0, np.zeros(0, np.int64)
    for batch in batches:
        for lengths, terms, ends in zip(*(batch.column(c) for c in ("lengths", "terms", "ends")), strict=True):
            length, term = np.frombuffer(lengths.as_py(), np.int64), np.frombuffer(terms.as_py(), np.int32)
            docs, total = docs + len(length), total + int(length.sum())
            if len(term) and term[-1] >= len(count):
                count = np.append(count, np.zeros(term[-1] + 1 - len(count), np.int64))
            count[term] += np.diff(np.frombuffer(ends.as_py(), np.int64))
    hit = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append([-1, -2], hit), pa.int64()), pa.array(np.append([docs, total], count[hit]), pa.int64())], ["term", "n"]
    )


class Heap:
    """The `top` highest scores, equal ones by ascending id, null last."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def offer(self, scores: np.ndarray, slots: np.ndarray, ids: list) -> None:
        """Scores over 0 of slots of a window whose documents are ids."""
        least = self.rows[0][0] if len(self.rows) == self.top else 1
        on = np.flatnonzero(scores >= least)
        if len(on) > 4 * self.top:  # the best of the window alone, with all that tie with the last of them
            on = on[scores[on] >= np.partition(scores[on], -self.top)[-self.top]]
        for score, slot in zip(scores[on].tolist(), slots[on].tolist(), strict=True):
            row = (score, _Late(ids[slot]))
            if len(self.rows) < self.top:
                heapq.heappush(self.rows, row)
            elif row > self.rows[0]:
                heapq.heapreplace(self.rows, row)


class _Late:
    """An id that is less the later it comes: descending, null least."""

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other: _Late) -> bool:
        return other.id is not None and (self.id is None or self.id > other.id)

    def __eq__(self, other: object) -> bool:
        return self.id == other.id


def score_windows(index: DataFrame, queries: list[tuple], weights: dict[int, int], n_docs: int, n_terms: int, top: int = TOP, window: int = WINDOW) -> DataFrame:
    """(query, id, score): the `top` of each task for each of `queries`, pairs of a number and its terms' numbers.

    A task goes through its windows. What each posting adds to a score is the same for all queries and is computed once a window. Then a query at a
    time: its terms' postings are scattered into the window's array of scores and their bitsets of slots joined in its occupancy bitset, whose
    slots are harvested into the query's heap and cleared. So the arrays stay in cache and a task gives at most `top` rows a query.
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()
    wanted = np.array(sorted(weights), np.int32)
    weight = np.array([weights[t] for t in wanted.tolist()], np.int64)
    held = index.sparkSession.sparkContext.broadcast((queries, wanted, weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted, weight = held.value
        heaps = [Heap(top) for _ in queries]
        scores, marked, of = np.zeros(window, np.int64), np.zeros(window, np.uint8), None
        occupied = np.packbits(marked)
        for batch in batches:
            of = batch.column("ids").type.value_type
            for row in range(batch.num_rows):
                get = lambda name, kind, row=row, batch=batch: np.frombuffer(batch.column(name)[row].as_py(), kind)
                ids, length = batch.column("ids")[row].as_py(), get("lengths", np.int64)
                terms, ends, slots = get("terms", np.int32), get("ends", np.int64), get("slots", np.uint16)
                tf = get("tfs", np.uint32).astype(np.int64)
                long = 100 - LENGTH + (LENGTH * length * n_docs) // n_terms
                adds = (PART * tf) // (1000 * tf + 8 * long[slots]) * np.repeat(weight[np.searchsorted(wanted, terms)], np.diff(ends))
                place = {t: (a, b) for t, a, b in zip(terms.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
                bits: dict[int, np.ndarray] = {}
                for heap, (_, asked) in zip(heaps, queries, strict=True):
                    for t in asked:
                        if t in place:
                            a, b = place[t]
                            scores[slots[a:b]] += adds[a:b]  # a term's slots are different ones
                            if t not in bits:
                                marked[slots[a:b]] = 1
                                bits[t] = np.packbits(marked)
                                marked[slots[a:b]] = 0
                            occupied |= bits[t]
                    hit = np.flatnonzero(np.unpackbits(occupied))
                    heap.offer(scores[hit], hit, ids)
                    scores[hit] = 0
                    occupied[:] = 0
        out = [(k, late.id, score) for (k, _), heap in zip(queries, heaps, strict=True) for score, late in heap.rows]
        if out:
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), of, pa.int64()), strict=True)], ["query", "id", "score"]
            )

    return index.mapInArrow(search, f"query long, id {kind}, score long")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            terms = list({w for words in word_slices(batch.column("text")[k].as_py() or b"", PLAIN, PLAIN_GAP) for w in words})
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array([k] * len(terms), pa.int64())), pa.array(terms, pa.binary())],
                ["item", "term"],
            )


def term_weights(counts: dict[int, int], n_docs: int) -> dict[int, int]:
    """floor(1000 * ln((2 * N + 2) / (2 * df + 1))) of each term number."""
    return {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in counts.items()}


def ranked(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    window: int = WINDOW,
    bound: int = BROADCAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The `top` documents of each item by the terms they share, weighted by rarity and tempered by length.

    Terms are runs of ASCII letters (lower-cased), digits and anything beyond ASCII, of whole texts. With N documents of a term or more, L terms in all of them, n in
    a document, df documents with a term and tf of it in the document: the weight is w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))),
    m = 10 + (90 * n * N) div L, and the score is the sum of w * ((10**9 * tf) div (1000 * tf + 8 * m)) over an item's terms, once each.

    1. The items' terms are counted. Of up to `bound` pairs of item and term one vocabulary is broadcast; of more, items are dealt into
       slices of about as many, with a pass over the documents each. 2. One pass writes the vocabulary's inverted index in windows of documents.
       3. Its statistics, a number per term of the vocabulary, give the weights. 4. Windows are scored (score_windows), and each task's best meet.

    Returns item_col, rank (int, from 1), id_col, score (long): scores above 0, equal ones by ascending id, null ids last. Null
    or termless texts: in no result. Rows of an equal item id (null is one) are one item with all their terms; each row of documents
    is a document, so a repeated id can come twice. Other columns are ignored, whatever their names. An empty table: no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    named = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    kind = named.schema["item"].dataType.simpleString()
    terms = named.mapInArrow(_item_terms, f"item {kind}, term binary").groupBy("item").agg(F.collect_set("term").alias("terms"))
    asked = saved(terms.withColumn("query", F.monotonically_increasing_id()), "search-items")
    slices = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // bound)
    best = spark.createDataFrame([], f"query long, id {docs.schema[id_col].dataType.simpleString()}, score long")
    for k in range(slices):
        vocabulary: dict[bytes, int] = {}
        part = asked.where(F.pmod(F.xxhash64("query"), F.lit(slices)) == k).collect()
        queries = [(q["query"], [vocabulary.setdefault(bytes(t), len(vocabulary)) for t in q["terms"]]) for q in part]
        index = saved(index_windows(docs, vocabulary, id_col, text_col, window), "search-index")
        sums = index.select("lengths", "terms", "ends").mapInArrow(_statistics, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counts = {r["term"]: r["n"] for r in sums.collect()}
        n_docs, n_terms = counts.pop(-1, 0), counts.pop(-2, 0)
        found = score_windows(index, queries, term_weights(counts, n_docs), n_docs, n_terms, top, window)
        best = best.unionByName(saved(found, "search-best"))
        discard(index)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    first = best.withColumn("rank", place).where(F.col("rank") <= top)
    return first.join(asked.select("query", "item"), "query").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
size AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (
  SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM b) GROUP BY ALL),
weight AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term),
part AS (
  SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS s FROM tf JOIN weight USING (term), size),
score AS (SELECT item_id, rid, doc_id, sum(s)::BIGINT AS score FROM part JOIN b USING (term) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM score) WHERE rank <= 10
"""
