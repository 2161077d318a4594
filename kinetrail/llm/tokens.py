"""Exact token counts; huge documents in overlapping chunks that are spliced at stable boundaries."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, saved, small_batches, without

VOCABULARY = "byte_bpe_50k.json"
#: Code points: longer texts are huge; a chunk's own part; its first overlap with the next one.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 512
LIMIT = 1024
#: Letters in any version of Unicode (ASCII and extended Latin), and a text's pieces: runs of these, of ASCII digits or of ASCII signs, each
#: with a blank before it, single line ends, and what else stands up to the next blank or line end with a visible character behind it.
_L = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
PIECE = re.compile(
    rf" ?[{_L}]++(?![^\x00-\x7F])| ?[0-9]++(?![^\x00-\x7F])| ?[!-&(-/:-@\[-`{{-~]++(?=[{_L}0-9 \n]|\Z)"
    rf"|\n(?=[!-~{_L}])|(?s:.+?)(?=[ \n][!-~{_L}]|\Z)"
)
#: A worker keeps the counts of pieces up to so many characters, and forgets all beyond so many pieces.
KEPT, KNOWN = 64, 1 << 19


@cache
def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


@cache
def _pieced(vocabulary: str) -> bool:
    """Whether PIECE cuts only where the vocabulary's pre-tokenizer does."""
    from tokenizers import models, pre_tokenizers

    own = _tokenizer(vocabulary)
    pre, model = own.pre_tokenizer, own.model
    plain = isinstance(pre, pre_tokenizers.ByteLevel) and pre.use_regex and not pre.add_prefix_space
    return plain and own.normalizer is None and isinstance(model, models.BPE) and not model.dropout


@cache
def _known(vocabulary: str) -> dict[str, int]:
    return {}


def _counts(texts: list[str], vocabulary: str) -> list[int]:
    """Tokens of each text: the library encodes each distinct piece once, as long as the worker knows it.

    Pieces end where the byte-level pre-tokenizer cuts whatever stands around: behind a run of letters, digits or signs (an
    apostrophe may begin a contraction, so it ends none), and before the last of white space that something visible follows.
    Tokens never cross its cuts, so counts add up. A text that holds a special string is one piece.
    """
    encode = lambda x: map(len, _tokenizer(vocabulary).encode_batch_fast(x, add_special_tokens=False))
    if not _pieced(vocabulary):
        return list(encode(texts))
    known, held = _known(vocabulary), _special_strings(vocabulary)
    pieces = [[t] if any(x in t for x in held) else PIECE.findall(t) for t in texts]
    new = list(set().union(*pieces) - known.keys())
    known.update(zip(new, encode(new), strict=True))
    out = [sum(map(known.__getitem__, p)) for p in pieces]
    for p in new:
        if len(p) > KEPT:
            del known[p]
    if len(known) > KNOWN:
        known.clear()
    return out


def count_tokens(texts: list[str], vocabulary: str = VOCABULARY) -> list[int]:
    """Tokens of each text, in batches of about a million characters."""
    out, part, size = [], [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > 1_000_000:
            out += _counts(part, vocabulary)
            part, size = [], 0
    return out + _counts(part, vocabulary)


def count_column(text: Column, vocabulary: str = VOCABULARY) -> Column:
    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(count_tokens([t or "" for t in texts.to_pylist()], vocabulary), pa.int64())

    return count(text)


@cache
def _special_strings(vocabulary: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(vocabulary).get_added_tokens_decoder().values())


@cache
def _special(vocabulary: str) -> tuple[frozenset[str], int, bool]:
    """Characters of the special strings, the length of the longest, whether one is letters alone."""
    held = _special_strings(vocabulary)
    return frozenset("".join(held)), max(map(len, held), default=0), any(t.isalpha() for t in held)


def stable(text: str, low: int, high: int, special: frozenset[str] = frozenset()) -> list[int]:
    """Positions behind a letter, in [low, high), where a byte-level pre-tokenizer always cuts.

    A run of letters ends where something else stands, whatever is further left or right. A blank counts with a letter
    behind it; other characters if they are no mark or apostrophe (some pre-tokenizers join these to letters) and in
    no special string, which could hold the position.
    """
    return [
        p
        for p in range(low + 1, high - 1)
        if text[p - 1].isalpha()
        and (text[p + 1].isalpha() if text[p] == " " else not (text[p].isalpha() or text[p] in "'\u2019" or text[p] in special or unicodedata.category(text[p])[0] == "M"))
    ]


def chunk_tokens(text: str, first: bool, last: bool, overlap: int, vocabulary: str = VOCABULARY) -> tuple[int, int, int, int, int]:
    """One window's share of the tokens, and what proves its seams.

    The window is its own part and `overlap` more characters; the same stretch begins the next window.
    Returns (tokens between the two cuts, distance of the left cut from the window's
    start, digest of the tokens behind it, the same for the right cut, counted
    from the overlap's start). A cut of -1: no stable boundary in the overlap.
    """
    code = _tokenizer(vocabulary).encode(text, add_special_tokens=False)
    ids, offsets = code.ids, code.offsets  # each access makes a new list
    starts = [a for a, _ in offsets]

    def index(at: int) -> int:
        low, high = 0, len(starts)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if starts[mid] < at else (low, mid)
        return low

    held, longest, lettered = _special(vocabulary)

    def seam(begin: int) -> tuple[int, int, int]:
        found = stable(text, begin, begin + overlap, held)
        if len(found) >= 2:  # the stretch between two boundaries is what both windows compare
            a, b = index(found[0]), index(found[-1])
            return found[0] - begin, hash(tuple(ids[a:b])), a
        low, high = begin + overlap // 4, begin + overlap - overlap // 4
        if lettered or high - low <= 2 * longest + 8 or not text[begin : begin + overlap].isalpha():
            return -1, 0, -1
        # One run of letters: merges don't cross a boundary whose two tokens are neighbours in a valid encoding, so the
        # windows splice where both have the same tokens around one.
        inside = [(i, offsets[i]) for i in range(index(low), index(high)) if offsets[i][1] <= high]
        cuts = [i for (_, (_, end)), (i, (start, _)) in zip(inside, inside[1:], strict=False) if end == start]
        if not cuts:
            return -1, 0, -1
        at = cuts[len(cuts) // 2]
        return starts[at] - begin, hash(tuple((ids[i], x - begin, y - begin) for i, (x, y) in inside)), at

    left = (0, 0, 0) if first else seam(0)
    right = (0, 0, len(starts)) if last else seam(len(text) - overlap)
    return right[2] - left[2] if min(left[2], right[2]) >= 0 else 0, *left[:2], *right[:2]


def _windows(limit: int, overlap: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h1, h2, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n = max(1, -(-(len(text) - overlap) // limit))
                for k in range(n):
                    part = text[k * limit : (k + 1) * limit + overlap] if k < n - 1 else text[k * limit :]
                    yield pa.RecordBatch.from_pydict({"h1": [h1], "h2": [h2], "k": [k], "n": [n], "part": [part]}, schema=_CHUNK)

    return cut


_CHUNK = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("part", pa.string())])
_SEAMS = T.StructType([T.StructField(c, T.LongType()) for c in ("tokens", "left", "left_sig", "right", "right_sig")])


def _huge_counts(texts: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """(h1, h2, n_tokens) of distinct huge texts (h1, h2, text)."""

    done: list[DataFrame] = []
    pending = texts
    while True:
        width = overlap

        @F.arrow_udf(_SEAMS)
        def encode(parts: pa.Array, k: pa.Array, n: pa.Array) -> pa.Array:
            rows = [
                chunk_tokens(p, i == 0, i == m - 1, width, vocabulary)
                for p, i, m in zip(parts.to_pylist(), k.to_pylist(), n.to_pylist(), strict=True)
            ]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_SEAMS.names)

        pieces = (
            pending.select("h1", "h2", "text")
            .mapInArrow(_windows(max(chunk, width), width), "h1 long, h2 long, k long, n long, part string")
            .repartition("h1", "h2", "k")
            .select("h1", "h2", "k", "n", encode("part", "k", "n").alias("e"))
            .select("h1", "h2", "k", "n", "e.*")
        )
        agreed = (F.col("k") == 0) | ((F.col("left") >= 0) & (F.col("left") == F.col("r")) & (F.col("left_sig") == F.col("rs")))
        pieces = saved(pieces, "token-chunks")
        seams = pieces.select("h1", "h2", (F.col("k") + 1).alias("k"), F.col("right").alias("r"), F.col("right_sig").alias("rs"))
        counted = saved(
            pieces.join(seams, ["h1", "h2", "k"], "left")
            .groupBy("h1", "h2")
            .agg(F.sum("tokens").alias("n_tokens"), F.bool_and(F.coalesce(agreed, F.lit(False))).alias("ok")),
            "token-counts",
        )
        done.append(counted.where("ok").select("h1", "h2", "n_tokens"))
        failed = counted.where(~F.col("ok")).select("h1", "h2")
        if failed.isEmpty():
            break
        overlap *= 8  # in the end a window holds the whole text, which has no seams
        pending = texts.join(failed, ["h1", "h2"], "left_semi")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def with_token_counts(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    limit: int = LIMIT,
    huge: int = HUGE,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit (n_tokens > limit).

    Texts up to `huge` code points are encoded whole, in Arrow batches. Distinct longer
    ones are cut into windows that overlap and are dealt over all tasks, so
    that no task encodes a huge text alone. Neighbours splice at the first boundary in their overlap
    that no context can move, if both have the same tokens from it to the overlap's
    last such boundary; inside one run of letters, where both have the same tokens in its middle half. Else the text comes again
    with overlaps eight times as wide; in the end it is encoded whole (long runs of one digit or sign).

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows count alike. Columns of the
    names made are replaced, the others (or `keep`) stay. Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    made = ("n_bytes", "n_tokens", "over_limit")
    keep = without(keep or docs.columns, made)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("_kt_text", text)
    long = F.char_length("_kt_text") > huge
    small = rows.where(~long).select(
        *keep, F.octet_length("_kt_text").cast("long").alias("n_bytes"), count_column(F.col("_kt_text"), vocabulary).alias("n_tokens")
    )
    keys = [F.xxhash64("_kt_text").alias("h1"), F.xxhash64(F.lit(1), "_kt_text").alias("h2")]
    large = rows.where(long)
    texts = large.select(*keys, F.col("_kt_text").alias("text")).dropDuplicates(["h1", "h2"])
    counts = _huge_counts(texts, vocabulary, chunk, overlap)
    large = large.select(*keep, F.octet_length("_kt_text").cast("long").alias("n_bytes"), *[k.alias(f"_kt_{i}") for i, k in enumerate(keys)])
    large = large.join(
        counts.select(F.col("h1").alias("_kt_0"), F.col("h2").alias("_kt_1"), "n_tokens"), ["_kt_0", "_kt_1"]
    ).select(*keep, "n_bytes", "n_tokens")
    return small.unionByName(large).withColumn("over_limit", F.col("n_tokens") > limit)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return with_token_counts(documents(spark, sf_dir), keep=["doc_id"])
