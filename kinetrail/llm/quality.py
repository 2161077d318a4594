"""Quality rules that vote, and expectation-maximisation over their votes."""

from __future__ import annotations

import math
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, saved, small_batches, without

SYMBOLS = b"#*$%&|<>"
KEEP, REJECT, ABSTAIN = 1, 0, -1

FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    fresh = counter()
    seq = np.fromiter((ids[w] if w in ids else ids.setdefault(w, next(fresh)) for w in words), np.int64, n)
    size = len(ids)
    pair = seq[:-1] * size + seq[1:]
    if size > 2_000_000:  # three ids no longer fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, place, times = np.unique(pair[:-1] * size + seq[2:], return_inverse=True, return_counts=True)
    twice = times[place] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def text_features(text: bytes) -> tuple[int, ...]:
    words = text.split()
    joined = b"".join(words)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, lines, dup, repeated_words(words)


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in FEATURES]))
def _features(texts: pa.Array) -> pa.Array:
    rows = [text_features(t or b"") for t in texts.to_pylist()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(FEATURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(FEATURES))


def _band(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), ABSTAIN).when(bad, REJECT).when(good, KEEP).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """The rules, each a column that is KEEP, REJECT or ABSTAIN; all look at whole texts."""
    n, lines = F.col("n_words"), F.col("n_lines")
    mean = F.try_divide(F.col("word_chars"), n)
    per_line = F.try_divide(n, lines)
    return {
        "length": _band(n, n < 20, n >= 60),
        "word_length": _band(mean, (mean < 3.5) | (mean > 7.2), mean.between(4.2, 6.4)),
        "symbols": _band(n, F.col("n_symbols") * 10 > n, F.col("n_symbols") * 50 <= n),
        "symbol_share": _band(n, F.col("n_symbols") * 50 > F.col("word_chars"), F.col("n_symbols") * 200 <= F.col("word_chars")),
        "repeats": _band(n, F.col("n_repeat_words") * 100 > n * 30, F.col("n_repeat_words") * 100 <= n * 15),
        "lines": _band(n, F.col("n_dup_lines") * 100 > lines * 40, F.col("n_dup_lines") * 100 <= lines * 15),
        "layout": _band(per_line, (per_line > 250) | (per_line < 3), per_line.between(5, 150)),
    }


def fit_votes(
    votes: np.ndarray,
    times: np.ndarray,
    start: tuple[float, float] = (0.9, 0.4),
    prior: float = 0.85,
    strength: float = 0.002,
    rounds: int = 300,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over distinct vote patterns and how often each occurs.

    Returns each pattern's posterior probability of quality, each rule's two
    accuracies (share of KEEP among good documents' votes, of REJECT among bad
    ones') and the share of good documents. Pseudo-counts, `strength` times the
    documents, keep the accuracies off 0 and 1. They start at `start`: junk of one kind fails
    few rules and passes the others, so REJECT is rare among bad documents too.
    """
    total = float(times.sum())
    first = np.repeat(np.array(start)[:, None], votes.shape[1], axis=1)
    accuracy = first.copy()
    share, posterior = prior, np.full(len(votes), prior)
    if not total:
        return posterior, accuracy, share
    keep, reject, extra = votes == KEEP, votes == REJECT, strength * total
    for _ in range(rounds):
        good = math.log(share) + keep @ np.log(accuracy[0]) + reject @ np.log1p(-accuracy[0])
        bad = math.log1p(-share) + reject @ np.log(accuracy[1]) + keep @ np.log1p(-accuracy[1])
        new = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        g, b = new * times, (1 - new) * times
        accuracy = np.clip(
            [
                (g @ keep + extra * first[0]) / (g @ (keep | reject) + extra),
                (b @ reject + extra * first[1]) / (b @ (keep | reject) + extra),
            ],
            1e-6,
            1 - 1e-6,
        )
        share = float(np.clip((g.sum() + extra * prior) / (total + extra), 1e-6, 1 - 1e-6))
        if np.abs(new - posterior).max() < 1e-9:
            posterior = new
            break
        posterior = new
    return posterior, accuracy, share


def quality(docs: DataFrame, least: float = 0.5, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Features, votes and posterior quality of each document.

    One Arrow pass over whole texts makes the features. They are written to the shared folder once,
    unless `keep` holds the texts: then they are made a second time, which costs less than a copy of the corpus.
    The rules' votes are grouped by pattern; there are at most 3 ** rules patterns,
    whatever the input, and only their counts reach the driver, where the EM runs.

    Returns the columns `keep` (default: all) and n_words, word_chars, n_symbols,
    n_lines, n_dup_lines, n_repeat_words (long), votes (map<string, int>), p_quality
    (double), base_failed, kept (boolean); columns of these names are replaced.
    kept is false where base_failed (under 50 words, or over half of the words in
    repeated 3-word windows), else whether p_quality >= least. Null or empty text:
    all counts 0, base_failed. Repeated rows count and score alike. Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    made = (*FEATURES, "votes", "p_quality", "base_failed", "kept")
    keep = without(keep or docs.columns, made)
    listed = rules()
    code = sum(((v + 1) * 3**i for i, v in enumerate(listed.values())), F.lit(0))
    table = docs.select(*keep, _features(F.col(text_col).cast("binary")).alias("_kt_f")).select(
        *keep, *[F.col(f"_kt_f.{c}").alias(c) for c in FEATURES]
    )
    table = (table if text_col in keep else saved(table, "quality")).withColumn("_kt_code", code)
    seen = {r[0]: r[1] for r in table.groupBy("_kt_code").count().collect()}
    codes = np.arange(3 ** len(listed))
    votes = np.stack([codes // 3**i % 3 - 1 for i in range(len(listed))], axis=1)
    times = np.array([seen.get(int(c), 0) for c in codes], float)
    posterior, _, _ = fit_votes(votes, times)
    score = F.element_at(F.array(*[F.lit(float(p)) for p in posterior]), F.col("_kt_code") + 1)
    n = F.col("n_words")
    return table.select(
        *keep,
        *FEATURES,
        F.create_map(*[x for k, v in listed.items() for x in (F.lit(k), v)]).alias("votes"),
        score.alias("p_quality"),
        ((n < 50) | (F.col("n_repeat_words") * 100 > n * 50)).alias("base_failed"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= least))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document."""
    out = quality(documents(spark, sf_dir), keep=["doc_id"])
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality"
    )
