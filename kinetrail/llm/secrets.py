"""Secret scans: trigram inverted indexes, Boolean trigram queries, verified candidates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

#: Bytes of text that one index segment covers at most (a longer text is its own segment).
SEGMENT = 4_000_000


@dataclass(frozen=True)
class Rule:
    """A pattern over UTF-8 bytes; a match counts if its group has `least` bytes."""

    kind: str
    pattern: bytes
    any_case: bool = False
    group: int = 0
    least: int = 1


#: The first three are the base kinds. Runs of one class are maximal, so `{n,}` finds just the runs of n and more.
RULES = (
    Rule(
        "assign",
        rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        any_case=True,
        group=2,
        least=6,
    ),
    Rule("access", rb"AKIA[A-Z0-9]{16,}"),
    Rule("hex", rb"[0-9a-f]{24,}"),
    Rule("forge", rb"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", rb"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("chat", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map", rb"AIza[0-9A-Za-z_-]{35}"),
)

#: A Boolean query: None (anything), a trigram, or ("and" | "or", queries).
Query = None | bytes | tuple


def _join(op: str, parts: Sequence[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if op == "or" and None in parts:
        return None
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else (op, *parts)


def _of_strings(strings: set[bytes]) -> Query:
    """Any of the strings: for each, all its trigrams."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(items: Sequence) -> tuple[set[bytes] | None, Query]:
    """The exact strings of a parsed sequence if they are few, and its query."""
    run, whole, query = {b""}, True, []

    def flush() -> None:
        nonlocal run, whole
        query.append(_of_strings(run))
        run, whole = {b""}, False

    for op, arg in items:
        strings: set[bytes] | None = None
        inner: Query = None
        if op is sre.LITERAL and arg < 128:
            strings = {bytes([arg]).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 6:
            strings = {bytes([a]).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            strings, inner = _walk(arg[-1])
        elif op is sre.BRANCH:
            both = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in both):
                strings = set().union(*(s for s, _ in both))
            else:
                inner = _join("or", [q for _, q in both])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            exact, sub = _walk(body)
            if exact is not None and (low, high) == (0, 1):
                strings = exact | {b""}
            elif low:
                inner = _of_strings(exact) if exact is not None else sub
        if strings is not None and len(run) * len(strings) <= 256:
            run = {a + b for a in run for b in strings}
            continue
        flush()
        query.append(_of_strings(strings) if strings is not None else inner)
    if whole:
        return run, _of_strings(run)
    query.append(_of_strings(run))
    return None, _join("and", query)


def trigram_query(pattern: bytes) -> Query:
    """What any match's lower-cased text must hold; None if the pattern mandates nothing."""
    return _walk(sre_parse.parse(pattern))[1]


def _trigrams(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1:]))


class Segment:
    """Inverted index of some texts over the trigrams that the rules ask for."""

    def __init__(self, texts: Sequence[bytes], wanted: np.ndarray):
        self.n, found, place = len(texts), [], []
        whole = b"\0\0\0".join(texts).lower()
        ends = np.cumsum([len(t) + 3 for t in texts])
        for at in range(0, len(whole), 1 << 20):  # bounds the arrays of a long text
            raw = np.frombuffer(whole[at : at + (1 << 20) + 2], np.uint8).astype(np.int32)
            if len(raw) > 2:
                grams = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
                hits = np.flatnonzero(wanted[grams])
                found.append(grams[hits])
                place.append(np.searchsorted(ends, hits + at, side="right"))
        grams, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, place))
        pairs = np.unique(grams.astype(np.int64) * self.n + place)
        grams, place = pairs // max(1, self.n), pairs % max(1, self.n)
        keys, first = np.unique(grams, return_index=True)
        self.postings = dict(zip(keys.tolist(), np.split(place, first[1:]), strict=False)) if len(keys) else {}

    def find(self, query: Query) -> np.ndarray:
        """Ordinals of the texts that satisfy the query."""
        if query is None:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(int.from_bytes(query, "big"), np.zeros(0, np.int64))
        found = [self.find(q) for q in query[1:]]
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


@cache
def _prepared(rules: tuple[Rule, ...]) -> tuple[list, np.ndarray]:
    ready = [(r, re.compile(r.pattern, re.IGNORECASE if r.any_case else 0), trigram_query(r.pattern)) for r in rules]
    wanted = np.zeros(1 << 24, bool)
    for _, _, query in ready:
        for gram in _trigrams(query):
            wanted[int.from_bytes(gram, "big")] = True
    return ready, wanted


def spans_of(texts: Sequence[bytes], rules: tuple[Rule, ...]) -> list[list[dict]]:
    """Verified matches of each text: kind, start, end in code points, in order of start, then rule."""
    ready, wanted = _prepared(rules)
    out: list[list] = [[] for _ in texts]
    index = Segment(texts, wanted)
    for k, (rule, pattern, query) in enumerate(ready):
        for i in index.find(query).tolist():
            for m in pattern.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((m.start(), k, m.end()))
    for i, found in enumerate(out):
        if found:
            text = texts[i]
            points = {0: 0}
            last = n = 0
            for at in sorted({x for a, _, b in found for x in (a, b)}):
                n += len(text[last:at].decode("utf-8", "replace"))
                points[at], last = n, at
            out[i] = [{"kind": rules[k].kind, "start": points[a], "end": points[b]} for a, k, b in sorted(found)]
    return out


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_column(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        part: list[bytes] = []
        size = 0
        for t in texts.to_pylist():
            t = t or b""
            if part and size + len(t) > SEGMENT:
                out += spans_of(part, rules)
                part, size = [], 0
            part.append(t)
            size += len(t)
        return pa.array(out + spans_of(part, rules), _SPANS)

    return scan(text.cast("binary"))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """Adds `secrets`: array of kind, start, end (code points, end exclusive).

    Each Arrow batch is an index segment: an inverted index of the trigrams that the rules
    ask for, whose postings are intersected and united by each rule's Boolean
    query; only the candidates meet the rule itself. Rules without mandatory trigrams
    scan every text. Segments need no shuffle, and each is bounded in bytes, but for
    a single longer text. Matches of one rule don't overlap; those of different rules may.

    Null or empty text: no spans. Repeated rows get equal spans. A column of the name
    secrets is replaced, others stay. Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn("secrets", scan_column(F.col(text_col), tuple(rules)))


def redact(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with each span, overlapping ones merged, replaced by the mask."""
    step = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.struct(
            F.when(
                x["start"] >= s["at"],
                F.concat(s["out"], F.substr(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mask)),
            ).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
    )
    return F.concat(step["out"], F.substr(text, (step["at"] + 1).cast("int")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets in every document."""
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "secrets")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = [r.kind for r in RULES[:3]]
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(listed(F.filter("secrets", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed values of the query: kind, pattern, group, fewest characters; base kinds first.
STATED = (
    (
        "assign",
        f"({'|'.join(map(_either, ('password', 'passwd', 'secret', 'token', 'api_?key')))})"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("forge", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    ("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("map", "AIza[0-9A-Za-z_-]{35}", 0, 1),
)


def _hits(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    """A kind's matches, and what lies between them: their lengths add up to the positions."""
    p = "'" + pattern.replace("'", "''") + "'"
    return (
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, found, rest, i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS found, "
        f"string_split_regex(t, {p}) AS rest, unnest(range(1, len(found) + 1)) AS i FROM d) "
        f"WHERE length(regexp_extract(found[i], {p}, {group})) >= {least}"
    )


OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hit AS (
  {" UNION ALL ".join(_hits(k, *s) for k, s in enumerate(STATED))}),
span AS (
  SELECT doc_id, k, kind, length(found[i]) AS n, length(array_to_string(rest[1:i], '') || array_to_string(found[1:i - 1], '')) AS a FROM hit),
listed AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(concat_ws(':', kind, a, a + n), ',' ORDER BY a, k) FILTER (k < 3) AS base,
    string_agg(concat_ws(':', kind, a, a + n), ',' ORDER BY a, k) AS spans
  FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""
