"""Ranked search against brute force, whatever the windows and slices."""

import math
import random
import re
from collections import Counter

import pytest
from kinetrail.llm import search

from .fixtures import SCHEMA, awkward

ITEMS = "item_id string, text string, score string"


def terms_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower())


def brute(docs, items, top=10):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df, wanted = Counter(t for _, c, _ in held for t in c), {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        rows = []
        for i, c, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms & set(c))
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, k, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def awkward_items():
    rows = awkward()
    items = [(f"i{k}", " ".join((rows[k][1] or "").split()[:25]), None) for k in range(12)]
    return items + [(None, "bban! BAN dOn", "x"), (None, rows[2][1], "x"), ("e", "", ""), ("n", None, None), ("i3", "gOx7 kßn", ""), ("z", "nowhere-to-be-found", "")]


@pytest.mark.parametrize("options", [{}, {"window": 3}, {"bound": 40, "window": 16}, {"top": 1}, {"top": 1000, "window": 9}])
def test_awkward_documents(spark, options):
    docs, items = awkward(), awkward_items()
    got = search.ranked(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, ITEMS), **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert result(got) == brute([d[:2] for d in docs], [i[:2] for i in items], options.get("top", 10))


def test_ties_go_to_smaller_ids(spark):
    rng = random.Random(1)
    docs = [(k, rng.choice(["a b c", "b a c", "c c d"])) for k in range(500)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    items = [("x", "a"), ("y", "d c"), ("w", "b b b")]
    for window in (7, 64, 8192):
        assert result(search.ranked(df, spark.createDataFrame(items, "item_id string, text string"), window=window)) == brute(docs, items)


def test_windows_end_at_their_postings(spark):
    docs = awkward()
    vocabulary = {t: k for k, t in enumerate(sorted(set(terms_of(docs[0][1]))))}
    rows = search.index_windows(spark.createDataFrame(docs, SCHEMA).coalesce(1), vocabulary, bound=40).collect()
    assert len(rows) > 5 and sum(len(r["ids"]) for r in rows) == sum(bool(terms_of(d[1])) for d in docs)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(awkward(), SCHEMA), spark.createDataFrame(awkward_items(), ITEMS)
    assert search.ranked(docs.limit(0), items).collect() == []
    assert search.ranked(docs, items.limit(0)).collect() == []
    assert search.ranked(docs, items.where("item_id IN ('e', 'n', 'z')")).collect() == []
