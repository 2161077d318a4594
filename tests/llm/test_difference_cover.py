"""The skew algorithm against sorted suffixes."""

import random

from kinetrail.llm.difference_cover import repeated_positions, suffix_array


def test_suffix_array(spark):
    rng = random.Random(6)
    base = "".join(rng.choices("ab", k=30))
    texts = {1: "banana", 4: "", 5: "banana", 7: base, 9: "x" + base + "y", 11: "aaaaaaa", 12: "é"}
    docs = spark.createDataFrame([(d, t.encode()) for d, t in texts.items()], "doc long, text binary")
    got = [(r.doc, r.i) for r in suffix_array(docs).orderBy("rank").collect()]
    ends = {d: k for k, d in enumerate(sorted(d for d, t in texts.items() if t))}
    want = sorted(
        ((d, i) for d, t in texts.items() if t for i in range(len(t.encode()) + 1)),
        key=lambda p: ([c + 100 for c in texts[p[0]].encode()[p[1] :]] + [ends[p[0]]]),
    )
    assert got == want
    data = {d: t.encode() for d, t in texts.items()}
    starts = [(d, i, t[i : i + 6]) for d, t in data.items() for i in range(len(t) - 5)]
    twice = {(d, i) for d, i, s in starts if sum(s == x[2] for x in starts) > 1}
    assert {(r.doc, r.i) for r in repeated_positions(docs, 6).collect()} == twice
