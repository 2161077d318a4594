"""Each stage of the pipeline against a brute-force version, on its own input."""

import re

import corpus_pipeline
from kinetrail.llm import quality
from kinetrail.llm.common import saved

from .test_neardup import brute

SF = "/root/testdata/sf0.001"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(saved(stage(spark, outs[-1], SF), name))
    rows = [{r.doc_id: r for r in o.collect()} for o in outs]
    assert all(o.columns == docs.columns for o in outs[:-1])

    # quality: rejects are those of the operator, base rules among them
    verdict = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert set(rows[1]) == {d for d, kept in verdict.items() if kept}
    for d in rows[1]:
        assert rows[1][d].text == rows[0][d].text and len(re.findall(r"[^\x20\x09-\x0D]+", rows[0][d].text)) >= 50

    # line dedup
    keys = lambda t: [low(x.strip(" \t\n\x0b\f\r")) for x in (t or "").split("\n")]
    holders = {}
    for d, r in rows[1].items():
        for k in keys(r.text):
            if len(k) >= 40:
                holders.setdefault(k, set()).add(d)
    assert set(rows[2]) == set(rows[1])
    for d, r in rows[1].items():
        kept = [x for x, k in zip(r.text.split("\n"), keys(r.text), strict=True) if len(holders.get(k, ())) < 5 or d == max(holders[k])]
        assert rows[2][d].text == "\n".join(kept) and rows[2][d].n_chars == len(rows[2][d].text)

    # near copies: the smallest id of each component
    found = brute([(d, r.text) for d, r in rows[2].items()])
    assert set(rows[3]) == {d for d, _, c in found if d == c}

    # leaks
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = lambda w: {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    bench = set().union(*(windows(word.findall(low(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    for d, r in rows[3].items():
        w = word.findall(low(r.text))
        leaked = any(tuple(w[i : i + len(g)]) == g for g in bench for i in range(len(w) - len(g) + 1) if w[i] == g[0])
        assert (d in rows[4]) == (not leaked)

    # mixing: every document with its copies, sources near their targets
    assert set(rows[5]) == set(rows[4])
    total = {}
    for r in rows[5].values():
        taken, target, largest = total.get(r.source, (0, r.target, 0))
        total[r.source] = taken + r.taken, target, max(largest, r["size"])
        assert r.taken == r.copies * r["size"] <= 2 * r["size"] and r.text == rows[4][r.doc_id].text
    assert all(abs(taken - target) <= largest / 2 + 1e-6 for taken, target, largest in total.values())
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in outs[-1].collect()}
