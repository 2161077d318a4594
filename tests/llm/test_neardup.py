"""Near-duplicate groups against all pairs of a small table."""

import random
from collections import defaultdict

import pytest
from kinetrail.llm import neardup
from kinetrail.llm.components import components

from .fixtures import SCHEMA, awkward


def brute(rows, percent=75):
    """(id, number of shingles, component) of each (id, text)."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\f\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, (i, _) in enumerate(rows):
        for q in range(p):
            x, y, j = sets[p], sets[q], rows[q][0]
            if x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def copies(seed, n, groups, change):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [rng.choices(words, k=120) for _ in range(groups)]
    rows = []
    for i in range(n):
        base = list(bases[i % groups])
        for _ in range(rng.randint(0, change)):
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((n - i, " ".join(base)))
    return rows


def test_awkward(spark):
    rows = awkward()
    got = neardup.near_groups(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert result(got) == brute([(r[0], r[1]) for r in rows])
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got.collect())
    assert neardup.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("stars", [4, 1])
def test_wide_groups(spark, monkeypatch, stars):
    """Groups whose members lie around the threshold: many links only come after the first star."""
    monkeypatch.setattr(neardup, "STARS", stars)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = copies(1, 240, 4, 6)
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(got) == brute(rows)


def test_texts_of_one_id(spark):
    """Rows of one id join what their texts are near to."""
    rng = random.Random(9)
    a, b, c = (" ".join(rng.choices([f"w{i}" for i in range(50)], k=40)) for _ in range(3))
    rows = [(1, a), (2, b), (5, a), (5, b), (7, c), (8, c + " end"), (8, None), (9, b), (2, c)]
    got = {(r.doc_id, r.component_id) for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (7, 1), (8, 1), (9, 1), (8, 8)}


def test_many_texts_of_one_id(spark, monkeypatch):
    """Thousands of different texts under one id, near to others or to none: a row per text is compared, one component."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows = [(7, " ".join(rng.choices(words, k=30))) for _ in range(3000)]
    rows += [(100 + k, rows[k * 7][1] + " tail") for k in range(50)] + [(3, rows[5][1]), (500, "quite another text than all of the others here")]
    kept = []
    real = neardup.saved
    monkeypatch.setattr(neardup, "saved", lambda df, label: kept.append((label, real(df, label))) or kept[-1][1])
    got = {(r.doc_id, r.component_id) for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(7, 3), (3, 3), (500, 500), *((100 + k, 3) for k in range(50))}
    assert {label: df.count() for label, df in kept if label == "near-classes"} == {"near-classes": 3051}


def test_equal_sets_in_another_order(spark):
    """Texts whose words differ in order but whose shingles are the same set are linked by comparison."""
    a, b = "a b c d e a b c d e a b c d e", "a b c d e a b c d e"
    rows = [(4, a), (2, b), (9, a.upper()), (8, "x y z u v w")]
    got = {(r.doc_id, r.component_id) for r in neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(4, 2), (2, 2), (9, 2), (8, 8)}


def test_wide_band_of_other_texts(spark, monkeypatch):
    """Many documents that share a band but little more, some long, with a few links among them."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "UNIT", 300)
    monkeypatch.setattr(neardup, "STARS", 1)
    rng = random.Random(6)
    words, common = [f"w{i}" for i in range(3000)], [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + rng.choices(words, k=rng.randint(20, 90)))) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " tail") for i in range(0, 20, 3)]
    got = neardup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(got) == brute(rows)


def test_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = neardup.near_groups(table)
    assert result(got) == brute([tuple(r) for r in table.collect()])


def test_posterior_bounds():
    for n, least in neardup._least_matches(200, 75, 40, 1e-6):
        assert 0 < least < 0.75 * n


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(2000, 2100)]
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    for start, comp in got.items():
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert comp == min(seen)
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
