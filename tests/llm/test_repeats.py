"""Removal of repeated strings against a count of every window."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from kinetrail.llm import repeats
from pyspark.sql import functions as F

from .fixtures import SCHEMA, awkward


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, bytes(x for x, g in zip(d, gone, strict=True) if not g)))
    return Counter(out)


def result(df):
    return Counter((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize(
    ("length", "name", "piece", "most"), [(200, 100, 1 << 18, 10_000), (60, 30, 1 << 18, 10_000), (60, 20, 97, 3), (60, 30, 1 << 18, 1)]
)
def test_awkward(spark, monkeypatch, length, name, piece, most):
    monkeypatch.setattr(repeats, "PIECE", piece)
    rows = awkward()
    rows[62] = (102, "ab" * 400, *rows[62][2:])
    rng = random.Random(1)
    base = "".join(rng.choices("abcdé ", k=3000))
    for i in range(40):
        a = rng.randrange(2500)
        cut = base[a : a + rng.randint(10, 500)]
        rows.append((500 + i, "".join(rng.choices("xyz", k=rng.randint(0, 90))) + cut + "".join(rng.choices("xyz", k=50)), *rows[0][2:]))
    got = repeats.drop_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), length=length, name=name, most=most)
    assert result(got) == brute([r[1] for r in rows], length)
    assert repeats.drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("most", [10_000, 4])
def test_tables(spark, most):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(repeats.drop_repeats(table, most=most)) == brute([r.text for r in table.select("text").collect()], 200)


def test_equal_keys_of_other_bytes(spark, monkeypatch):
    """Windows whose keys collide are told apart by their bytes."""
    monkeypatch.setattr(repeats, "_window_keys", lambda rows, length, f=repeats._window_keys: (f(rows, length)[0] % 7, *f(rows, length)[1:]))
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(20, 60))) for _ in range(40)]
    texts += texts[:3]
    table = pa.table({"name": [1] * 43, "id": range(43), "row": [0] * 43, "start": [0] * 43, "offset": [0] * 43, "context": texts})
    got = repeats.repeated(table.cast(repeats._CONTEXT), 20)
    seen = Counter(t[i : i + 20] for t in texts for i in range(len(t) - 19))
    want, covered = set(), set()
    for k, t in enumerate(texts):
        want |= {(k, i + j) for i in range(len(t) - 19) if seen[t[i : i + 20]] > 1 for j in range(20)}
    for r in got.to_pylist():
        covered |= {(r["id"], i) for i in range(r["begin"], r["end"])}
    assert covered == want


@pytest.mark.parametrize("hashes", [1, 3, 1 << 30])
def test_hot_windows_of_equal_hashes(monkeypatch, hashes):
    """Hot windows whose hashes meet, within a task or after the exchange, are told apart by their bytes."""
    monkeypatch.setattr(repeats, "_digest", lambda w: (hash(w) % hashes).to_bytes(8, "little") + bytes(8))
    rng = random.Random(7)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(20, 60))) for _ in range(60)]
    texts += [texts[0], texts[31], texts[31]]
    made = []
    for part in (range(0, 30), range(30, 63)):
        places = np.array([(k, 1000 * k) for k in part])
        made += repeats._hot_rows(pa.array(list(part), pa.int64()), places, [texts[k] for k in part], 20).to_pylist()
    made.sort(key=lambda r: (r["w1"], r["w2"], r["window"]))
    covered = {k: set() for k in range(63)}
    batches = [pa.RecordBatch.from_pylist(made[i : i + 50], schema=repeats._WINDOW) for i in range(0, len(made), 50)]
    for r in pa.Table.from_batches(list(repeats._hot_found(iter(batches)))).to_pylist():
        covered[r["id"]] |= set(range(r["begin"] - 1000 * r["id"], r["end"] - 1000 * r["id"]))
    seen = Counter(t[i : i + 20] for t in texts for i in range(len(t) - 19))
    assert covered == {k: {i + j for i in range(len(t) - 19) if seen[t[i : i + 20]] > 1 for j in range(20)} for k, t in enumerate(texts)}


def test_filters_grow_with_their_names(spark):
    names = spark.range(300_000).select(F.xxhash64("id").alias("name"))
    held = np.frombuffer(repeats._filter(names).value, np.uint8)
    assert 8 * len(held) == 1 << 22
    some = np.array([r.name for r in names.limit(2000).collect()])
    assert repeats._held(held, some).all()
    assert 0.02 < repeats._held(held, np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)).mean() < 0.125
    assert 8 * len(repeats._filter(names.limit(3)).value) == 1 << 20
