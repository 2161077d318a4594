"""Importance resampling against brute force, whatever the slices, blocks and columns."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from kinetrail.llm import resample, texts

from .fixtures import SCHEMA, awkward

TARGET = "target_id long, text string, rank long"


def features(text, order=2):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(words), Counter(crc32(b" ".join(words[i : i + k])) for k in range(1, order + 1) for i in range(len(words) - k + 1))


def brute(docs, target, order=2, buckets=10_000, words=20, percent=25, seed=7):
    found = [(i, *features(t, order)) for i, t in docs]

    def fold(c):
        out = Counter()
        for k, n in c.items():
            out[k % buckets] += n
        return out

    folded = [(i, n, fold(c)) for i, n, c in found]
    s, t = Counter(), Counter()
    for *_, c in folded:
        s.update(c)
    for x in target:
        t.update(fold(features(x, order)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for i, n, c in folded:
        size = sum(c.values())
        weight = sum(k * gain[b] for b, k in c.items()) // size if size else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, size, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    order_ = sorted((r for r in rows if r[4] >= words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(order_[: percent * len(order_) // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def target(spark):
    rows = [(k, r[1], None) for k, r in enumerate(awkward(8, 10)[:12])]
    return spark.createDataFrame(rows, TARGET), [r[1] for r in rows]


@pytest.mark.parametrize("options", [{}, {"order": 1, "buckets": 50}, {"order": 3, "percent": 60, "words": 1, "seed": 1}, {"buckets": 70_000, "percent": 100}])
def test_awkward_documents(spark, target, options):
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = resample.resample(docs, target[0], **options)
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert result(df) == brute([r[:2] for r in rows], target[1], **options)


def test_empty_tables(spark, target):
    docs, none = spark.createDataFrame(awkward(), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert resample.resample(none, target[0]).collect() == []
    assert result(resample.resample(docs, target[0].limit(0))) == brute([r[:2] for r in awkward()], [])
    wordless = spark.createDataFrame([(1, "- !", "", "", 0, "", "", "")], SCHEMA)
    assert [tuple(r)[1:3] + (r["rank"],) for r in resample.resample(wordless, target[0]).collect()] == [(0, 0, None)]


def test_ties_of_scores_are_ranked_by_id(spark, target):
    rows = [(k // 2, "one two three " * 9, None) for k in range(40)]
    docs = spark.createDataFrame(rows, TARGET).withColumnRenamed("target_id", "doc_id")
    got = resample.resample(docs, target[0], percent=50).where("rank IS NOT NULL").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 21))
    by = sorted(got, key=lambda r: r["rank"])
    assert by == sorted(got, key=lambda r: (-r["score"], r["doc_id"], r["rank"]))


def test_slices_do_not_show(monkeypatch):
    text = (" ".join(r[1] or "" for r in awkward()[:9]) + " ").encode() * 2
    whole = resample.bucket_counts(text, 3, 997)
    for size in (1, 7, 100, 5000):
        cut = lambda t, word, gap, size=size: texts.word_slices(t, word, gap, size)
        monkeypatch.setattr(resample, "word_slices", cut)
        found = resample.bucket_counts(text, 3, 997)
        assert found[0] == whole[0] and np.array_equal(found[1], whole[1])


def test_matrix_is_csr(spark):
    rows = awkward()[:9] + [(7, None) + (None,) * 6]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    (block,) = resample.count_matrix(docs, buckets=101).collect()
    ends, at, n = np.frombuffer(block["indptr"], np.int64), np.frombuffer(block["buckets"], np.uint16), np.frombuffer(block["counts"], np.uint32)
    assert block["ids"] == [r[0] for r in rows] and len(ends) == len(rows) + 1
    for k, row in enumerate(rows):
        want = Counter()
        for crc, c in features(row[1])[1].items():
            want[crc % 101] += c
        assert dict(zip(at[ends[k] : ends[k + 1]].tolist(), n[ends[k] : ends[k + 1]].tolist(), strict=True)) == want
        assert block["n_words"][k] == features(row[1])[0]


def test_blocks_and_row_groups_are_bounded(spark, monkeypatch):
    """One task's documents make many blocks and row groups, so that neither writers nor readers hold all of them."""
    import glob
    import random

    import pyarrow.parquet as pq

    monkeypatch.setattr(resample, "ROW_GROUP", 200_000)
    monkeypatch.setattr(resample, "PAGE", 100_000)
    rng = random.Random(9)
    texts_ = [" ".join(str(rng.randrange(10**6)) for _ in range(rng.choice([0, 30, 900]))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string").coalesce(1)
    matrix = resample.saved_matrix(resample.count_matrix(docs))
    blocks = matrix.collect()
    assert sorted(i for b in blocks for i in b["ids"]) == list(range(600))
    assert max(len(b["buckets"]) // 2 for b in blocks) < resample.ENTRIES + resample.BUCKETS
    assert all(len(b["ids"]) == len(b["n_words"]) == len(b["indptr"]) // 8 - 1 for b in blocks)
    (file,) = glob.glob(matrix._kt_path.removeprefix("file://") + "/*.parquet")
    groups = pq.ParquetFile(file).metadata
    assert groups.num_row_groups > 4 and max(groups.row_group(k).num_rows for k in range(groups.num_row_groups)) <= 8
    assert result(resample.resample(docs, docs.limit(0))) == brute(list(enumerate(texts_)), [])


def test_documents_like_the_target_are_drawn(spark):
    import random

    rng = random.Random(3)
    texts_ = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"] if k % 4 == 0 else ["one", "two", "three", "four"], k=200)) for k in range(400)]
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts_)], "doc_id long, text string, Rank long")
    drawn = resample.resampled(docs, spark.createDataFrame([("alpha beta gamma delta " * 50,)], "text string"))
    assert drawn.columns == docs.columns
    ids = [r["doc_id"] for r in drawn.collect()]
    assert len(ids) == 100 and sum(i % 4 == 0 for i in ids) > 60
