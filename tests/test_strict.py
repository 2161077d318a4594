"""Strict reads, typed evidence, digests, seeded draws and reconciled slices, with every way to break them."""

import json
import math
import random

import numpy as np
import pytest
from kinetrail.operators import digest, draws, evaluate, evidence, report
from kinetrail.operators.forecast import wide
from kinetrail.schema import KEYS, OBSERVED, POINTS
from kinetrail.sources import strict
from kinetrail.sources.synthetic import partitions, synthetic
from pyspark.sql import functions as F

HEAD = ",".join(KEYS) + ",x,y"
GOOD = ["1,1,1,1,0.5,2", "1,1,1,2,0.5,2", "1,1,2,1,-1e3,0"]


def written(folder, lines, head=HEAD, name="t.csv"):
    (folder / name).write_text("\n".join([head, *lines]) + "\n")
    return str(folder / name)


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("1,1,1,2,9,9", "duplicate key"),
        ("1,1,3,1,NaN,0", "coordinate not finite"),
        ("1,1,3,1,0,Infinity", "coordinate not finite"),
        ("1,1,3,1,0,-Infinity", "coordinate not finite"),
        ("1,1,3,1,,0", "coordinate not finite"),
        ("1,1,,1,0,0", "null key"),
        ("1,1,3,0,0,0", "identifier not positive"),
        ("-1,1,3,1,0,0", "identifier not positive"),
        ("1,1,3,121,0,0", "frame beyond the contract"),
        ("1,1,3,1,0", "MALFORMED|malformed"),
        ("1,1,3,1,0,0,0", "MALFORMED|malformed"),
        ("1,1,3,one,0,0", "MALFORMED|malformed|FAILED_READ|cannot be parsed"),
    ],
)
def test_points_that_are_refused(spark, tmp_path, line, rule):
    path = written(tmp_path, [*GOOD, line])
    with pytest.raises(Exception, match=rule):
        strict.read_points(spark, path).collect()
    with pytest.raises(Exception, match=rule):  # whatever columns are read
        strict.read_points(spark, path).groupBy().count().collect()


def test_points_that_are_read(spark, tmp_path):
    path = written(tmp_path, GOOD)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None) or [])
    rows = strict.read_points(spark, path)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None) or []) == before  # building the plan runs nothing
    assert rows.columns == [*KEYS, "x", "y"]
    assert sorted(map(tuple, rows.collect())) == sorted(tuple(map(float, line.split(","))) for line in GOOD)
    named = written(tmp_path, ["a," + GOOD[0], "b," + GOOD[0]], "model," + HEAD, "m.csv")
    assert strict.read_points(spark, named, model=True).count() == 2
    with pytest.raises(Exception, match="null key"):
        strict.read_points(spark, written(tmp_path, ["," + GOOD[0]], "model," + HEAD, "n.csv"), model=True).collect()
    empty = written(tmp_path, [], name="e.csv")
    with pytest.raises(Exception, match="empty table"):
        strict.read_points(spark, empty).collect()
    assert strict.read_points(spark, empty, empty=True).count() == 0
    with pytest.raises(Exception, match="CSV header|HEADER|header"):
        strict.read_points(spark, written(tmp_path, GOOD, HEAD.replace("x,y", "y,x"), "h.csv")).collect()


def test_counts_in_one_pass(spark):
    rows = [(1, 1, 1, 1, 0.0, 0.0)] * 3 + [(1, 1, 1, 0, 0.0, 0.0), (None, 1, 1, 2, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, POINTS)
    got = {r.rule: r.violations for r in strict.counted(df, KEYS, strict.point_rules()).collect()}
    assert got == {"null key": 1, "identifier not positive": 1, "frame beyond the contract": 0, "coordinate not finite": 1, "duplicate key": 2, "rows": 5}
    none = {r.rule: r.violations for r in strict.counted(df.limit(0), KEYS, strict.point_rules()).collect()}
    assert set(none.values()) == {0} and len(none) == 6
    kept, seen = strict.watched(df, strict.point_rules())
    kept.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 5, "null key": 1, "identifier not positive": 1, "frame beyond the contract": 0, "coordinate not finite": 1}


OBSERVED_HEAD = ",".join(OBSERVED.fieldNames())


def seen(entity, frame, horizon=12, x=1.0):
    row = {"game_id": 1, "play_id": 1, "nfl_id": entity, "frame_id": frame, "x": x, "y": 2, "ball_land_x": 3, "ball_land_y": 4, "num_frames_output": horizon, "player_role": "r"}
    return ",".join(str(row[c]) for c in OBSERVED.fieldNames())


@pytest.mark.parametrize(
    ("lines", "rule"),
    [
        ([seen(1, 1), seen(1, 2), seen(2, 1), seen(2, 3)], "gap in the history"),
        ([seen(1, 1), seen(1, 2), seen(2, 1)], "single row of history"),
        ([seen(1, 1), seen(1, 2), seen(2, 2), seen(2, 3)], "gap in the history"),
        ([seen(1, 1), seen(1, 2), seen(1, 2)], "duplicate key"),
        ([seen(1, 1), seen(1, 2, 0)], "horizon not positive"),
        ([seen(1, 1), seen(1, 2, "")], "horizon not positive"),
        ([seen(1, 1), seen(1, 2, x="nan")], "coordinate not finite|MALFORMED|malformed|FAILED"),
        ([seen(1, 1), seen(1, 2)], None),
    ],
)
def test_history(spark, tmp_path, lines, rule):
    rows = strict.read_history(spark, written(tmp_path, lines, OBSERVED_HEAD))
    if rule:
        with pytest.raises(Exception, match=rule):
            rows.collect()
        return
    assert rows.count() == len(lines)
    asked = lambda *keys: spark.createDataFrame([(1, 1, *k) for k in keys], "game_id long, play_id long, nfl_id long, frame_id long")
    assert strict.requests_within(asked((1, 1), (1, 12)), rows).count() == 2
    with pytest.raises(Exception, match="missing entity at 1, 1, 2, 1"):
        strict.requests_within(asked((1, 1), (2, 1)), rows).collect()
    with pytest.raises(Exception, match="frame beyond the horizon"):
        strict.requests_within(asked((1, 13)), rows).groupBy().count().collect()


RULES = [
    evidence.Rule("flag", "$.flag", "boolean", equals=True),
    evidence.Rule("count", "$.count", "integer", equals=20),
    evidence.Rule("score", "$.score", "number", low=0.0),
    evidence.Rule("ref", "$.ref", "string", pattern="^[0-9a-f]{4}$"),
    evidence.Rule("rows", "$.rows", "null"),
    evidence.Rule("list", "$.list", "array", low=1, high=2),
    evidence.Rule("part", "$.part", "object"),
    evidence.Rule("note", "$.note", "string", optional=True),
]
FINE = {"flag": True, "count": 20, "score": 0.5, "ref": "00ff", "rows": None, "list": [1], "part": {"a": 1}}


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        ({}, None),
        ({"note": "text"}, None),
        ({"score": 1}, None),
        ({"flag": 1}, ("flag", "type")),
        ({"flag": "true"}, ("flag", "type")),
        ({"flag": False}, ("flag", "value")),
        ({"count": True}, ("count", "type")),
        ({"count": "20"}, ("count", "type")),
        ({"count": 20.5}, ("count", "type")),
        ({"count": 21}, ("count", "value")),
        ({"score": "0.5"}, ("score", "type")),
        ({"score": True}, ("score", "type")),
        ({"score": -1}, ("score", "value")),
        ({"ref": "00FF"}, ("ref", "value")),
        ({"ref": 1234}, ("ref", "type")),
        ({"rows": 0}, ("rows", "type")),
        ({"list": []}, ("list", "value")),
        ({"list": [1, 2, 3]}, ("list", "value")),
        ({"list": {"0": 1}}, ("list", "type")),
        ({"part": [1]}, ("part", "type")),
        ({"note": 1}, ("note", "type")),
    ],
)
def test_typed_rules(spark, change, problem):
    df = spark.createDataFrame([(1, json.dumps(FINE | change))], "id int, doc string")
    assert [(r.rule, r.problem) for r in evidence.findings(df, "id", "doc", RULES).collect()] == ([problem] if problem else [])


def test_arithmetic_and_unreadable_documents(spark):
    docs = [(1, '{"old": 0.5, "new": 0.4, "gain": 0.1}'), (2, '{"old": 0.5, "new": 0.4, "gain": 0.2}'), (3, '{"old": 0.5, "new": "0.4", "gain": 0.1}'), (4, '{"old": 0.5}'), (5, "{"), (6, None)]
    sums = {"gain": (["$.old", "$.new", "$.gain"], lambda old, new, gain: F.abs(old - new - gain) <= 1e-12)}
    got = evidence.findings(spark.createDataFrame(docs, "id int, doc string"), "id", "doc", [], sums).collect()
    assert sorted((r.id, r.rule, r.problem) for r in got) == [(2, "gain", "value"), (3, "gain", "type"), (4, "gain", "missing"), (5, "document", "unreadable"), (6, "document", "unreadable")]


def test_digests(spark):
    rows = [(k, f"t{k % 7}" if k % 5 else None, float(k) / 3, [k, None], bytearray([k % 256])) for k in range(300)]
    schema = "a long, b string, c double, d array<long>, e binary"
    df = spark.createDataFrame(rows, schema)
    whole = tuple(digest.table_digest(df).first())
    assert tuple(digest.table_digest(df.repartition(7).orderBy(F.rand(1)).select("e", "c", "a", "d", "b")).first()) == whole
    shards = [digest.table_digest(df.where(F.col("a") % 3 == k)) for k in range(3)]
    assert tuple(digest.merged(shards[0].unionByName(shards[1]).unionByName(shards[2])).first()) == whole
    other = [df.where("a > 0"), df.unionByName(df.limit(1)), df.replace("t3", "t4"), df.fillna("", ["b"]), df.fillna("-", ["b"]), df.withColumn("c", F.col("c") + 1e-12)]
    assert all(tuple(digest.table_digest(o).first()) != whole for o in other)
    assert digest.same_rows(df, df.orderBy("c")) and not digest.same_rows(df, df.unionByName(df)) and not digest.same_rows(df, df.drop("a"))
    split = [spark.createDataFrame([r], "a string, b string") for r in (("x", "y1:z"), ("xy", "1:z"), ("x1:y", "z"), (None, "-"), ("-", None))]
    assert len({tuple(digest.table_digest(s).first()) for s in split}) == len(split)
    assert digest.table_digest(df.limit(0)).first().n == 0


@pytest.mark.parametrize(("n", "repeats", "chunk"), [(1, 5, 64), (2, 50, 64), (6, 2000, 1 << 18), (7, 333, 64), (37, 100, 128), (1000, 20, 512)])
def test_draws_are_numpys(spark, n, repeats, chunk):
    want = np.random.default_rng(2026).integers(0, n, (repeats, n))
    got = np.zeros((repeats, n), np.int64)
    for r in draws.resample_counts(spark, 2026, repeats, n, chunk).collect():
        got[r.rep, r.g] += r.times
    assert (got == np.array([np.bincount(row, minlength=n) for row in want])).all()


def test_rejected_draws(spark):
    """A range that rejects nearly half of all words: places still are NumPy's."""
    n = (1 << 31) + 1
    want = np.random.default_rng(5).integers(0, n, 4000)
    parts = [draws.accepted(5, k * 256, 256, n) for k in range(60)]
    got = np.concatenate(parts)[:4000]
    assert (got == want).all() and sum(map(len, parts)) < 0.7 * 60 * 256


def test_bootstrap_equals_numpy(spark):
    rng = random.Random(1)
    rows = [(g, 1, p, f, rng.gauss(0, 1), rng.gauss(0, 1)) for g in (105, 106, 109) for p in range(rng.randint(1, 4)) for f in (1, 2)]
    errors = spark.createDataFrame(rows, ", ".join(f"{k} long" for k in KEYS) + ", dx double, dy double").withColumn("model", F.lit("m"))
    games = sorted({r[0] for r in rows})
    sse = np.array([sum(r[4] ** 2 + r[5] ** 2 for r in rows if r[0] == g) for g in games])
    n = np.array([sum(r[0] == g for r in rows) for g in games])
    at = np.random.default_rng(2026).integers(0, len(games), (200, len(games)))
    want = np.sqrt(sse[at].sum(axis=1) / (2 * n[at].sum(axis=1)))
    got = {r.rep: r.rmse for r in evaluate.bootstrap(errors, repeats=200).collect()}
    assert [got[k] for k in range(200)] == pytest.approx(want.tolist(), rel=1e-12)


def errors_of(spark, rows):
    return spark.createDataFrame([("m", g, 1, 1, f, 3.0, 4.0) for g, f in rows], "model string, " + ", ".join(f"{k} long" for k in KEYS) + ", dx double, dy double")


def test_slices(spark):
    splits = spark.createDataFrame([(1, "train"), (2, "holdout"), (3, "holdout")], "game_id long, partition string")
    every = [(g, f) for g in (1, 2, 3) for f in range(1, 13)]
    got = {(r.partition, r.slice, r.value): (r.n, r.rmse) for r in evaluate.slices(errors_of(spark, every), splits).collect()}
    assert len(got) == 2 + 6 + 3 and all(math.isclose(v[1], math.sqrt(12.5)) for v in got.values())
    assert got["holdout", "total", "all"][0] == 24 and got["holdout", "horizon", "frames_5_8"][0] == 8 and got["train", "game", "1"][0] == 12
    for rows, why in (
        ([(g, f) for g, f in every if not (g == 1 and f > 8)], "an empty horizon"),
        ([*every, (2, 13)], "a frame in no horizon"),
        ([*every, (4, 1)], "a game without a partition"),
    ):
        with pytest.raises(Exception, match=why):
            evaluate.slices(errors_of(spark, rows), splits).collect()


# Published figures of the fixture, by partition and slice: constant velocity, last position, damped velocity.
RECORDED = [
    ("train", "total", "all", 0.28268430878640, 2.00948407906814, 0.84902090451135),
    ("validation", "total", "all", 0.28972924174638, 1.77512537172492, 0.71543859169670),
    ("holdout", "total", "all", 0.26347552281594, 2.09754366293853, 0.87966547484684),
    ("holdout", "horizon", "frames_1_4", 0.04067038207677, 0.77155563429996, 0.16325159134714),
    ("holdout", "horizon", "frames_5_8", 0.17638190189886, 1.86934637945633, 0.63947433480593),
    ("holdout", "horizon", "frames_9_12", 0.41891932167624, 3.01816405627565, 1.37326455425009),
    ("holdout", "game", "106", 0.26315001438337, 2.18875068004507, 0.91730164887779),
    ("holdout", "game", "105", 0.26380062959801, 2.00218612932700, 0.84034539341936),
]
MODELS = ("constant_velocity_frames", "last_position", "damped_velocity")


def test_recorded_slices(spark):
    """Slices of the published fixture against the recorded figures, in both directions, within their rounding."""
    b = synthetic(spark)
    made = evaluate.slices(evaluate.score_wide(b.labels, wide(b.observed, b.requests, MODELS), MODELS), partitions(spark))
    keys = ["model", "partition", "slice", "value"]
    rows = [(m, *r[:3], v) for r in RECORDED for m, v in zip(MODELS, r[3:], strict=True)]
    recorded = spark.createDataFrame(rows, "model string, partition string, slice string, value string, rmse double")
    same = report.assertions(recorded, made.join(recorded.select(*keys), keys, "left_semi"), keys, ["rmse"]).collect()
    assert len(same) == 24 and all(r.passed for r in same)
    off = report.assertions(recorded.withColumn("rmse", F.col("rmse") + 2e-6), made, keys, ["rmse"]).collect()
    assert not any(r.passed for r in off)
