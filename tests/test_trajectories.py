"""State, forecasts, metrics, validation and splits on hand-made and generated tables."""

import json
import math
import random

import numpy as np
import pytest
from kinetrail.functions.motion import MODELS, damped, model
from kinetrail.operators import evaluate, report, ridge, state, validate, weekly
from kinetrail.operators.forecast import design, predict, ridge_predict
from kinetrail.operators.split import enough_days, split_games
from kinetrail.operators.state import observed_state
from kinetrail.schema import KEYS, OBSERVED, POINTS
from kinetrail.sources.synthetic import synthetic, two_player_play
from pyspark.sql import functions as F

OBS = OBSERVED.fieldNames()


def points(spark, rows):
    return spark.createDataFrame([(1, 1, n, f, float(x), float(y)) for n, f, x, y in rows], POINTS)


def observed(spark, seed=1, players=("a", "b", "c"), frames=(1, 2, 4, 7, 8), spin=0.0, shift=(0.0, 0.0)):
    rng = random.Random(seed)
    c, s = math.cos(spin), math.sin(spin)
    turn = lambda x, y: (c * x - s * y + shift[0], s * x + c * y + shift[1])
    rows = []
    for n, role in enumerate(players, 1):
        ball = turn(rng.uniform(0, 100), rng.uniform(0, 50))
        for f in frames:
            x, y = turn(rng.uniform(0, 100), rng.uniform(0, 50))
            rows.append((1, 1, n, f, x, y, *ball, 12, role))
    return spark.createDataFrame(rows, OBSERVED)


def requests(spark, players=3, frames=12):
    return spark.createDataFrame([(1, 1, n, f) for n in range(1, players + 1) for f in range(1, frames + 1)], "game_id long, play_id long, nfl_id long, frame_id long")


def as_map(df):
    return {tuple(r[k] for k in KEYS): (r.x, r.y) for r in df.collect()}


def test_irregular_gap_uses_elapsed_time(spark):
    got = predict(points(spark, [(1, 2, 0, 0), (1, 4, 2, 0)]), requests(spark, 1, 1), ["constant_velocity"]).first()
    assert (got.x, got.y) == (3.0, 0.0)


def test_single_row_stands_still(spark):
    got = predict(points(spark, [(1, 5, 3, 4)]), requests(spark, 1, 3), ["constant_velocity", "smoothed_velocity", "constant_acceleration"]).collect()
    assert {(r.x, r.y) for r in got} == {(3.0, 4.0)} and len(got) == 9


def test_state_against_numpy(spark):
    table = observed(spark)
    rows = table.collect()
    for got in observed_state(table).collect():
        mine = sorted((r.frame_id, r.x) for r in rows if r.nfl_id == got.nfl_id)
        t, x = np.array([m[0] / 10 for m in mine]), np.array([m[1] for m in mine])
        v = np.diff(x) / np.diff(t)
        dt = np.diff(t)
        assert got.vx == pytest.approx(v[-1]) and got.ax == pytest.approx((v[-1] - v[-2]) / ((dt[-1] + dt[-2]) / 2))
        assert got.sx == pytest.approx(np.polyfit(t[-5:], x[-5:], 1)[0])
        assert not got.contiguous and got.n_observed == 5


def test_damping(spark):
    table = points(spark, [(1, 1, 0, 0), (1, 2, 2, 4)])
    joined = requests(spark, 1, 3).where("frame_id = 3").join(observed_state(table), ["game_id", "play_id", "nfl_id"])
    at = lambda d: joined.select(damped(d)("x").alias("x"), damped(d)("y").alias("y")).first()
    assert tuple(at(0.5)) == (3.75, 7.5) and tuple(at(0.0)) == (2.0, 4.0) and tuple(at(1.0)) == (8.0, 16.0)
    with pytest.raises(ValueError):
        damped(1.5)("x")
    with pytest.raises(ValueError):
        model("nothing")


def test_ball_arrives(spark):
    table = observed(spark)
    got = predict(table, requests(spark).where("frame_id = 12"), ["ball_arrival"]).collect()
    ball = {r.nfl_id: (r.ball_land_x, r.ball_land_y) for r in table.collect()}
    for r in got:
        assert (r.x, r.y) == pytest.approx(ball[r.nfl_id])


def test_labels_cannot_leak(spark):
    table, asked = observed(spark), requests(spark)
    poisoned = asked.withColumns({"x": F.lit(1e9), "y": F.lit(float("nan"))})
    names = list(MODELS)
    assert predict(table, asked, names).exceptAll(predict(table, poisoned, names)).isEmpty()


def test_equivariance_and_shuffling(spark):
    spin, shift = 0.7, (11.0, -3.0)
    plain = as_map(predict(observed(spark), requests(spark), ["constant_acceleration"]))
    moved = as_map(predict(observed(spark, spin=spin, shift=shift).orderBy(F.rand(1)), requests(spark), ["constant_acceleration"]))
    for k, (x, y) in plain.items():
        want = (math.cos(spin) * x - math.sin(spin) * y + shift[0], math.sin(spin) * x + math.cos(spin) * y + shift[1])
        assert moved[k] == pytest.approx(want, abs=1e-9)


def test_ridge(spark):
    table, asked = observed(spark), requests(spark)
    d = design(table, asked)
    wanted = {"a": [0.5, 0.1, 0.2, 0.3, -0.1, 0.05], "b": [0.2] * 6, "c": [0.0, 0.4, 0.0, 0.6, 0.0, 0.0]}
    rows = [(None, [0.0] * 6), *wanted.items()]
    truth = ridge_predict(d, spark.createDataFrame(rows, "player_role string, w array<double>"))
    whole = ridge.sufficient_statistics(d, truth)
    shards = ridge.add_statistics(
        ridge.sufficient_statistics(d.where("frame_id <= 5"), truth), ridge.sufficient_statistics(d.where("frame_id > 5"), truth)
    )
    for a, b in zip(*(sorted(x.collect(), key=lambda r: str(r.player_role)) for x in (whole, shards)), strict=True):
        assert a.n == b.n and all(a[c] == pytest.approx(b[c], rel=1e-11, abs=1e-9) for c in ridge.SUMS)
    fitted = json.loads(ridge.to_json(ridge.fit_statistics(whole, alpha=1e-9)))
    for role, part in fitted["roles"].items():
        assert part["count"] == 24
    again = as_map(ridge_predict(d, ridge.weights_table(spark, fitted)))
    for k, v in as_map(truth).items():
        assert again[k] == pytest.approx(v, abs=1e-2)
    unseen = ridge_predict(d.withColumn("player_role", F.lit("new")), ridge.weights_table(spark, fitted))
    everyone = ridge_predict(d, ridge.weights_table(spark, fitted | {"roles": {}}))
    assert as_map(unseen) == as_map(everyone)
    with pytest.raises(ValueError):
        ridge.fit_statistics(whole, alpha=0)
    with pytest.raises(ValueError):
        ridge.check_model(fitted | {"basis": ["x"]})
    with pytest.raises(ValueError):
        ridge.fit_statistics(whole.where("false"))


def test_solve_matches_lstsq():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 6)) * [1, 10, 100, 1, 5, 0.1]
    w = np.arange(1.0, 7.0)
    assert ridge.solve(a.T @ a, a.T @ (a @ w), 200.0, 1e-12) == pytest.approx(w)


def test_metrics_by_hand(spark):
    truth = points(spark, [(1, 1, 0, 0)])
    errors = evaluate.score(truth, points(spark, [(1, 1, 3, 4)]))
    m = evaluate.error_metrics(errors).first()
    assert m.coordinate_rmse == pytest.approx(math.sqrt(12.5)) and m.frame_ade == m.trajectory_ade == m.fde == m.p95_displacement == 5.0
    assert m.coordinate_mae == 3.5


def test_slice_and_pooling(spark):
    rows = [("m", 1, 1, 1, 1, 5.0, 0.0), ("m", 1, 1, 1, 2, 0.0, 0.0), ("n", 1, 1, 1, 1, 1.0, 0.0), ("n", 1, 1, 1, 2, 0.0, 0.0)]
    errors = spark.createDataFrame(rows, "model string, game_id long, play_id long, nfl_id long, frame_id long, dx double, dy double")
    d = {r.model: r for r in evaluate.trajectory_diagnostics(errors).collect()}["m"]
    assert (d.rmse, d.ade, d.fde, d.max_displacement, d.last_frame) == (2.5, 2.5, 0.0, 5.0, 2)
    assert [r.model for r in evaluate.ranked(evaluate.trajectory_diagnostics(errors)).collect()] == ["m", "n"]
    imbalanced = [("a", 1, 1, 1, f, math.sqrt(6), 0.0) for f in (1, 2)] + [("a", 2, 1, 1, 1, 0.0, 0.0)]
    imbalanced += [("b", 1, 1, 1, f, 0.0, 0.0) for f in (1, 2)] + [("b", 2, 1, 1, 1, 2.0, 0.0)]
    errors = spark.createDataFrame(imbalanced, errors.schema)
    pooled = {r.game_id: r for r in evaluate.paired_by_game(errors).collect()}
    assert pooled[None].is_pooled and pooled[None].rmse_delta == pytest.approx(math.sqrt(4 / 6) - math.sqrt(12 / 6))
    w = evaluate.win_loss(evaluate.paired_by_game(errors)).first()
    assert (w.wins, w.losses, w.ties) == (1, 1, 0)
    out = {(r.model, r.game_id): r.rmse for r in evaluate.leave_one_out(errors).collect()}
    assert out["a", 1] == 0.0 and out["a", 2] == pytest.approx(math.sqrt(3)) and out["b", 1] == pytest.approx(math.sqrt(2))


def test_cumulative_equals_filtering(spark):
    b = synthetic(spark)
    errors = evaluate.score(b.labels, predict(b.observed, b.requests, ["last_position"])).cache()
    running = {r.horizon: (r.n, r.rmse) for r in evaluate.cumulative(errors).collect()}
    for h in (1, 5, 12):
        part = evaluate.pooled(errors.where(f"frame_id <= {h}"), "model").first()
        assert running[h] == (part.n, pytest.approx(part.rmse))


def test_bootstrap(spark):
    rows = [("m", g, 1, 1, 1, 10.0 if g == 1 else 0.0, 0.0) for g in (1, 2)]
    errors = spark.createDataFrame(rows, "model string, game_id long, play_id long, nfl_id long, frame_id long, dx double, dy double")
    got = {r.rep: r.rmse for r in evaluate.bootstrap(errors, 200, 7).collect()}
    drawn = np.random.default_rng(7).integers(0, 2, (200, 2)).tolist()
    want = {r: math.sqrt(sum(100.0 for g in d if g == 0) / 4) for r, d in enumerate(drawn)}
    assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        evaluate.bootstrap(errors.where("false"))


def test_alignment_and_coverage(spark):
    truth = points(spark, [(1, 1, 0, 0), (1, 2, 0, 0)])
    other = points(spark, [(1, 2, 0, 0), (1, 3, 0, 0)])
    assert {(r.frame_id, r.status) for r in evaluate.align(truth, other).collect()} == {(1, "truth_only"), (2, "both"), (3, "prediction_only")}
    models = spark.createDataFrame([("m",)], "model string")
    cover = evaluate.coverage(other.withColumn("model", F.lit("m")), truth, models)
    assert {(r.frame_id, r.status) for r in cover.collect()} == {(1, "missing"), (3, "extra")}
    models = spark.range(1500).selectExpr("concat('m', id) AS model")
    assert evaluate.coverage(truth.crossJoin(models), truth, models).isEmpty()
    assert evaluate.coverage(truth.where("frame_id = 1").crossJoin(models), truth, models).count() == 1500


def test_score_is_exact(spark):
    truth = points(spark, [(1, 1, 0, 0), (1, 2, 0, 0)])
    whole = points(spark, [(1, 1, 3, 4), (1, 2, 0, 0)])
    assert evaluate.pooled(evaluate.score(truth, whole)).first().n == 2
    two = whole.withColumn("model", F.lit("a")).unionByName(truth.withColumn("model", F.lit("b")))
    assert {(r.model, r.n) for r in evaluate.pooled(evaluate.score(truth, two), "model").collect()} == {("a", 2), ("b", 2)}
    nan = points(spark, [(1, 1, float("nan"), 4), (1, 2, 0, 0)])
    bad = [
        (truth, whole.where("frame_id = 1")),
        (truth.where("frame_id = 1"), whole),
        (truth, whole.unionByName(whole.limit(1))),
        (truth.unionByName(truth.limit(1)), whole),
        (truth, nan),
        (nan, whole),
        (truth, two.where("NOT (model = 'a' AND frame_id = 1)")),
        (truth, two.unionByName(two.limit(1))),
        (truth, whole.where("false")),
    ]
    for t, p in bad:
        with pytest.raises(Exception, match="forecast|label|model"):
            evaluate.score(t, p).collect()
    assert [tuple(r)[-2:] for r in evaluate.score(truth, whole.where("frame_id = 1"), partial=True).collect()] == [(3.0, 4.0)]


def test_wide_scores_are_exact(spark):
    truth = points(spark, [(1, 1, 0, 0), (1, 2, 0, 0)])
    made = points(spark, [(1, 1, 3, 4), (1, 2, 0, 0)]).selectExpr(*KEYS, "x AS x_a", "y AS y_a", "x + 1 AS x_b", "y AS y_b")
    got = evaluate.score_wide(truth, made, ["a", "b"])
    assert sorted(tuple(r)[0:1] + tuple(r)[-3:] for r in got.collect()) == [("a", 1, 3.0, 4.0), ("a", 2, 0.0, 0.0), ("b", 1, 4.0, 4.0), ("b", 2, 1.0, 0.0)]
    bad = [
        (truth, made.where("frame_id = 1")),
        (truth.where("frame_id = 1"), made),
        (truth, made.unionByName(made.limit(1))),
        (truth.unionByName(truth.limit(1)), made),
        (truth, made.withColumn("y_b", F.lit(float("nan")))),
        (truth, made.withColumn("x_a", F.lit(None).cast("double"))),
        (truth.withColumn("x", F.lit(float("inf"))), made),
        (truth, made.where("false")),
    ]
    for t, p in bad:
        with pytest.raises(Exception, match="forecast|label"):
            evaluate.score_wide(t, p, ["a", "b"]).collect()


def test_requests_need_history(spark):
    table, asked = observed(spark), requests(spark, players=4)
    for use in (lambda: predict(table, asked, ["last_position"]), lambda: design(table, asked).select("fx1"), lambda: predict(table, asked, ["last_position"]).groupBy().count()):
        with pytest.raises(Exception, match="no history of the request 1, 1, 4"):
            use().collect()


def test_weights_have_one_global_row(spark):
    designed = design(observed(spark), requests(spark))
    schema, w = "player_role string, w array<double>", [0.1] * 6
    assert ridge_predict(designed, spark.createDataFrame([(None, w)], schema)).count() == 36
    for rows in ([("a", w)], [(None, w), (None, w)], [(None, w), ("a", w), ("a", w)]):
        with pytest.raises(Exception, match="not one row of weights"):
            ridge_predict(designed, spark.createDataFrame(rows, schema)).collect()


def test_states_of_shards_merge(spark):
    rng = random.Random(3)
    rows = [(1, p, n, f, rng.uniform(0, 9), rng.uniform(0, 9), 1.0, 2.0, 12, f"r{f}") for p in (1, 2) for n in (1, 2, 3) for f in rng.sample(range(1, 30), rng.randint(1, 20))]
    table = spark.createDataFrame(rows, OBSERVED)
    whole = sorted(map(tuple, observed_state(table).collect()))
    for parts in (2, 5):
        shards = [state.partial_state(table.where(F.pmod(F.xxhash64("frame_id", "nfl_id"), F.lit(parts)) == k)) for k in range(parts)]
        assert sorted(map(tuple, state.finished(state.merged(*shards)).collect())) == whole
    plan = observed_state(table)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_exact_percentile(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.lognormal(size=1000), "b": rng.integers(0, 3, 501) * 1.0, "c": np.zeros(7), "d": np.array([5.0])}
    table = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k string, d double").repartition(3)
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.d for r in evaluate.exact_percentile(table, "d", share, "k").collect()}
        assert got == pytest.approx({k: np.quantile(v, share) for k, v in groups.items()})


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        (lambda t: t.unionByName(t.limit(1)), "unique"),
        (lambda t: t.withColumn("x", F.when(F.col("frame_id") == 1, F.lit(float("nan"))).otherwise(F.col("x"))), "finite"),
        (lambda t: t.withColumn("y", F.when(F.col("frame_id") == 1, F.lit(float("inf"))).otherwise(F.col("y"))), "finite"),
        (lambda t: t.withColumn("x", F.when(F.col("frame_id") != 1, F.col("x"))), "finite"),
        (lambda t: t.withColumn("frame_id", F.col("frame_id") - 1), "keys"),
        (lambda t: t.withColumn("game_id", F.when(F.col("frame_id") != 1, F.col("game_id"))), "keys"),
        (lambda t: t.withColumn("num_frames_output", F.lit(0).cast("long")), "horizon"),
    ],
)
def test_negatives(spark, change, rule):
    good = observed(spark)
    validate.require(validate.rules_for_observed(good), good)
    with pytest.raises(validate.Invalid, match=rule):
        validate.require(validate.rules_for_observed(change(good)))


def test_more_negatives(spark):
    good = observed(spark)
    with pytest.raises(validate.Invalid, match="empty"):
        validate.require({}, good.where("false"))
    with pytest.raises(validate.Invalid, match="missing columns: x"):
        validate.rules_for_observed(good.drop("x"))
    with pytest.raises(validate.Invalid, match="history"):
        validate.require(validate.rules_for_pair(requests(spark, 4), good))
    assert validate.beyond_horizon(requests(spark, 1, 13), observed_state(good)).count() == 1
    assert not any(r.contiguous for r in validate.contiguity(good).collect())
    assert all(r.contiguous for r in validate.contiguity(observed(spark, frames=(1, 2, 3))).collect())


def test_split(spark):
    days = [20240101 + d for d in range(20)]
    games = spark.createDataFrame([(d * 100 + g,) for d in days for g in (0, 1)] * 2, "game_id long")
    got = split_games(games).collect()
    assert len(got) == 40
    place = {}
    for r in got:
        place.setdefault(r.game_date, set()).add(r.split)
    assert all(len(s) == 1 for s in place.values())
    order = [next(iter(place[d])) for d in sorted(place)]
    assert order == ["train"] * 14 + ["validation"] * 3 + ["holdout"] * 3
    enough_days(games)
    with pytest.raises(ValueError):
        enough_days(games.limit(1))


def test_golden_two_models_on_synthetic(spark):
    b = synthetic(spark)
    assert (b.observed.count(), b.labels.count()) == (288, 432)
    assert b.observed.exceptAll(synthetic(spark).observed).isEmpty()
    errors = evaluate.score(b.labels, predict(b.observed, b.requests, ["constant_velocity_frames", "last_position"]))
    by = {(r.model, r.partition): r for r in evaluate.by_partition(errors, b.splits).collect()}
    assert {p: by["last_position", p].n for p in ("train", "validation", "holdout")} == {"train": 216, "validation": 72, "holdout": 144}
    assert round(by["constant_velocity_frames", "holdout"].rmse, 12) == 0.263475522816
    assert round(by["last_position", "holdout"].rmse, 12) == 2.097543662939
    assert by["constant_velocity_frames", "train"].rmse == pytest.approx(0.28268430878640, abs=1e-12)
    assert by["last_position", "validation"].rmse == pytest.approx(1.77512537172492, abs=1e-12)
    past, future = two_player_play(spark)
    assert (past.count(), future.count()) == (20, 40)


def test_weekly_audit(spark):
    rows = [("01", 2024010100 + d * 100, 1, 1, f, 1.0, 1.0, 2, "True") for d in range(12) for f in (1, 2)]
    inputs = spark.createDataFrame(rows, "week string, game_id long, play_id long, nfl_id long, frame_id long, x double, y double, num_frames_output long, player_to_predict string")
    outputs = inputs.select("week", *KEYS, "x", "y")
    assert all(v.isEmpty() for v in weekly.violations(inputs, outputs).values())
    assert weekly.violations(inputs, outputs.where("frame_id = 1"))["horizons"].count() == 12
    assert weekly.violations(inputs.withColumn("player_to_predict", F.lit("maybe")), outputs)["flags"].count() == 24
    moved = inputs.withColumn("week", F.when(F.col("frame_id") == 1, "02").otherwise("01"))
    assert weekly.violations(moved, outputs)["games"].count() == 12
    s = weekly.summary(inputs, outputs).first()
    assert (s.input_rows, s.plays, len(s.games), s.output_rows, s.entities) == (24, 12, 12, 24, 12)
    assert sum(r["count"] for r in weekly.split_counts(inputs).collect()) == 12


def test_reports(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model string, rmse double")
    new = spark.createDataFrame([("a", 1.0000001), ("c", 2.0)], "model string, rmse double")
    got = {(r.model, r.passed) for r in report.assertions(old, new, ["model"], ["rmse"]).collect()}
    assert got == {("a", True), ("b", False), ("c", False)}
    assert tuple(old.limit(1).select(*report.ratios(F.lit(4.0), F.lit(1.0))).first()) == (3.0, 75.0, 4.0)
    b = synthetic(spark)
    one = report.selection_export(b.observed, b.labels, predict(b.observed, b.requests, ["last_position"])).first()
    document = json.loads(one.document)
    assert [len(document[k]) for k in ("inputs", "requests", "predictions", "labels")] == [24, 36, 36, 36]
    assert "<td>a</td>" in report.html_table(old, ["model"], "t & u")
