"""Exact alignment of forecasts with truth, pooled metrics, slices and comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.motion import finite, horizon_bucket
from ..schema import ENTITY, KEYS
from .draws import resample_counts


def align(truth: DataFrame, prediction: DataFrame) -> DataFrame:
    """Full outer join on the keys, with `status` both, truth_only or prediction_only."""
    t = truth.select(*KEYS, F.col("x").alias("tx"), F.col("y").alias("ty"), F.lit(1).alias("in_truth"))
    p = prediction.select(*KEYS, F.col("x").alias("px"), F.col("y").alias("py"), F.lit(1).alias("in_prediction"))
    status = (
        F.when(F.col("in_truth").isNull(), "prediction_only")
        .when(F.col("in_prediction").isNull(), "truth_only")
        .otherwise("both")
    )
    return t.join(p, KEYS, "full_outer").withColumn("status", status).drop("in_truth", "in_prediction")


def score(truth: DataFrame, prediction: DataFrame, models: Sequence[str] | None = None, partial: bool = False) -> DataFrame:
    """Signed residuals dx, dy of each key; a model column stays.

    Truth and forecast must hold the same keys, each once (for every model), with finite coordinates: any
    missing, extra, repeated or non-finite row raises when the result is read. `models` names those
    that each key must have; where it is left out, all models found anywhere are. With `partial`, only matching rows are
    scored and nothing raises. Both sides are dealt by the keys once. score_wide does with fewer rows.
    """
    named = "model" in prediction.columns
    extra = ["model"] if named else []
    t = truth.select(*KEYS, F.col("x").alias("tx"), F.col("y").alias("ty"))
    residuals = [(F.col("x") - F.col("tx")).alias("dx"), (F.col("y") - F.col("ty")).alias("dy")]
    if partial:
        return prediction.join(t, KEYS).select(*extra, *KEYS, *residuals)
    expected = F.array(*[F.lit(m) for m in sorted(models)]) if named and models else F.array(F.lit(""))
    if named and models is None:  # a value of the plan, not a job while it is built
        expected = prediction.agg(F.sort_array(F.collect_set("model"))).scalar()
    label = F.col("model") if named else F.lit("")
    made = prediction.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(label.alias("model"), "x", "y"))).alias("made"))
    known = t.groupBy(*KEYS).agg(F.count("*").alias("n"), F.first("tx").alias("tx"), F.first("ty").alias("ty"))
    off = (
        F.when(F.col("n").isNull(), "extra forecast")
        .when(F.col("made").isNull(), "missing forecast")
        .when(F.col("n") > 1, "repeated label")
        .when(F.col("made.model") != expected, "missing, extra or repeated model")
        .when(~(finite(F.col("tx")) & finite(F.col("ty"))), "label that is not finite")
        .when(F.exists("made", lambda p: ~(finite(p["x"]) & finite(p["y"]))), "forecast that is not finite")
    )
    key = F.concat_ws(", ", *KEYS)
    checked = F.when(off.isNull(), F.col("made")).otherwise(F.raise_error(F.concat(off, F.lit(" at "), key)))
    joined = made.join(known, KEYS, "full_outer").select(*KEYS, "tx", "ty", F.explode(checked).alias("p"))
    return joined.select(*[F.col("p.model").alias(c) for c in extra], *KEYS, F.col("p.x").alias("x"), F.col("p.y").alias("y"), "tx", "ty").select(
        *extra, *KEYS, *residuals
    )


def score_wide(truth: DataFrame, forecasts: DataFrame, models: Sequence[str]) -> DataFrame:
    """score for forecasts with a row per key and columns x_<model>, y_<model>: (model, keys, dx, dy), exact in the same way.

    Truth and forecasts meet in one aggregation by key, so a key is exchanged twice, not once a model; models become rows at the end.
    """
    both = [f"{a}_{m}" for m in models for a in "xy"]
    absent = [F.lit(None).cast("double").alias(c) for c in both]
    t = truth.select(*KEYS, F.col("x").alias("tx"), F.col("y").alias("ty"), F.lit(1).alias("_t"), F.lit(0).alias("_f"), *absent)
    f = forecasts.select(*KEYS, *[F.lit(None).cast("double").alias(c) for c in ("tx", "ty")], F.lit(0).alias("_t"), F.lit(1).alias("_f"), *both)
    met = t.unionByName(f).groupBy(*KEYS).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("tx", "ty", *both)], F.sum("_t").alias("_t"), F.sum("_f").alias("_f"))
    known = lambda *columns: reduce(lambda x, y: x & y, [finite(F.col(c)) for c in columns])
    off = (
        F.when(F.col("_t") == 0, "extra forecast")
        .when(F.col("_f") == 0, "missing forecast")
        .when(F.col("_t") > 1, "repeated label")
        .when(F.col("_f") > 1, "repeated forecast")
        .when(~known("tx", "ty"), "label that is not finite")
        .when(~known(*both), "forecast that is not finite")
    )
    each = [F.struct(F.lit(m).alias("model"), (F.col(f"x_{m}") - F.col("tx")).alias("dx"), (F.col(f"y_{m}") - F.col("ty")).alias("dy")) for m in models]
    checked = F.when(off.isNull(), F.array(*each)).otherwise(F.raise_error(F.concat(off, F.lit(" at "), F.concat_ws(", ", *KEYS))))
    return met.select(*KEYS, F.explode(checked).alias("p")).select("p.model", *KEYS, "p.dx", "p.dy")


def squared() -> Column:
    return F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")


def distance() -> Column:
    return F.sqrt(squared())


def rmse(sse: Column, n: Column) -> Column:
    """Pooled over both coordinates: never a mean of group values."""
    return F.sqrt(sse / (2.0 * n))


def pooled(errors: DataFrame, *by: str | Column) -> DataFrame:
    """Per group: rows n, sse and rmse."""
    grouped = errors.groupBy(*by).agg(F.count("*").alias("n"), F.sum(squared()).alias("sse"))
    return grouped.withColumn("rmse", rmse(F.col("sse"), F.col("n")))


def exact_percentile(rows: DataFrame, value: str, share: float, *by: str) -> DataFrame:
    """(by, value) with linear interpolation between order statistics, and no task that holds a group's values.

    Values are counted by narrow logarithmic buckets; the distinct values of the one or two buckets that hold the wanted ranks
    are then counted and ranked. Values must be finite and not negative.
    """
    bucket = F.when(F.col(value) > 0, F.floor(F.log2(value) * 256)).otherwise(F.lit(-(1 << 40))).alias("_b")
    keyed = rows.select(*by, F.col(value).alias("_v"), bucket)
    up_to = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    at = F.lit(share) * (F.sum("_n").over(Window.partitionBy(*by)) - 1)
    wanted = (
        keyed.groupBy(*by, "_b")
        .agg(F.count("*").alias("_n"))
        .select(*by, "_b", at.alias("_at"), F.sum("_n").over(up_to).alias("_end"), "_n")
        .where((F.col("_end") > F.floor("_at")) & (F.col("_end") - F.col("_n") <= F.ceil("_at")))
    )
    near = keyed.join(wanted, [*by, "_b"]).groupBy(*by, "_b", "_v", "_at", (F.col("_end") - F.col("_n")).alias("_first")).agg(F.count("*").alias("_k"))
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("_last", F.col("_first") + F.sum("_k").over(inside) - 1)
    holds = lambda rank: (F.col("_last") >= rank) & (F.col("_last") - F.col("_k") < rank)
    low, high = (F.min(F.when(holds(f("_at")), F.col("_v"))) for f in (F.floor, F.ceil))
    out = ranked.groupBy(*by).agg(low.alias("_low"), high.alias("_high"), F.first("_at").alias("_at"))
    return out.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at"))).alias(value))


def error_metrics(errors: DataFrame, *by: str) -> DataFrame:
    """rmse, ade, trajectory ade, fde, p95 and mae of each group.

    The trajectory means and last-frame distances come from one row per entity; the
    sums from the rows themselves, and the exact percentile from counts of ever fewer of them.
    """
    d = errors.withColumn("d", distance())
    flat = d.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sqrt(F.sum(squared()) / (2.0 * F.count("*"))).alias("coordinate_rmse"),
        F.avg("d").alias("frame_ade"),
        (F.sum(F.abs("dx") + F.abs("dy")) / (2.0 * F.count("*"))).alias("coordinate_mae"),
    )
    per = d.groupBy(*by, *ENTITY).agg(F.avg("d").alias("mean"), F.max_by("d", "frame_id").alias("final"))
    tracks = per.groupBy(*by).agg(F.avg("mean").alias("trajectory_ade"), F.avg("final").alias("fde"))
    tail = exact_percentile(d, "d", 0.95, *by).withColumnRenamed("d", "p95_displacement")
    out = flat.join(tracks, list(by)).join(tail, list(by)) if by else flat.crossJoin(tracks).crossJoin(tail)
    return out.select(
        *by, "n", "coordinate_rmse", "frame_ade", "trajectory_ade", "fde", "p95_displacement", "coordinate_mae"
    )


def by_partition(errors: DataFrame, splits: DataFrame) -> DataFrame:
    return pooled(errors.join(splits, "game_id"), "model", "partition")


def by_horizon(errors: DataFrame, width: int = 4) -> DataFrame:
    return pooled(errors.withColumn("bucket", horizon_bucket(F.col("frame_id"), width)), "model", "bucket")


def slices(errors: DataFrame, splits: DataFrame, frames: Sequence[tuple[int, int]] = ((1, 4), (5, 8), (9, 12))) -> DataFrame:
    """(model, partition, slice, value, n, sse, rmse): totals of each partition, its slices by horizon and by game, from one scan of errors.

    One aggregation over grouping sets makes them all. Its rows, few whatever the errors, are then reconciled: a game without a partition,
    a frame in no horizon, an empty horizon, or slices that don't add up to their total raise when the result is read.
    """
    bucket = F.lit(None).cast("string")
    names = [f"frames_{low}_{high}" for low, high in frames]
    for name, (low, high) in zip(names, frames, strict=True):
        bucket = F.when(F.col("frame_id").between(low, high), name).otherwise(bucket)
    dealt = errors.join(splits.select("game_id", "partition"), "game_id", "left").withColumn("horizon", bucket)
    keys = ["model", "partition"]
    sets = [[F.col(c) for c in (*keys, *more)] for more in ([], ["horizon"], ["game_id"])]
    kind = F.when(F.grouping("horizon") == 0, "horizon").when(F.grouping("game_id") == 0, "game").otherwise("total").alias("slice")
    made = dealt.groupingSets(sets, *keys, "horizon", "game_id").agg(F.count("*").alias("n"), F.sum(squared()).alias("sse"), kind)
    of = Window.partitionBy(*keys)
    rows = lambda name: F.coalesce(F.sum(F.when(F.col("slice") == name, F.col("n"))).over(of), F.lit(0))
    there = F.sort_array(F.collect_set(F.when(F.col("slice") == "horizon", F.col("horizon"))).over(of))
    wrong = (
        F.when(F.col("partition").isNull(), "a game without a partition")
        .when((F.col("slice") == "horizon") & F.col("horizon").isNull(), "a frame in no horizon")
        .when(there != F.array(*map(F.lit, sorted(names))), "an empty horizon")
        .when((rows("horizon") != rows("total")) | (rows("game") != rows("total")), "slices that do not cover the total")
    )
    value = F.coalesce("horizon", F.col("game_id").cast("string"), F.lit("all"))
    checked = made.withColumn("value", F.when(wrong.isNull(), value).otherwise(F.raise_error(wrong)))
    return checked.select(*keys, "slice", "value", "n", "sse").withColumn("rmse", rmse(F.col("sse"), F.col("n")))


def trajectory_diagnostics(errors: DataFrame) -> DataFrame:
    """One row per model and entity: n, sse (added by frame, so that no digit depends on the order of rows), rmse, ade, last frame, fde, largest displacement."""
    d = errors.withColumn("d", distance())
    return (
        d.groupBy("model", *ENTITY)
        .agg(
            F.count("*").alias("n"),
            F.aggregate(F.sort_array(F.collect_list(F.struct("frame_id", squared().alias("e")))), F.lit(0.0), lambda at, r: at + r["e"]).alias("sse"),
            F.avg("d").alias("ade"),
            F.max("frame_id").alias("last_frame"),
            F.max_by("d", "frame_id").alias("fde"),
            F.max("d").alias("max_displacement"),
        )
        .withColumn("rmse", rmse(F.col("sse"), F.col("n")))
    )


def ranked(diagnostics: DataFrame) -> DataFrame:
    """Worst trajectories first, ties by key."""
    return diagnostics.orderBy(F.desc("sse"), *ENTITY)


def paired_by_game(errors: DataFrame) -> DataFrame:
    """For each pair of models a < b: rmse and sse deltas (b - a) per game, and pooled (game null).

    Sums per (model, game) are joined, not rows: the pairs are few.
    """
    sums = errors.groupBy("model", "game_id").agg(F.count("*").alias("n"), F.sum(squared()).alias("sse"))
    a = sums.select(F.col("model").alias("model_a"), "game_id", "n", F.col("sse").alias("sse_a"))
    b = sums.select(F.col("model").alias("model_b"), "game_id", F.col("sse").alias("sse_b"))
    both = a.join(b, "game_id").where("model_a < model_b")
    total = F.grouping_id()
    grouped = (
        both.groupingSets([[F.col("model_a"), F.col("model_b"), F.col("game_id")], [F.col("model_a"), F.col("model_b")]], "model_a", "model_b", "game_id")
        .agg(F.sum("n").alias("n"), F.sum("sse_a").alias("sse_a"), F.sum("sse_b").alias("sse_b"), (total > 0).alias("is_pooled"))
    )
    return grouped.withColumns(
        {
            "rmse_delta": rmse(F.col("sse_b"), F.col("n")) - rmse(F.col("sse_a"), F.col("n")),
            "sse_delta": F.col("sse_b") - F.col("sse_a"),
        }
    )


def pairing(errors: DataFrame) -> DataFrame:
    """(model_a, model_b, games, unmatched, pairable): pairing wants equal keys and two games at least.

    Keys without a partner are those of either model less twice those of both, so only counts are needed: of each set of models in each game
    (keys are grouped once), then per model and per pair within a set. Just the models' names meet each other.
    """
    sets = errors.groupBy(*KEYS).agg(F.sort_array(F.collect_set("model")).alias("models")).groupBy("models", "game_id").agg(F.count("*").alias("n"))
    each = sets.select(F.explode("models").alias("model"), "n").groupBy("model").agg(F.sum("n").alias("n"))
    of = F.col("models")
    pairs = F.flatten(F.transform(of, lambda a: F.transform(F.filter(of, lambda b: b > a), lambda b: F.struct(a.alias("model_a"), b.alias("model_b")))))
    met = sets.select(F.explode(pairs).alias("p"), "game_id", "n").groupBy("p.model_a", "p.model_b")
    met = met.agg(F.countDistinct("game_id").alias("games"), F.sum("n").alias("both"))
    a, b = (each.select(F.col("model").alias(f"model_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    unmatched = F.col("n_a") + F.col("n_b") - 2 * F.coalesce("both", F.lit(0))
    out = a.join(b, F.col("model_a") < F.col("model_b")).join(met, ["model_a", "model_b"], "left")
    out = out.select("model_a", "model_b", F.coalesce("games", F.lit(0)).cast("long").alias("games"), unmatched.cast("long").alias("unmatched"))
    return out.withColumn("pairable", (F.col("unmatched") == 0) & (F.col("games") >= 2))


def require_pairable(errors: DataFrame) -> None:
    """Raises unless each two models cover the same keys, of two games at least."""
    bad = pairing(errors).where("NOT pairable").select("model_a", "model_b").orderBy("model_a", "model_b").first()
    if bad:
        raise ValueError(f"{bad.model_a} and {bad.model_b} can't be paired")


def win_loss(paired: DataFrame) -> DataFrame:
    """Games that the second model of a pair wins, loses and ties."""
    delta = F.col("sse_delta")
    return (
        paired.where("NOT is_pooled")
        .groupBy("model_a", "model_b")
        .agg(F.count_if(delta < 0).alias("wins"), F.count_if(delta > 0).alias("losses"), F.count_if(delta == 0).alias("ties"))
    )


def leave_one_out(errors: DataFrame) -> DataFrame:
    """The pooled rmse of all other games, from group sums without another scan."""
    sums = errors.groupBy("model", "game_id").agg(F.count("*").alias("n"), F.sum(squared()).alias("sse"))
    every = Window.partitionBy("model")
    rest, n = F.sum("sse").over(every) - F.col("sse"), F.sum("n").over(every) - F.col("n")
    return sums.select("model", "game_id", n.alias("n"), F.sqrt(F.try_divide(rest, 2.0 * n)).alias("rmse"))


def timeline(errors: DataFrame) -> DataFrame:
    return pooled(errors, "model", "frame_id")


def cumulative(errors: DataFrame) -> DataFrame:
    """The pooled metric of frames up to each horizon, by a running sum over per-frame sums."""
    frames = errors.groupBy("model", "frame_id").agg(F.count("*").alias("n"), F.sum(squared()).alias("sse"))
    up_to = Window.partitionBy("model").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
    return frames.select(
        "model", F.col("frame_id").alias("horizon"), F.sum("n").over(up_to).alias("n"), F.sum("sse").over(up_to).alias("sse")
    ).withColumn("rmse", rmse(F.col("sse"), F.col("n")))


def bootstrap(errors: DataFrame, repeats: int = 2000, seed: int = 2026) -> DataFrame:
    """(model, rep, rmse): whole games, in the order of their ids, drawn with replacement as numpy.random.default_rng(seed) does.

    Rows are summed per game. Draws, as many as games in each repetition, are made in tasks and counted
    by (rep, game) before they meet the sums. One row per game reaches the unpartitioned window.
    """
    sums = errors.groupBy("model", "game_id").agg(F.count("*").alias("n"), F.sum(squared()).alias("sse"))
    games = sums.select("game_id").distinct()
    count = games.count()
    if not count or repeats < 1:
        raise ValueError("nothing to resample")
    numbered = games.withColumn("g", (F.row_number().over(Window.orderBy("game_id")) - 1).cast("long"))
    return (
        resample_counts(errors.sparkSession, seed, repeats, count).join(sums.join(numbered, "game_id"), "g")
        .groupBy("model", "rep")
        .agg(F.sum(F.col("sse") * F.col("times")).alias("sse"), F.sum(F.col("n") * F.col("times")).alias("n"))
        .select("model", "rep", rmse(F.col("sse"), F.col("n")).alias("rmse"))
    )


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    """Keys of left without a row in right."""
    return left.select(*keys).join(right.select(*keys), list(keys), "left_anti")


def coverage(predictions: DataFrame, requests: DataFrame, models: DataFrame) -> DataFrame:
    """(model, keys, status): what is required but missing, or extra (present but not required), once each.

    Every model needs every request. Models have numbers, and a key a bitmap of those it has, in words of 64; only bits that are absent, or
    set where nothing was asked, become rows, so the product of models and requests is never made.
    """
    full = models.where("model IS NOT NULL").agg(F.sort_array(F.collect_set("model")).alias("m")).select("m").scalar()
    place = F.coalesce(F.array_position(full, F.col("model")), F.lit(0)) - 1
    have = predictions.select("model", *KEYS).withColumn("_p", place)
    asked = requests.select(*KEYS, F.lit(-1).cast("long").alias("_w"), F.lit(0).cast("long").alias("_bits"))
    bit = F.expr("shiftleft(1L, CAST(_p % 64 AS INT))")
    words = asked.unionByName(have.where("_p >= 0").select(*KEYS, F.expr("_p div 64").alias("_w"), bit.alias("_bits")))
    words = words.groupBy(*KEYS, "_w").agg(F.bit_or("_bits").alias("_bits"))
    held = F.map_from_entries(F.collect_list(F.struct("_w", "_bits")))
    keys = words.groupBy(*KEYS).agg(held.alias("_held")).withColumn("_all", full)
    word = lambda p: F.coalesce(F.try_element_at("_held", F.floor(p / 64)), F.lit(0).cast("long"))
    wanted = F.map_contains_key("_held", F.lit(-1).cast("long"))
    off = F.filter(F.transform("_all", lambda m, p: F.struct(m.alias("model"), F.getbit(word(p), F.pmod(p, F.lit(64)).cast("int")).alias("has"))), lambda x: (x["has"] == 1) != wanted)
    status = F.when(wanted, "missing").otherwise("extra").alias("status")
    known = keys.select(*KEYS, status, F.explode(off).alias("x")).select("x.model", *KEYS, "status")
    others = have.where("_p < 0").select("model", *KEYS).distinct().withColumn("status", F.lit("extra"))
    return known.unionByName(others)
