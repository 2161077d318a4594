"""Registered queries over the driver tables; floats are rounded so that both engines agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import uri
from ..functions.exact import rounded
from ..functions.motion import MODELS
from ..operators import digest, evaluate, evidence, order, references, report, ridge, scan, select, sums, validate
from ..operators.forecast import design, predict, ridge_predict, wide
from ..operators.split import split_games
from ..operators.state import observed_state
from ..schema import ENTITY, KEYS
from ..sources import strict
from ..sources.events import load
from ..sources.synthetic import partitions

COMPARED = ("last_position", "constant_velocity", "smoothed_velocity", "constant_acceleration", "ball_arrival", "damped_velocity")
#: Weights of the example model: everyone's, and those of one role.
GLOBAL_WEIGHTS = [0.6, 0.2, 0.1, 0.05, 0.03, 0.02]
ROLE_WEIGHTS = {"click": [0.3, 0.3, 0.0, 0.2, 0.1, 0.1]}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(*columns: str, digits: int = 6) -> list[Column]:
    return [F.round(F.col(c), digits).alias(c) for c in columns]


def exact(*columns: str) -> list[Column]:
    """Rounded as their exact values are: for figures that both engines compute to the last bit."""
    return [rounded(F.col(c)).alias(c) for c in columns]


def errors(spark: SparkSession, sf_dir: str, models: tuple[str, ...] = COMPARED) -> DataFrame:
    t = load(spark, sf_dir)
    return evaluate.score_wide(t.labels, wide(t.observed, t.requests, models), models)


def _forecast(model: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = load(spark, sf_dir)
        return predict(t.observed, t.requests, [model]).select(*KEYS, *exact("x", "y"))

    return run


FORECASTS = {
    "hold_forecast": "last_position",
    "cv_forecast_elapsed": "constant_velocity",
    "cv_forecast_frames": "constant_velocity_frames",
    "smoothed_forecast": "smoothed_velocity",
    "const_accel_forecast": "constant_acceleration",
    "ball_arrival_forecast": "ball_arrival",
    "damped_forecast": "damped_velocity",
}
assert set(FORECASTS.values()) == set(MODELS)


@query
def rmse_by_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: events to tracks, forecasts, errors and pooled metrics per game."""
    out = evaluate.pooled(errors(spark, sf_dir, ("constant_velocity_frames", "last_position")), "model", "game_id")
    return out.select("model", "game_id", "n", *r6("rmse"))


@query
def terminal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = observed_state(load(spark, sf_dir).observed)
    return state.select(*ENTITY, *r6("x", "y", "vx", "vy", "dx", "dy", "ax", "ay"), "player_role", "n_observed", "contiguous")


@query
def smoothed_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed_state(load(spark, sf_dir).observed).select(*ENTITY, *r6("sx", "sy"))


for _name, _model in FORECASTS.items():
    QUERIES[_name] = _forecast(_model)


@query
def motion_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir)
    return design(t.observed, t.requests).select(*KEYS, *exact(*[f"f{a}{k}" for a in "xy" for k in range(1, 7)]))


@query
def role_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean second moments per role and in total."""
    t = load(spark, sf_dir)
    out = ridge.sufficient_statistics(design(t.observed, t.requests), t.labels)
    return out.select("player_role", "is_total", "n", *[F.round(F.col(c) / F.col("n"), 4).alias(c) for c in ridge.SUMS])


@query
def ridge_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of a model with given weights; unknown roles use everyone's."""
    t = load(spark, sf_dir)
    rows = [(None, GLOBAL_WEIGHTS), *ROLE_WEIGHTS.items()]
    weights = spark.createDataFrame(rows, "player_role string, w array<double>")
    return ridge_predict(design(t.observed, t.requests), weights).select(*KEYS, *exact("x", "y"))


@query
def ridge_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a model fitted on the training games, per game."""
    t = load(spark, sf_dir)
    train = partitions(spark).where("partition = 'train'").select("game_id")
    fitted = ridge.fit_statistics(ridge.sufficient_statistics(design(t.observed, t.requests.join(train, "game_id", "left_semi")), t.labels))
    out = ridge_predict(design(t.observed, t.requests), ridge.weights_table(spark, fitted)).withColumn("model", F.lit("role_ridge"))
    return evaluate.pooled(evaluate.score(t.labels, out, ["role_ridge"]), "model", "game_id").select("model", "game_id", "n", *r6("rmse"))


@query
def metrics_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.error_metrics(errors(spark, sf_dir), "model")
    return out.select("model", "n", *r6("coordinate_rmse", "frame_ade", "trajectory_ade", "fde", "p95_displacement", "coordinate_mae"))


@query
def rmse_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_partition(errors(spark, sf_dir), partitions(spark)).select("model", "partition", "n", *r6("rmse"))


@query
def rmse_by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_horizon(errors(spark, sf_dir)).select("model", "bucket", "n", *r6("rmse"))


@query
def holdout_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout games up to frame 6, filtered before anything is forecast."""
    t = load(spark, sf_dir)
    games = partitions(spark).where("partition = 'holdout'").select("game_id")
    labels = t.labels.where("frame_id <= 6").join(games, "game_id", "left_semi")
    found = evaluate.score_wide(labels, wide(t.observed, labels, COMPARED), COMPARED)
    return evaluate.pooled(found, "model").select("model", "n", *r6("rmse"))


@query
def trajectory_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.trajectory_diagnostics(errors(spark, sf_dir, ("constant_velocity", "ball_arrival")))
    return out.select("model", *ENTITY, "n", "last_frame", *exact("sse"), *r6("rmse", "ade", "fde", "max_displacement"))


@query
def paired_by_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.paired_by_game(errors(spark, sf_dir))
    return out.select("model_a", "model_b", "game_id", "is_pooled", "n", *r6("rmse_delta"), *r6("sse_delta", digits=3))


@query
def paired_win_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.win_loss(evaluate.paired_by_game(errors(spark, sf_dir)))


@query
def leave_one_game_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.leave_one_out(errors(spark, sf_dir)).select("model", "game_id", "n", *r6("rmse"))


@query
def error_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.timeline(errors(spark, sf_dir)).select("model", "frame_id", "n", *r6("rmse"))


@query
def cumulative_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.cumulative(errors(spark, sf_dir)).select("model", "horizon", "n", *r6("rmse"))


@query
def track_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pooled(errors(spark, sf_dir), "model", "nfl_id").select("model", "nfl_id", "n", *r6("rmse"))


@query
def bootstrap_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.bootstrap(errors(spark, sf_dir, ("constant_velocity", "last_position")), repeats=2000)
    return out.select("model", "rep", *r6("rmse"))


def _incomplete(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = load(spark, sf_dir)
    predicted = predict(t.observed, t.requests, ["last_position"]).where("(frame_id + nfl_id) % 10 != 0")
    return t.labels.where("NOT (frame_id = 12 AND nfl_id % 7 = 0)"), predicted


@query
def alignment_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How truth and forecast align when both lack rows."""
    truth, predicted = _incomplete(spark, sf_dir)
    return evaluate.align(truth, predicted).groupBy("game_id", "status").agg(F.count("*").alias("n"))


@query
def request_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, predicted = _incomplete(spark, sf_dir)
    return evaluate.missing_keys(truth, predicted)


@query
def coverage_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, predicted = _incomplete(spark, sf_dir)
    models = spark.createDataFrame([("last_position",), ("constant_velocity",)], "model string")
    return evaluate.coverage(predicted, truth.select(*KEYS), models).groupBy("model", "status").agg(F.count("*").alias("n"))


@query
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    found = validate.duplicate_keys(items, ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", "l_linenumber", F.col("count").alias("n"))


@query
def contiguity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities without every frame of 1..n, after every ninth has lost its third frame."""
    t = load(spark, sf_dir)
    return validate.contiguity(t.observed.where("NOT (nfl_id % 9 = 0 AND frame_id = 3)")).groupBy("contiguous", "n").agg(F.count("*").alias("entities"))


@query
def horizon_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose outputs miss frames, or that are expected or present on one side only."""
    t = load(spark, sf_dir)
    expected = observed_state(t.observed).where("nfl_id % 11 != 0")
    return validate.horizon_audit(t.labels.where("NOT (frame_id = 12 AND nfl_id % 7 = 0)"), expected).select(
        *ENTITY, "first", "last", "n", "num_frames_output"
    )


@query
def nonfinite_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are not finite once every 13th player's x is unknown and every 17th player's y is not a number."""
    t = load(spark, sf_dir).observed
    odd = t.withColumn("x", F.when(F.col("nfl_id") % 13 != 0, F.col("x"))).withColumn(
        "y", F.when(F.col("nfl_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("y"))
    )
    return validate.not_finite(odd, ["x", "y"]).groupBy("game_id").agg(F.count("*").alias("n"))


@query
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of each rule of the observed table."""
    t = load(spark, sf_dir)
    return validate.counts(validate.rules_for_observed(t.observed) | {"ids": validate.bad_ids(t.requests)})


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.date_format(F.to_date("ts"), "yyyyMMdd").cast("long")
    return e.select((day * 100 + F.pmod("user_id", F.lit(2))).alias("game_id"), "user_id")


@query
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_games(_games(spark, sf_dir)).select("game_id", F.col("game_date").cast("string").alias("game_date"), "split")


@query
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_games(_games(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"))


@query
def group_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games that more than one user contributes to: groups that would leak across files."""
    return validate.in_several(_games(spark, sf_dir), "game_id", "user_id")


@query
def distinct_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir).observed
    return t.groupBy("game_id").agg(
        F.countDistinct("game_id", "play_id").alias("plays"), F.count("*").alias("n"), F.max("frame_id").alias("last"), F.min("frame_id").alias("first")
    )


@query
def game_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir).observed
    listed = F.array_join(F.transform(F.sort_array(F.collect_set("game_id")), lambda g: g.cast("string")), ",")
    return t.groupBy("player_role").agg(listed.alias("games"))


@query
def view_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir)
    return report.view_bounds(t.observed, predict(t.observed, t.requests, ["constant_velocity_frames"])).select(
        "game_id", "play_id", *r6("x_low", "x_high", "y_low", "y_high")
    )


@query
def framed_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir)
    return report.framed_bounds(t.observed, predict(t.observed, t.requests, ["constant_velocity_frames"])).select(
        "game_id", "play_id", *r6("x_low", "x_high", "y_low", "y_high")
    )


@query
def panel_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir)
    return report.panel_scale(t.observed, t.labels, predict(t.observed, t.requests, ["constant_velocity_frames"])).select(
        *ENTITY, *r6("center_x", "center_y", "scale")
    )


@query
def track_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.track_labels(load(spark, sf_dir).observed)


@query
def selection_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir)
    return report.selection_export(t.observed, t.labels, predict(t.observed, t.requests, ["last_position"]))


@query
def document_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.count_by_pattern(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.link_counts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def remote_ref_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.page_flags(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def asset_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.asset_findings(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def reference_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of the pages, resolved against its page's address and looked up among the pages."""
    return references.reference_graph(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def site_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as the files of their hosts' sites, and what keeps each site from being self-contained."""
    p = uri.parts(F.col("url"))
    path = F.regexp_replace(F.when(p["path"].rlike("(^|/)$"), F.concat(p["path"], F.lit("index.html"))).otherwise(p["path"]), "^/+", "")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url IS NOT NULL")
    text = F.coalesce("html", F.lit(""))
    files = pages.select(
        p["authority"].alias("site"), path.alias("path"), F.octet_length(text).cast("long").alias("bytes"), text.cast("binary").alias("content")
    )
    return references.site_findings(files, markers=((r"[^/]*\.html", "(?i)synthetic"),))


@query
def request_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as requests in the order they were written in, which isn't that of their keys."""
    return order.written_order(spark.read.parquet(f"{sf_dir}/events.parquet")).select("user_id", "event_id", "request_order")


@query
def order_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of requests, as written, whose answer is another's, once answers come in the order of their keys and those of every ninth user are gone."""
    requests = request_order(spark, sf_dir)
    answers = order.key_order(spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id"), ["user_id"], ["event_id"])
    return order.order_mismatches(answers.where("user_id % 9 <> 0"), requests, ["user_id", "event_id"]).select(
        "request_order", F.col("wanted.event_id").alias("wanted_event"), F.col("given.event_id").alias("given_event")
    )


@query
def pairing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which models can be paired once one of them misses a player and another all games but one."""
    found = errors(spark, sf_dir)
    return evaluate.pairing(found.where("NOT (model = 'ball_arrival' AND nfl_id = 3) AND NOT (model = 'last_position' AND game_id <> 102)"))


@query
def slices_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each partition with their slices by horizon and game, reconciled."""
    out = evaluate.slices(errors(spark, sf_dir, ("constant_velocity", "last_position")), partitions(spark))
    return out.select("model", "partition", "slice", "value", "n", *r6("rmse"))


@query
def keyed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels read strictly: keys, domain and coordinates checked in the job that counts them."""
    rows = strict.strict(load(spark, sf_dir).labels, KEYS, strict.point_rules())
    return rows.groupBy("game_id").agg(F.count("*").alias("n"), F.max("frame_id").alias("last"))


@query
def keyed_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of the line items, their keys included, in one pass."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rules = {"null key": F.col("l_orderkey").isNull() | F.col("l_linenumber").isNull(), "quantity over 45": F.col("l_quantity") > 45}
    return strict.counted(items, ["l_orderkey", "l_linenumber"], rules)


#: Events' properties, most of them rewritten as other types would write them.
ODD_PROPS = (
    "CASE event_id % 8 WHEN 1 THEN concat('{{\"k\": \"', {k}, '\"}}') WHEN 2 THEN '{{\"k\": true}}' WHEN 3 THEN concat('{{\"k\": ', {k}, '.5}}') "
    "WHEN 4 THEN '{{}}' WHEN 5 THEN concat('{{\"k\": [', {k}, ']}}') WHEN 6 THEN '{{\"k\": null}}' ELSE props END"
)


@query
def typed_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with events' properties, by rule, where k must be a whole number under 80."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    odd = events.select("event_id", F.expr(ODD_PROPS.format(k="regexp_extract(props, '([0-9]+)', 1)")).alias("props"))
    rules = [evidence.Rule("small", "$.k", "integer", low=0, high=79), evidence.Rule("number", "$.k", "number")]
    return evidence.findings(odd, "event_id", "props", rules).groupBy("rule", "problem").agg(F.count("*").alias("n"))


@query
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the conversations' rows by role: equal wherever the same rows are."""
    out = digest.table_digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "role")
    return out.select("role", "n", *[F.col(f"s{k}").cast("string").alias(f"s{k}") for k in range(1, 5)])


@query
def play_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first play of a game, all players."""
    return select.chosen(load(spark, sf_dir).observed, game=103, play="1", player=select.ALL).select(*KEYS, *r6("x", "y"))


@query
def historical_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.only(rmse_by_game(spark, sf_dir), "model = 'last_position' AND game_id = 103")


@query
def blocked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked names among one file a page."""
    ends = ["index.html", "model.PT", "a.tar.gz", ".env.local", "secrets.json", "notes"]
    name = F.element_at(F.array(*map(F.lit, ends)), (F.pmod("page_id", F.lit(len(ends))) + 1).cast("int"))
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat(F.lit("site/"), "page_id", F.lit("/"), name).alias("path"))
    return select.blocked_paths(files, names=["Secrets.json"])


@query
def exact_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of all observed positions per role, rounded once."""
    return sums.exact_sum(load(spark, sf_dir).observed, "x", "player_role").select("player_role", "n", *r6("x"))
