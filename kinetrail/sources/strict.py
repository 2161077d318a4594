"""Keyed tables that are checked while they are read: broken rules raise by name, in the job that uses the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.motion import finite
from ..schema import ENTITY, KEYS, LONGEST, OBSERVED, POINTS
from .tables import read_csv


def point_rules(coordinates: Sequence[str] = ("x", "y")) -> dict[str, Column]:
    """What a row of points may not be, by name."""
    each = lambda test: F.exists(F.array(*[F.col(k) for k in KEYS]), test)
    bad = F.lit(False)
    for c in coordinates:
        bad = bad | ~finite(F.col(c))
    return {
        "null key": each(lambda k: k.isNull()),
        "identifier not positive": each(lambda k: k <= 0),
        "frame beyond the contract": F.col("frame_id") > LONGEST,
        "coordinate not finite": bad,
    }


def broken(rules: Mapping[str, Column]) -> Column:
    """The name of the first rule that a row breaks, or null."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def _raised(name: Column, keys: Sequence[str]) -> Column:
    at = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return F.raise_error(F.concat(name, F.lit(" at "), at))


def strict(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column], empty: bool = False) -> DataFrame:
    """The rows, each key once. Reading them raises the name of a broken rule, "duplicate key", or "empty table" unless that is allowed.

    All is one plan: rules are tested where rows are read, keys meet in one exchange, which the test for emptiness reuses. Nothing runs here.
    """
    rest = [c for c in df.columns if c not in keys]
    named = df.select(*keys, F.struct(*rest).alias("_row"), broken(rules).alias("_broken"))
    once = named.groupBy(*keys).agg(F.count("*").alias("_n"), F.first("_row").alias("_row"), F.first("_broken", ignorenulls=True).alias("_broken"))
    wrong = F.coalesce(F.col("_broken"), F.when(F.col("_n") > 1, "duplicate key"))
    checked = once.withColumn("_row", F.when(wrong.isNull(), F.col("_row")).otherwise(_raised(wrong, keys)))
    checked = checked.where(F.col("_row").isNotNull())  # the check stays, whatever columns are read
    if not empty:
        none = once.agg(F.count("*").alias("_n")).where(F.when(F.col("_n") == 0, F.raise_error(F.lit("empty table"))).otherwise(F.lit(False)))
        checked = checked.select(*keys, "_row").unionByName(none.select(*[F.lit(None).cast(checked.schema[c].dataType).alias(c) for c in (*keys, "_row")]))
    return checked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def counted(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations) of all rules, "duplicate key" (rows beyond a key's first) and "rows" in one pass and one exchange of keys."""
    flags = [F.count_if(F.coalesce(rule, F.lit(False))).alias(f"_r{k}") for k, rule in enumerate(rules.values())]
    once = df.groupBy(*keys).agg(F.count("*").alias("_n"), *flags)
    totals = [F.struct(F.lit(name).alias("rule"), F.coalesce(F.sum(f"_r{k}"), F.lit(0)).cast("long").alias("violations")) for k, name in enumerate(rules)]
    totals += [
        F.struct(F.lit("duplicate key").alias("rule"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("violations")),
        F.struct(F.lit("rows").alias("rule"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("violations")),
    ]
    return once.agg(F.array(*totals).alias("r")).select(F.explode("r").alias("r")).select("r.rule", "r.violations")


def watched(df: DataFrame, rules: Mapping[str, Column], name: str = "rules") -> tuple[DataFrame, Observation]:
    """The rows as they are, and an observation that has each rule's violations, and "rows", once a job has read them (a write, say)."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), *[F.count_if(F.coalesce(rule, F.lit(False))).alias(k) for k, rule in rules.items()]), seen


def read_points(spark: SparkSession, path: str | list[str], model: bool = False, empty: bool = False) -> DataFrame:
    """Points (keys, x, y; with `model`, a model's name before them) from CSV of exactly that header, checked as it is read."""
    fields = ([T.StructField("model", T.StringType())] if model else []) + POINTS.fields
    rules = point_rules()
    if model:
        rules["null key"] = F.col("model").isNull() | rules["null key"]
    return strict(read_csv(spark, path, T.StructType(fields)), (["model"] if model else []) + KEYS, rules, empty)


def read_history(spark: SparkSession, path: str | list[str], whole: bool = True) -> DataFrame:
    """Observed rows from CSV, checked as they are read; with `whole`, each entity's frames must be 1..n with n of 2 or more.

    Keys and entities share one exchange, by the entity.
    """
    rows = read_csv(spark, path, OBSERVED)
    rules = point_rules(("x", "y", "ball_land_x", "ball_land_y")) | {"horizon not positive": F.coalesce(F.col("num_frames_output") < 1, F.lit(True))}
    of = Window.partitionBy(*ENTITY)
    wrong = F.coalesce(broken(rules), F.when(F.count("*").over(Window.partitionBy(*ENTITY, "frame_id")) > 1, "duplicate key"))
    if whole:
        frames = F.size(F.collect_set("frame_id").over(of))  # of a contract's few frames
        gap = (F.min("frame_id").over(of) != 1) | (F.max("frame_id").over(of) != frames)
        wrong = F.coalesce(wrong, F.when(gap, "gap in the history"), F.when(frames < 2, "single row of history"))
    checked = rows.withColumn("_wrong", wrong)
    return checked.where(F.when(F.col("_wrong").isNull(), F.lit(True)).otherwise(_raised(F.col("_wrong"), KEYS).cast("boolean"))).drop("_wrong")


def requests_within(requests: DataFrame, history: DataFrame) -> DataFrame:
    """The requests; reading them raises for an entity without history or a frame beyond its horizon."""
    state = history.groupBy(*ENTITY).agg(F.max("num_frames_output").alias("_horizon"))
    met = requests.join(state, ENTITY, "left")
    wrong = F.when(F.col("_horizon").isNull(), "missing entity").when(F.col("frame_id") > F.col("_horizon"), "frame beyond the horizon")
    return met.where(F.when(wrong.isNull(), F.lit(True)).otherwise(_raised(wrong, KEYS).cast("boolean"))).select(*requests.columns)
