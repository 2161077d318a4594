"""Rules as violation tables: empty means passed. `require` turns them into errors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.motion import MODELS, finite
from ..schema import ENTITY, KEYS, LONGEST


class Invalid(ValueError):
    """A table breaks a rule."""


def options(method: str, damping: float = 0.9, horizon: int | None = None, longest: int = 12) -> tuple[str, float, int]:
    """A forecast's method, damping and horizon, or Invalid: a known method, a number of 0 to 1, a whole number of 1 to `longest`."""
    horizon = longest if horizon is None else horizon
    if method not in MODELS:
        raise Invalid(f"unknown method {method!r}")
    if isinstance(damping, bool) or not isinstance(damping, int | float) or not 0 <= damping <= 1:
        raise Invalid("damping must be in 0..1")
    if isinstance(horizon, bool) or not isinstance(horizon, int) or not 1 <= horizon <= longest:
        raise Invalid(f"horizon must be in 1..{longest}")
    return method, float(damping), horizon


def need_columns(df: DataFrame, columns: Sequence[str]) -> None:
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise Invalid(f"missing columns: {', '.join(absent)}")


def duplicate_keys(df: DataFrame, keys: Sequence[str] = tuple(KEYS)) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def bad_keys(df: DataFrame) -> DataFrame:
    absent = F.lit(False)
    for k in KEYS:
        absent = absent | F.col(k).isNull()
    return df.where(absent | (F.col("frame_id") < 1))


def bad_ids(df: DataFrame) -> DataFrame:
    low = F.lit(False)
    for k in KEYS:
        low = low | (F.col(k) <= 0)
    return df.where(low | (F.col("frame_id") > LONGEST))


def not_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~finite(F.col(c))
    return df.where(bad)


def bad_horizon(df: DataFrame) -> DataFrame:
    return df.where(F.col("num_frames_output").isNull() | (F.col("num_frames_output") < 1))


def beyond_horizon(requests: DataFrame, state: DataFrame) -> DataFrame:
    return requests.join(state.select(*ENTITY, "num_frames_output"), ENTITY).where("frame_id > num_frames_output")


def contiguity(observed: DataFrame) -> DataFrame:
    """Per entity: whether its frames are exactly 1..n with n >= 2."""
    whole = (F.min("frame_id") == 1) & (F.max("frame_id") == F.count("*")) & (F.countDistinct("frame_id") == F.count("*"))
    return observed.groupBy(*ENTITY).agg(F.count("*").alias("n"), (whole & (F.count("*") >= 2)).alias("contiguous"))


def without_history(requests: DataFrame, observed: DataFrame) -> DataFrame:
    return requests.select(*ENTITY).distinct().join(observed.select(*ENTITY).distinct(), ENTITY, "left_anti")


def bad_flags(df: DataFrame, column: str) -> DataFrame:
    flag = F.lower(F.col(column).cast("string"))
    return df.where(flag.isNull() | ~flag.isin("true", "false", "1", "0"))


def is_set(column: str):
    return F.lower(F.col(column).cast("string")).isin("true", "1")


def horizon_audit(outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """Entities whose output frames are not exactly 1..num_frames_output.

    expected: (entity, num_frames_output) of every scored entity. Full outer, so entities of just one side show.
    """
    found = outputs.groupBy(*ENTITY).agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.count("*").alias("n"))
    joined = found.join(expected.select(*ENTITY, "num_frames_output"), ENTITY, "full_outer")
    right = (F.col("first") == 1) & (F.col("last") == F.col("num_frames_output")) & (F.col("n") == F.col("num_frames_output"))
    return joined.where(~F.coalesce(right, F.lit(False)))


def in_several(df: DataFrame, group: str, place: str) -> DataFrame:
    """Groups that stand in more than one place (file, split)."""
    return df.groupBy(group).agg(F.countDistinct(place).alias("places")).where("places > 1")


def rules_for_observed(observed: DataFrame) -> dict[str, DataFrame]:
    need_columns(observed, [*KEYS, "x", "y", "ball_land_x", "ball_land_y", "num_frames_output", "player_role"])
    return {
        "keys": bad_keys(observed),
        "unique": duplicate_keys(observed),
        "finite": not_finite(observed, ["x", "y", "ball_land_x", "ball_land_y"]),
        "horizon": bad_horizon(observed),
    }


def rules_for_pair(requests: DataFrame, observed: DataFrame) -> dict[str, DataFrame]:
    need_columns(requests, KEYS)
    return {"keys": bad_keys(requests), "unique": duplicate_keys(requests), "history": without_history(requests, observed)}


def counts(rules: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, violations) of every rule in one job."""
    out = None
    for name, df in rules.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def require(rules: Mapping[str, DataFrame], nonempty: DataFrame | None = None) -> None:
    """Evaluate the rules now; Invalid names those that are broken."""
    if nonempty is not None and nonempty.isEmpty():
        raise Invalid("empty table")
    broken = {r.rule: r.violations for r in counts(rules).collect() if r.violations}
    if broken:
        raise Invalid(", ".join(f"{k}: {v} rows" for k, v in sorted(broken.items())))
