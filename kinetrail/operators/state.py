"""Terminal motion state of each entity, from partial states that merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ENTITY, RATE

_CONTEXT = ("ball_land_x", "ball_land_y", "num_frames_output", "player_role")
RECENT = 5


def partial_state(observed: DataFrame) -> DataFrame:
    """One row per entity: n, first and last frame, and its last RECENT rows (recent: array of frame_id, x, y and context, by frame).

    A rank that is limited before the exchange leaves RECENT rows of an entity in each task; counts and extremes are aggregated before
    it, too, from the keys alone. Both sides are then dealt by the entity, so that they meet without another exchange.
    """
    context = [c for c in _CONTEXT if c in observed.columns]
    back = F.row_number().over(Window.partitionBy(*ENTITY).orderBy(F.desc("frame_id")))
    last = observed.select(*ENTITY, "frame_id", "x", "y", *context).withColumn("_back", back).where(F.col("_back") <= RECENT)
    recent = last.groupBy(*ENTITY).agg(F.sort_array(F.collect_list(F.struct("frame_id", "x", "y", *context))).alias("recent"))
    frames = F.col("frame_id")
    counts = observed.groupBy(*ENTITY).agg(F.count("*").alias("n"), F.min(frames).alias("first"), F.max(frames).alias("last"))
    return counts.join(recent, ENTITY)


def merged(*states: DataFrame) -> DataFrame:
    """The partial state of all rows, from partial states of shards that share none."""
    rows = reduce(DataFrame.unionByName, states)
    recent = F.reverse(F.slice(F.sort_array(F.flatten(F.collect_list("recent")), asc=False), 1, RECENT))
    return rows.groupBy(*ENTITY).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), recent.alias("recent"))


def _slope(rows: Column, axis: str) -> Column:
    """Least squares over seconds; sums go by frame, so a result doesn't depend on how rows are dealt."""
    n = F.size(rows).cast("double")
    t = lambda r: r["frame_id"] / F.lit(RATE)
    total = lambda f: F.aggregate(rows, F.lit(0.0), lambda at, r: at + f(r))
    mean_t, mean = total(t) / n, total(lambda r: r[axis]) / n
    spread = total(lambda r: (t(r) - mean_t) * (t(r) - mean_t))
    return F.when(spread > 0, total(lambda r: (t(r) - mean_t) * (r[axis] - mean)) / spread).otherwise(0.0)


def finished(state: DataFrame) -> DataFrame:
    """Position, motion and context at the end of each entity's partial state (see observed_state)."""
    context = [f.name for f in state.schema["recent"].dataType.elementType if f.name not in ("frame_id", "x", "y")]
    at = lambda k: F.try_element_at("recent", F.lit(-k))
    known = lambda k: F.size("recent") >= k
    rows = state.withColumns({"_a": at(1), "_b": at(2), "_c": at(3)})
    dt, before = (F.col("_a.frame_id") - F.col("_b.frame_id")) / F.lit(RATE), (F.col("_b.frame_id") - F.col("_c.frame_id")) / F.lit(RATE)
    out = {}
    for c in "xy":
        step, earlier = F.col(f"_a.{c}") - F.col(f"_b.{c}"), F.col(f"_b.{c}") - F.col(f"_c.{c}")
        out |= {
            c: F.col(f"_a.{c}"),
            f"v{c}": F.when(known(2), F.try_divide(step, dt)),
            f"d{c}": F.when(known(2), step),
            f"a{c}": F.when(known(3), F.try_divide(F.try_divide(step, dt) - F.try_divide(earlier, before), (dt + before) / 2.0)),
            f"s{c}": _slope(F.col("recent"), c),
        }
    motion = [out[k].alias(k) if k in "xy" else F.coalesce(out[k], F.lit(0.0)).alias(k) for k in ("x", "y", "vx", "vy", "dx", "dy", "ax", "ay", "sx", "sy")]
    plain = [F.col(f"_a.{c}").alias(c) for c in context if c != "player_role"]
    role = [F.coalesce("_a.player_role", F.lit("Unknown")).alias("player_role")] if "player_role" in context else []
    whole = (F.col("first") == 1) & (F.col("last") == F.col("n")) & (F.col("n") >= 2)
    return rows.select(*ENTITY, *motion, *plain, *role, F.col("n").alias("n_observed"), whole.alias("contiguous"))


def observed_state(observed: DataFrame) -> DataFrame:
    """One row per entity: last position, motion, and the context of its last row.

    vx, vy: last step over elapsed seconds; dx, dy: last step itself; ax, ay: change of
    velocity over the mean of the last two steps' times; sx, sy: least-squares slope of the
    last five rows. Missing ones are 0. Also n_observed and contiguous (frames are 1..n, n >= 2).
    """
    return finished(partial_state(observed))
