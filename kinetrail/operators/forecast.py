"""Forecasts: requests joined with terminal state, models as columns of one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.motion import BASIS, basis, model, weighted
from ..schema import ENTITY, KEYS
from .state import observed_state


def _with_state(observed: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with their entity's state; a request without any history raises when it is read."""
    state = observed_state(observed)
    key = F.concat_ws(", ", *KEYS)
    joined = requests.select(*KEYS).join(state, ENTITY, "left")
    known = F.when(F.col("n_observed").isNull(), F.raise_error(F.concat(F.lit("no history of the request "), key))).otherwise(F.col("n_observed"))
    return joined.withColumn("n_observed", known).where("n_observed > 0")  # the condition keeps the check in the plan, whatever columns are read


def design(observed: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with their entity's state and the terms fx1..fx6, fy1..fy6.

    Only the requests' keys are read, so labels beside them can't leak. Requests without history raise.
    """
    return _with_state(observed, requests).select("*", *basis("x"), *basis("y"))


def wide(observed: DataFrame, requests: DataFrame, models: Sequence[str]) -> DataFrame:
    """(keys, x_<model>, y_<model>...): a row per request, a pair of columns per model; unknown names raise at once, requests without history when read."""
    made = [model(m)(a).alias(f"{a}_{m}") for m in models for a in "xy"]
    return _with_state(observed, requests).select(*KEYS, *made)


def predict(observed: DataFrame, requests: DataFrame, models: Sequence[str]) -> DataFrame:
    """(model, keys, x, y), all models from one join (see wide)."""
    each = [F.struct(F.lit(m).alias("model"), F.col(f"x_{m}").alias("x"), F.col(f"y_{m}").alias("y")) for m in models]
    return wide(observed, requests, models).select(*KEYS, F.explode(F.array(*each)).alias("p")).select("p.model", *KEYS, "p.x", "p.y")


def ridge_predict(designed: DataFrame, weights: DataFrame) -> DataFrame:
    """(keys, x, y) from weights (player_role, w array of 6); a null role holds the global ones.

    The weights are one row per role, read once; the join is left, roles without
    weights fall back to the global ones, a single value of the plan. Spark broadcasts them if they are small. None or several
    global rows, or several of a role, raise when the result is read.
    """
    one = lambda n, w, what: F.when(n == 1, w).otherwise(F.raise_error(F.concat(F.lit("not one row of weights for "), what)))
    everyone = weights.where("player_role IS NULL").agg(one(F.count("*"), F.first("w"), F.lit("all roles")).alias("w"))
    roles = weights.where("player_role IS NOT NULL").groupBy("player_role").agg(one(F.count("*"), F.first("w"), F.first("player_role")).alias("w"))
    joined = designed.join(roles, "player_role", "left").withColumn("w_all", everyone.scalar())
    own = F.coalesce("w", "w_all")
    terms = [own[k] for k in range(len(BASIS))]
    return joined.select(*KEYS, weighted("x", terms).alias("px"), weighted("y", terms).alias("py")).select(
        *KEYS, F.col("px").alias("x"), F.col("py").alias("y")
    )
