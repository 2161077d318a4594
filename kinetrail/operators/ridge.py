"""Role-specific ridge regression from additive statistics."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.motion import BASIS
from ..schema import KEYS

N = len(BASIS)
UPPER = [(i, j) for i in range(1, N + 1) for j in range(i, N + 1)]
SUMS = [*[f"g{i}{j}" for i, j in UPPER], *[f"r{i}" for i in range(1, N + 1)]]


def sufficient_statistics(designed: DataFrame, truth: DataFrame) -> DataFrame:
    """Per role, and in total (role null, is_total true): n equations, Gram matrix, right-hand side.

    Each row gives two equations, one per axis, with shared weights. Partial sums
    are combined map-side; statistics of shards add up.
    """
    rows = designed.join(truth.select(*KEYS, F.col("x").alias("tx"), F.col("y").alias("ty")), KEYS)
    rx, ry = F.col("tx") - F.col("x"), F.col("ty") - F.col("y")
    sums = [
        F.sum(F.col(f"fx{i}") * F.col(f"fx{j}") + F.col(f"fy{i}") * F.col(f"fy{j}")).alias(f"g{i}{j}") for i, j in UPPER
    ] + [F.sum(F.col(f"fx{i}") * rx + F.col(f"fy{i}") * ry).alias(f"r{i}") for i in range(1, N + 1)]
    return (
        rows.rollup("player_role")
        .agg((2 * F.count("*")).alias("n"), (F.grouping("player_role") == 1).alias("is_total"), *sums)
        .select("player_role", "is_total", "n", *SUMS)
    )


def add_statistics(*parts: DataFrame) -> DataFrame:
    """Statistics of all parts together."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("player_role", "is_total").agg(*[F.sum(c).alias(c) for c in ["n", *SUMS]])


def solve(gram: np.ndarray, rhs: np.ndarray, n: float, alpha: float) -> np.ndarray:
    """Ridge weights with each term scaled to unit mean square."""
    scale = np.sqrt(np.maximum(np.diag(gram) / n, 1e-12))
    scaled = gram / (np.outer(scale, scale) * n) + alpha * np.eye(N)
    return np.linalg.solve(scaled, rhs / (scale * n)) / scale


def fit_statistics(statistics: DataFrame, alpha: float = 0.001) -> dict:
    """The fitted model: one 6 x 6 solve per role, on the driver (one row per role)."""
    if not (math.isfinite(alpha) and alpha > 0):
        raise ValueError("alpha must be positive")
    fitted: dict = {"format": 1, "basis": list(BASIS), "alpha": alpha, "global": None, "roles": {}}
    for row in statistics.collect():
        if not row.n:
            raise ValueError("statistics without equations")
        gram = np.zeros((N, N))
        for i, j in UPPER:
            gram[i - 1, j - 1] = gram[j - 1, i - 1] = row[f"g{i}{j}"]
        rhs = np.array([row[f"r{i}"] for i in range(1, N + 1)])
        part = {"count": int(row.n), "coefficients": solve(gram, rhs, float(row.n), alpha).tolist()}
        if row.is_total:
            fitted["global"] = part
        else:
            fitted["roles"][row.player_role] = part
    if fitted["global"] is None:
        raise ValueError("no statistics")
    return fitted


def check_model(fitted: dict) -> dict:
    """The model itself if it fits this package's basis; else ValueError."""
    if fitted.get("format") != 1 or fitted.get("basis") != list(BASIS) or not fitted.get("global"):
        raise ValueError("incompatible model")
    for part in [fitted["global"], *fitted["roles"].values()]:
        w = part["coefficients"]
        if len(w) != N or not all(math.isfinite(x) for x in w):
            raise ValueError("bad coefficients")
    return fitted


def weights_table(spark: SparkSession, fitted: dict) -> DataFrame:
    check_model(fitted)
    rows = [(None, fitted["global"]["coefficients"])] + [(r, p["coefficients"]) for r, p in fitted["roles"].items()]
    return spark.createDataFrame(rows, "player_role string, w array<double>")


def to_json(fitted: dict) -> str:
    return json.dumps(fitted, sort_keys=True, allow_nan=False)
