"""Deterministic synthetic plays: constant acceleration, seeded parameters, generated by expressions."""

from __future__ import annotations

import random
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEYS, RATE

GAMES = (101, 102, 103, 104, 105, 106)
PARTITION = {101: "train", 102: "train", 103: "train", 104: "validation", 105: "holdout", 106: "holdout"}
OBSERVED, FUTURE = 8, 12
#: Fixed values of the published fixture: an entity's draws, in order; start positions also grow by player.
DRAWS = (
    ("x0", -0.6, 0.6),
    ("y0", -0.6, 0.6),
    ("u", 2.5, 5.0),
    ("v", -1.5, 1.5),
    ("a", -1.1, 1.1),
    ("b", -1.3, 1.3),
)
START = "39.0 + 3 * nfl_id", "14.0 + 6 * nfl_id"


class Bundle(NamedTuple):
    observed: DataFrame
    requests: DataFrame
    labels: DataFrame
    splits: DataFrame


def partitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PARTITION.items()), "game_id long, partition string")


def synthetic(spark: SparkSession, seed: int = 2026, games: tuple[int, ...] = GAMES, plays: int = 2, players: int = 3) -> Bundle:
    """Observations of frames 1-8 and labels of the 12 after, for each game, play and player.

    Six parameters an entity come from a private generator on the driver; rows are made by Spark. Time 0 is the last observed frame.
    """
    rng = random.Random(seed)
    rows = [
        (g, p, n, *[rng.uniform(low, high) for _, low, high in DRAWS])
        for g in games
        for p in range(1, plays + 1)
        for n in range(1, players + 1)
    ]
    names = ", ".join(f"{name} double" for name, _, _ in DRAWS)
    entities = spark.createDataFrame(rows, f"game_id long, play_id long, nfl_id long, {names}")
    t = (F.col("t") - OBSERVED) / F.lit(RATE)
    points = entities.select("*", F.explode(F.sequence(F.lit(1), F.lit(OBSERVED + FUTURE))).alias("t")).select(
        "game_id",
        "play_id",
        "nfl_id",
        F.col("t").cast("long").alias("t"),
        F.round(F.expr(START[0]) + F.col("x0") + F.col("u") * t + 0.5 * F.col("a") * t * t, 6).alias("x"),
        F.round(F.expr(START[1]) + F.col("y0") + F.col("v") * t + 0.5 * F.col("b") * t * t, 6).alias("y"),
    )
    observed = points.where(F.col("t") <= OBSERVED).withColumnRenamed("t", "frame_id").select(*KEYS, "x", "y")
    labels = points.where(F.col("t") > OBSERVED).withColumn("frame_id", F.col("t") - OBSERVED).select(*KEYS, "x", "y")
    return Bundle(observed, labels.select(*KEYS), labels, partitions(spark).where(F.col("game_id").isin(*games)))


def two_player_play(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A curved play of two players: ten past and twenty future frames."""
    t = F.col("t")
    rows = spark.range(1, 31).withColumnRenamed("id", "t").crossJoin(spark.range(1, 3).withColumnRenamed("id", "nfl_id"))
    points = rows.select(
        F.lit(1).cast("long").alias("game_id"),
        F.lit(1).cast("long").alias("play_id"),
        "nfl_id",
        "t",
        (40.0 + 0.6 * t + 2.0 * F.col("nfl_id")).alias("x"),
        (20.0 + 6.0 * F.sin(t / 12.0) * F.when(F.col("nfl_id") == 1, 1.0).otherwise(-1.0)).alias("y"),
    )
    past = points.where("t <= 10").withColumn("frame_id", t).select(*KEYS, "x", "y")
    future = points.where("t > 10").withColumn("frame_id", t - 10).select(*KEYS, "x", "y")
    return past, future
