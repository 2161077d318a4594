"""Event streams as tracking tables: a user's consecutive events are the frames of plays."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import ENTITY, KEYS
from .synthetic import FUTURE, OBSERVED


class Tracking(NamedTuple):
    observed: DataFrame
    requests: DataFrame
    labels: DataFrame


FRAMES = OBSERVED + FUTURE


def tracking(events: DataFrame) -> Tracking:
    """Plays of 20 events of one user: 8 observed and 12 to forecast; shorter plays are left out.

    x is the event's value, y the number k of its properties. One exchange on the user serves both windows. The ball lands
    at the mean position, added in millionths, as whole numbers, so that no digit depends on the order of rows.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(order) - 1
    frames = (
        events.select("user_id", "ts", "event_id", "event_type", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
        .withColumn("n", n)
        .withColumn("play", F.floor(F.col("n") / FRAMES))
        .withColumn("size", F.count("*").over(Window.partitionBy("user_id", "play")))
        .where(F.col("size") == FRAMES)
        .select(
            (101 + F.pmod("user_id", F.lit(6))).cast("long").alias("game_id"),
            (F.col("play") + 1).cast("long").alias("play_id"),
            (F.col("user_id") + 1).alias("nfl_id"),
            (F.pmod("n", F.lit(FRAMES)) + 1).cast("long").alias("f"),
            "x",
            "y",
            "event_type",
        )
    )
    past = frames.where(F.col("f") <= OBSERVED)
    role = F.max(F.when(F.col("f") == OBSERVED, F.col("event_type"))).over(Window.partitionBy(*ENTITY))
    mean = lambda c: F.sum(F.rint(F.col(c) * 1e6).cast("long")).cast("double") / (F.count("*") * 1e6)
    ball = past.groupBy("game_id", "play_id").agg(mean("x").alias("ball_land_x"), mean("y").alias("ball_land_y"))
    observed = (
        past.withColumn("player_role", role)
        .join(ball, ["game_id", "play_id"])
        .select(
            *ENTITY,
            F.col("f").alias("frame_id"),
            "x",
            "y",
            "ball_land_x",
            "ball_land_y",
            F.lit(FUTURE).cast("long").alias("num_frames_output"),
            "player_role",
        )
    )
    labels = frames.where(F.col("f") > OBSERVED).select(*ENTITY, (F.col("f") - OBSERVED).alias("frame_id"), "x", "y")
    return Tracking(observed, labels.select(*KEYS), labels)


def load(spark: SparkSession, sf_dir: str) -> Tracking:
    return tracking(spark.read.parquet(f"{sf_dir}/events.parquet"))
