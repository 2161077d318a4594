"""Temporal split of games, whole days together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_DAYS = 10


def game_date(game_id: str = "game_id"):
    """The date in the first eight digits of an id; bad dates raise."""
    return F.to_date(F.substring(F.col(game_id).cast("string"), 1, 8), "yyyyMMdd")


def split_games(games: DataFrame) -> DataFrame:
    """(game_id, game_date, split): 70 % of days train, up to 85 % validation, the rest holdout.

    One row per distinct day reaches the unpartitioned window.
    """
    dated = games.select("game_id").distinct().withColumn("game_date", game_date())
    every = Window.partitionBy()
    days = (
        dated.select("game_date")
        .distinct()
        .withColumn("i", F.row_number().over(Window.orderBy("game_date")) - 1)
        .withColumn("n", F.count("*").over(every))
        .withColumn(
            "split",
            F.when(F.col("i") < F.floor(F.col("n") * F.lit(0.70)), "train")
            .when(F.col("i") < F.floor(F.col("n") * F.lit(0.85)), "validation")
            .otherwise("holdout"),
        )
    )
    return dated.join(days.select("game_date", "split"), "game_date").select("game_id", "game_date", "split")


def enough_days(games: DataFrame) -> None:
    n = games.select(game_date().alias("d")).distinct().count()
    if n < LEAST_DAYS:
        raise ValueError(f"{n} distinct days; at least {LEAST_DAYS} are needed")
