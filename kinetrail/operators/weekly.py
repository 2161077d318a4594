"""Audit of paired weekly tables: horizons, counts, groups in one file, temporal split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ENTITY
from .split import split_games
from .validate import bad_flags, horizon_audit, in_several, is_set


def scored(inputs: DataFrame) -> DataFrame:
    """(week, entity, horizon) of the players to predict, from each one's last row."""
    return (
        inputs.where(is_set("player_to_predict"))
        .groupBy("week", *ENTITY)
        .agg(F.max_by("num_frames_output", "frame_id").alias("num_frames_output"))
    )


def summary(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per week: rows, plays, games, scored entities, forecast rows."""
    a = inputs.groupBy("week").agg(
        F.count("*").alias("input_rows"),
        F.countDistinct("game_id", "play_id").alias("plays"),
        F.sort_array(F.collect_set("game_id")).alias("games"),
    )
    b = outputs.groupBy("week").agg(F.count("*").alias("output_rows"), F.countDistinct(*ENTITY).alias("entities"))
    return a.join(b, "week", "full_outer")


def violations(inputs: DataFrame, outputs: DataFrame) -> dict[str, DataFrame]:
    return {
        "flags": bad_flags(inputs, "player_to_predict"),
        "horizons": horizon_audit(outputs, scored(inputs)),
        "games": in_several(inputs.select("game_id", "week").distinct(), "game_id", "week"),
    }


def split_counts(inputs: DataFrame) -> DataFrame:
    return split_games(inputs).groupBy("split").count()
