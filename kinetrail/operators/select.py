"""Selections: wildcards, the one matching row, blocked files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "all"

# Suffixes of models, arrays, archives and keys that no release holds.
BLOCKED_SUFFIXES = (".pt", ".pth", ".pkl", ".pickle", ".npz", ".npy", ".parquet", ".zip", ".gz", ".bin", ".pem", ".key", ".pyz")


def chosen(rows: DataFrame, game: int | str = ALL, play: int | str = ALL, player: int | str = ALL) -> DataFrame:
    """Rows of a game, play and player; "all" leaves one of them open. The conditions reach the scan."""
    for column, value in (("game_id", game), ("play_id", play), ("nfl_id", player)):
        if value != ALL:
            rows = rows.where(F.col(column) == int(value))
    return rows


def only(rows: DataFrame, condition: Column | str) -> DataFrame:
    """The one row that meets the condition; with none or several the read raises."""
    row = F.struct(*rows.columns)
    found = rows.where(condition).agg(F.count("*").alias("n"), F.first(row).alias("row"))
    message = F.format_string("%d rows match, one is wanted", "n")
    return found.select(F.when(F.col("n") == 1, F.col("row")).otherwise(F.raise_error(message)).alias("row")).select("row.*")


def blocked_paths(files: DataFrame, path: str = "path", suffixes: Sequence[str] = BLOCKED_SUFFIXES, names: Sequence[str] = ()) -> DataFrame:
    """Files whose suffix or name is blocked, in any case, or whose name begins with `.env`."""
    name = F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"([^/\\]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    return files.where(suffix.isin(*suffixes) | F.lower(name).isin(*[n.lower() for n in names]) | name.startswith(".env"))
