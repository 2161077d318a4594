"""Assertion rows over recorded figures, selection exports and view geometry."""

from __future__ import annotations

from functools import reduce
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.motion import track_letter
from ..schema import ENTITY, KEYS

FIELD = (120.0, 53.333)


def close(a: Column, b: Column, tolerance: float = 1.5e-6) -> Column:
    return F.abs(a - b) <= F.lit(tolerance)


def assertions(recorded: DataFrame, recomputed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, check, passed): recorded figures against recomputed ones, in both directions."""
    r = recomputed.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns])
    both = recorded.select(*keys, *columns).join(r, keys, "full_outer")
    checks = [
        F.struct(F.lit(c).alias("check"), F.coalesce(close(F.col(c).cast("double"), F.col(f"new_{c}").cast("double")), F.lit(False)).alias("passed"))
        for c in columns
    ]
    return both.select(*keys, F.explode(F.array(*checks)).alias("c")).select(*keys, "c.check", "c.passed")


def ratios(old: Column, new: Column) -> list[Column]:
    """Gain, reduction in percent, and speedup of a figure that should fall."""
    return [
        (old - new).alias("gain"),
        F.try_divide(100.0 * (old - new), old).alias("reduction_percent"),
        F.try_divide(old, new).alias("speedup"),
    ]


def view_bounds(observed: DataFrame, forecast: DataFrame) -> DataFrame:
    """Per play: the window around observations and a forecast, clamped to the field."""
    points = observed.select("game_id", "play_id", "x", "y").unionByName(forecast.select("game_id", "play_id", "x", "y"))
    low = lambda c, m: F.least(F.greatest(F.floor(F.min(c)) - 1.0, F.lit(0.0)), F.lit(m))
    high = lambda c, m: F.least(F.greatest(F.ceil(F.max(c)) + 1.0, F.lit(0.0)), F.lit(m))
    return points.groupBy("game_id", "play_id").agg(
        low("x", FIELD[0]).alias("x_low"),
        high("x", FIELD[0]).alias("x_high"),
        low("y", FIELD[1]).alias("y_low"),
        high("y", FIELD[1]).alias("y_high"),
    )


# A view's width and height, the field around a play that it shows, and the least height of that; a panel's room.
VIEW, MARGIN, LEAST_HEIGHT = (700.0, 402.0), 8.0, 15.0
PANEL = (280.0, 235.0)


def framed_bounds(observed: DataFrame, forecast: DataFrame) -> DataFrame:
    """Per play: the part of the field of a view's proportions around observations and a forecast, moved, not cut, where it would leave the field."""
    points = observed.select("game_id", "play_id", "x", "y").unionByName(forecast.select("game_id", "play_id", "x", "y"))
    ends = points.groupBy("game_id", "play_id").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
    width, height = VIEW
    around = lambda c: F.col(f"high_{c}") - F.col(f"low_{c}") + MARGIN
    tall = F.greatest(F.lit(LEAST_HEIGHT), around("y"), around("x") * height / width)
    spans = {"x": tall * width / height, "y": tall}
    out = []
    for c, field in zip("xy", FIELD, strict=True):
        start = (F.col(f"low_{c}") + F.col(f"high_{c}")) / 2.0 - spans[c] / 2.0
        low = F.greatest(F.lit(0.0), F.least(F.lit(field) - spans[c], start))
        out += [low.alias(f"{c}_low"), (low + spans[c]).alias(f"{c}_high")]
    return ends.select("game_id", "play_id", *out)


def panel_scale(*paths: DataFrame) -> DataFrame:
    """Per entity: the middle of all its paths, and the scale at which they fit a panel, one scale for both axes."""
    points = reduce(DataFrame.unionByName, [p.select(*ENTITY, "x", "y") for p in paths])
    ends = points.groupBy(*ENTITY).agg(
        *[f.alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.floor(F.min(c)) - 1.0), ("high", F.ceil(F.max(c)) + 1.0))]
    )
    middle = [((F.col(f"low_{c}") + F.col(f"high_{c}")) / 2.0).alias(f"center_{c}") for c in "xy"]
    fit = [F.lit(room) / (F.col(f"high_{c}") - F.col(f"low_{c}")) for c, room in zip("xy", PANEL, strict=True)]
    return ends.select(*ENTITY, *middle, F.least(*fit).alias("scale"))


def track_labels(observed: DataFrame) -> DataFrame:
    """Letter and title of each track."""
    return observed.select(*ENTITY).distinct().select(
        *ENTITY,
        track_letter(F.pmod(F.col("nfl_id") - 1, F.lit(26)) + 1).alias("letter"),
        F.format_string("Game %d, play %s", "game_id", F.lpad(F.col("play_id").cast("string"), 3, "0")).alias("title"),
    )


def selection_export(observed: DataFrame, labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per play one JSON text with inputs, requests, predictions and labels as separate arrays.

    A play's rows are bounded by its players and frames.
    """

    def listed(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
        return df.groupBy("game_id", "play_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    points = [*KEYS, "x", "y"]
    out = listed(observed, "inputs", points)
    for df, name, columns in (
        (labels, "requests", KEYS),
        (predictions, "predictions", ["model", *points]),
        (labels, "labels", points),
    ):
        out = out.join(listed(df, name, columns), ["game_id", "play_id"], "full_outer")
    return out.select("game_id", "play_id", F.to_json(F.struct("inputs", "requests", "predictions", "labels")).alias("document"))


def html_table(rows: DataFrame, order: list[str], title: str) -> str:
    """A small aggregate as a static page."""
    names = rows.columns
    head = "".join(f"<th>{escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows.orderBy(*order).collect())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table></body></html>\n"
