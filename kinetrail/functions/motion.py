"""Motion features and forecast models as column expressions over a state row and a frame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import accumulate, repeat
from operator import mul

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LONGEST, RATE
from .exact import rounded

BASIS = ("velocity", "smoothed_velocity", "acceleration", "ball", "ball_squared", "ball_cubed")


def finite(c: Column) -> Column:
    """Neither null, nor NaN, nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def seconds(frame: Column) -> Column:
    return frame / F.lit(RATE)


def basis(axis: str) -> list[Column]:
    """The six terms of one axis, named fx1..fx6 or fy1..fy6."""
    t, q = seconds(F.col("frame_id")), F.col("frame_id") / F.col("num_frames_output")
    to_ball = F.col(f"ball_land_{axis}") - F.col(axis)
    terms = [
        F.col(f"v{axis}") * t,
        F.col(f"s{axis}") * t,
        F.col(f"a{axis}") * t * t / 2.0,
        to_ball * q,
        to_ball * q * q,
        to_ball * q * q * q,
    ]
    return [c.alias(f"f{axis}{k}") for k, c in enumerate(terms, 1)]


def weighted(axis: str, weights: Sequence[Column | float]) -> Column:
    total = F.col(axis)
    for k, w in enumerate(weights, 1):
        total = total + F.col(f"f{axis}{k}") * w
    return total


def damped_sum(frame: Column, damping: float) -> Column:
    """damping + damping**2 + ... + damping**frame.

    Up to the LONGEST frame these are constants of the plan, added frame by frame; beyond, the closed form, whose last digits differ.
    """
    if not 0.0 <= damping <= 1.0:
        raise ValueError("damping must lie in [0, 1]")
    if damping == 1.0:
        return frame.cast("double")
    steps = accumulate(repeat(damping, LONGEST), mul)
    table = F.array(*[F.lit(total) for total in accumulate(steps)])
    closed = F.lit(damping) * (1.0 - F.pow(F.lit(damping), frame)) / F.lit(1.0 - damping)
    return F.when(frame.between(1, LONGEST), F.element_at(table, frame.cast("int"))).otherwise(closed)


def _last(axis: str) -> Column:
    return F.col(axis)


def _elapsed(axis: str) -> Column:
    return F.col(axis) + F.col(f"v{axis}") * seconds(F.col("frame_id"))


def _frames(axis: str) -> Column:
    return rounded(F.col(axis) + F.col("frame_id") * F.col(f"d{axis}"))


def _smoothed(axis: str) -> Column:
    return F.col(axis) + F.col(f"s{axis}") * seconds(F.col("frame_id"))


def _accelerated(axis: str) -> Column:
    t = seconds(F.col("frame_id"))
    return F.col(axis) + F.col(f"v{axis}") * t + F.col(f"a{axis}") * t * t / 2.0


def _ball(axis: str) -> Column:
    return F.col(axis) + (F.col(f"ball_land_{axis}") - F.col(axis)) * (F.col("frame_id") / F.col("num_frames_output"))


def damped(damping: float) -> Callable[[str], Column]:
    def model(axis: str) -> Column:
        return rounded(F.col(axis) + damped_sum(F.col("frame_id"), damping) * F.col(f"d{axis}"))

    return model


#: Rule-based models by name; a model maps an axis to its forecast.
MODELS: Mapping[str, Callable[[str], Column]] = {
    "last_position": _last,
    "constant_velocity": _elapsed,
    "constant_velocity_frames": _frames,
    "smoothed_velocity": _smoothed,
    "constant_acceleration": _accelerated,
    "ball_arrival": _ball,
    "damped_velocity": damped(0.9),
}


def model(name: str) -> Callable[[str], Column]:
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(MODELS)}")
    return MODELS[name]


def horizon_bucket(frame: Column, width: int = 4) -> Column:
    """frames_1_4, frames_5_8, ..."""
    first = F.floor((frame - 1) / width) * width + 1
    return F.concat_ws("_", F.lit("frames"), first, first + (width - 1))


def track_letter(entity: Column) -> Column:
    return F.char(F.lit(64) + entity)
