"""Rounding of exact binary values, beside Python's."""

import math
import random

import pytest
from kinetrail.functions.exact import rounded
from kinetrail.functions.motion import damped_sum
from pyspark.sql import functions as F

# Midpoints and their neighbours, as published with the rule.
POINTS = [0.0078125, 0.0234375, -0.0078125, -0.0234375, 1.2345645, -1.2345645, 0.0000005, 1e-300, 1e20]


def values(digits):
    rng = random.Random(digits)
    out = [*POINTS, 2.675, -2.675, 0.5, 1.5, -0.0, 0.0, 5e-324, 2.0**33, 2.0**33 - 2.0**-19, 8589934591.9999995, 1e9 + 0.1234565, -123456.7890625, 2.0**52 + 1, 1e300]
    for _ in range(3000):
        whole, bits = rng.choice([0, 1, 7, 100, 12345, 2**30, 2**33 - 1]), rng.randint(1, 25)
        out.append(rng.choice([-1, 1]) * (whole + rng.randrange(1 << bits) / (1 << bits)))
        out.append(rng.uniform(-1, 1) * 10 ** rng.randint(-9, 12))
        near = round(rng.uniform(0, 200), digits) + 0.5 / 10**digits  # beside a decimal midpoint
        out += [near, math.nextafter(near, 0), math.nextafter(near, 1e9)]
    return out


@pytest.mark.parametrize("digits", [1, 2, 4, 6, 9])
def test_rounds_as_python_does(spark, digits):
    data = values(digits)
    df = spark.createDataFrame([(k, v) for k, v in enumerate(data)], "k int, v double").select("k", rounded(F.col("v"), digits).alias("r"))
    got = [r.r for r in df.orderBy("k").collect()]
    off = [(v, g, round(v, digits)) for v, g in zip(data, got, strict=True) if g != round(v, digits) or math.copysign(1, g) != math.copysign(1, round(v, digits))]
    assert off == []


def test_what_is_no_number_stays(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf")), (4, float("-inf"))], "k int, v double")
    got = [r.r for r in df.select("k", rounded(F.col("v")).alias("r")).orderBy("k").collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2:] == [float("inf"), float("-inf")]
    with pytest.raises(ValueError):
        rounded(F.lit(1.0), 0)


def test_damping_agrees_with_a_loop(spark):
    """Sums of powers, added frame by frame: the same doubles at every frame."""
    for damping in (0.9, 0.37):
        wanted, total, step = [], 0.0, damping
        for _ in range(120):
            total, step = total + step, step * damping
            wanted.append(total)
        df = spark.range(1, 122).select("id", damped_sum(F.col("id"), damping).alias("p"))
        got = [r.p for r in df.orderBy("id").collect()]
        assert got[:120] == wanted and got[120] == pytest.approx(wanted[-1], rel=1e-6)
