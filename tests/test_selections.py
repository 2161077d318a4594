"""Order, selections, pairing, exact sums, asset rules and archives."""

import random
import zipfile
from fractions import Fraction

import pandas as pd
import pytest
from kinetrail.operators import evaluate, order, report, scan, select, sums, validate
from kinetrail.schema import KEYS
from kinetrail.sources import archives
from pyspark.sql import functions as F

KEY = "game_id long, play_id long, nfl_id long, frame_id long"


def test_key_order(spark):
    rows = [(g, p, i, f) for g in (2, 1) for p in (1, 2) for i in (7, 3) for f in (2, 1)]
    numbered = order.key_order(spark.createDataFrame(rows, KEY), ["game_id", "play_id"], ["nfl_id", "frame_id"]).cache()
    got = [tuple(r) for r in order.in_request_order(numbered).collect()]
    assert got == [(*r, n) for n, r in enumerate(sorted(rows))]
    assert order.order_mismatches(numbered, numbered, KEYS).isEmpty()
    fewer = numbered.where("request_order <> 3")
    assert [r.request_order for r in order.order_mismatches(fewer, numbered, KEYS).collect()] == [3]
    assert order.key_order(spark.createDataFrame([], KEY), ["game_id"], ["nfl_id"]).count() == 0


@pytest.mark.parametrize("kind", ["csv", "parquet", "json"])
def test_written_order(spark, tmp_path, kind):
    """Shuffled keys in shuffled files, read in small blocks: rows come back as the caller wrote them, and with their keys reversed."""
    rng = random.Random(5)
    keys = [(g, p, i, f) for g in (2, 1) for p in (1, 2, 3) for i in range(1, 12) for f in range(1, 13)]
    rng.shuffle(keys)
    parts, paths = [keys[:300], keys[300:310], keys[310:]], []
    for name, part in zip(("b", "c d", "a"), parts, strict=True):
        paths.append(str(tmp_path / f"{name}.{kind}"))
        frame = pd.DataFrame(part, columns=KEYS)
        if kind == "csv":
            frame.to_csv(paths[-1], index=False)
        elif kind == "json":
            frame.to_json(paths[-1], orient="records", lines=True)
        else:
            frame.to_parquet(paths[-1], row_group_size=50)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        reader = spark.read.schema(KEY).option("header", True)
        source = reader.format(kind).load(paths)
        assert source.rdd.getNumPartitions() > 3
        numbered = order.written_order(source, paths)
        got = [tuple(r)[:4] for r in order.in_request_order(numbered.orderBy(F.rand(2))).collect()]
        assert got == keys
        assert sorted(r.request_order for r in numbered.collect()) == list(range(len(keys)))
        by_name = [tuple(r)[:4] for r in order.in_request_order(order.written_order(source)).collect()]
        assert by_name == parts[2] + parts[0] + parts[1]
        with pytest.raises(Exception, match="not among the files"):
            order.written_order(source, paths[:2]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    answers = order.key_order(numbered.drop("request_order"), ["game_id"], ["play_id", "nfl_id", "frame_id"])
    off = {r.request_order for r in order.order_mismatches(answers, numbered, KEYS).collect()}
    assert off == {n for n, (a, b) in enumerate(zip(keys, sorted(keys), strict=True)) if a != b}


def test_chosen_and_only(spark):
    rows = spark.createDataFrame([(1, 1, 5, 1), (1, 2, 5, 1), (2, 1, 6, 1)], KEY)
    assert select.chosen(rows).count() == 3
    assert select.chosen(rows, game=1).count() == 2
    assert select.chosen(rows, play="1", player=6).count() == 1
    assert tuple(select.only(rows, "nfl_id = 6").first()) == (2, 1, 6, 1)
    for condition in ("nfl_id = 5", "nfl_id = 9"):
        with pytest.raises(Exception, match="one is wanted"):
            select.only(rows, condition).collect()


def test_blocked_paths(spark):
    names = ["a.PT", "x/.env", "x/.env.local", "b.pt/readme.md", "A.Json", ".zip", None, "", "c.tar.gz", "gz"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r.path for r in select.blocked_paths(files, names=["a.json"]).collect()} == {"a.PT", "x/.env", "x/.env.local", "A.Json", "c.tar.gz"}


def test_pairing(spark):
    points = [(m, g, 1, 1, f, 0.0, 0.0) for m in "ab" for g in (1, 2) for f in (1, 2)]
    frame = lambda rows: spark.createDataFrame(rows, f"model string, {KEY}, dx double, dy double")
    assert [tuple(r) for r in evaluate.pairing(frame(points)).collect()] == [("a", "b", 2, 0, True)]
    evaluate.require_pairable(frame(points))
    for bad in (points[:-1], [p for p in points if p[1] == 1]):
        with pytest.raises(ValueError, match="a and b"):
            evaluate.require_pairable(frame(bad))


def test_exact_sum(spark):
    draw = random.Random(3)
    rows = [("wide", draw.choice([-1, 1]) * draw.random() * 2.0 ** draw.randrange(-300, 300)) for _ in range(400)]
    rows += [("cancel", v) for v in (1e100, 1.0, -1e100, 5e-324)] + [("none", None), ("inf", float("inf")), ("inf", 1.0), ("zero", 0.0)]
    rows += [("near", v) for k in range(1, 60) for v in (2.0**k, -(2.0**k) * (1 - 2**-53), 0.1)]
    got = {r.k: r.v for r in sums.exact_sum(spark.createDataFrame(rows, "k string, v double").repartition(3), "v", "k").collect()}
    for k in ("wide", "cancel", "zero", "near"):
        assert got[k] == float(sum(Fraction(v) for a, v in rows if a == k)), k
    assert got["inf"] == float("inf") and "none" not in got


def test_asset_findings(spark):
    html = """<iframe src=a></iframe><meta http-equiv="Refresh" content="0"><img srcset="a 2x"><style>@import "a"; p{background:url( '//x/y')}
    q{background:url(a.png)}</style><link rel="canonical" href="http://a"><link rel=canonical href=https://a/b><svg onload="a()"><script>1</script></svg>
    <p onclick="b()"><script>import("x")</script>"""
    r = scan.asset_findings(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert r[0].asDict() == {"page_id": 1, "frames": 1, "refresh": 1, "srcset": 1, "css_import": 1, "module_import": 1} | {
        "svg_active": 1, "svg_handler": 1, "css_remote": 1, "bad_canonical": 1, "remote_asset": 0
    }
    assert set(tuple(r[1])[1:]) == {0}


def test_archives(spark, tmp_path):
    def archive(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, text in members:
                z.writestr(member, text)
        return str(tmp_path / name)

    good = archive("good.zip", [("train/w1.csv", "a,b\r\n1,2\n\n3")])
    assert [(r.line, r.value) for r in archives.member_lines(spark, good, "train/w1.csv").orderBy("line").collect()] == [(0, "a,b"), (1, "1,2"), (2, ""), (3, "3")]
    assert archives.member_lines(spark, archive("empty.zip", [("w1.csv", "")]), "train/w1.csv").count() == 0
    for name, members in (("two.zip", [("w1.csv", "a"), ("b", "b")]), ("up.zip", [("../w1.csv", "a")]), ("other.zip", [("w2.csv", "a")])):
        with pytest.raises(Exception, match="wanted file"):
            archives.member_lines(spark, archive(name, members), "w1.csv").collect()
    with pytest.raises(Exception, match="too large"):
        archives.member_lines(spark, good, "train/w1.csv", largest=3).collect()
    with pytest.raises(ValueError, match="unsafe"):
        archives.member_lines(spark, good, "../w1.csv")


def test_options():
    assert validate.options("damped_velocity") == ("damped_velocity", 0.9, 12)
    assert validate.options("last_position", 1, 3) == ("last_position", 1.0, 3)
    for bad in (("none",), ("last_position", 1.1), ("last_position", True), ("last_position", "0.5"), ("last_position", float("nan")), ("last_position", 0.5, 0), ("last_position", 0.5, 13), ("last_position", 0.5, 2.0)):
        with pytest.raises(validate.Invalid):
            validate.options(*bad)


def test_views_keep_their_proportions(spark):
    rows = [(1, 1, 1, 1, 10.0, 20.0), (1, 1, 1, 2, 12.0, 20.0), (1, 2, 1, 1, 0.0, 0.0), (1, 2, 2, 1, 110.0, 5.0)]
    points = spark.createDataFrame(rows, f"{KEY}, x double, y double")
    for r in report.framed_bounds(points, points.limit(0)).collect():
        assert (r.x_high - r.x_low) / (r.y_high - r.y_low) == pytest.approx(700 / 402)
        assert r.x_low >= 0 and r.y_low >= 0
    by = {(r.play_id, r.nfl_id): r for r in report.panel_scale(points, points.limit(0)).collect()}
    assert (by[1, 1].center_x, by[1, 1].center_y, by[1, 1].scale) == (11.0, 20.0, min(280 / 4, 235 / 2))
