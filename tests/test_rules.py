"""Hand-computed cases of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions import geo, paths, rules, terrain

M = C.METERS_PER_DEGREE


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def line(spark, pts):
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(p, ("lon", "lat", "elevation"))]) for p in pts])


def test_distances_and_bearings(spark):
    r = one(
        spark,
        lat=geo.haversine_m(46.0, 10.0, 47.0, 10.0),
        lon=geo.haversine_m(46.0, 10.0, 46.0, 11.0),
        north=geo.bearing_deg(10.0, 46.0, 10.0, 47.0),
        east=geo.bearing_deg(10.0, 0.0, 11.0, 0.0),
    )
    assert r.lat == pytest.approx(111_195, abs=100) and r.lon == pytest.approx(77_240, abs=200)
    assert r.north == pytest.approx(0.0) and r.east == pytest.approx(90.0)


def test_round_trip_of_one_kilometre(spark):
    p = geo.destination(10.0, 46.0, 45.0, 1000.0)
    r = one(spark, d=geo.haversine_m(46.0, 10.0, p["lat"], p["lon"]))
    assert r.d == pytest.approx(1000.0, abs=0.01)


@pytest.mark.parametrize(
    ("slope", "want"),
    [(-5, "green"), (0, "green"), (14.9, "green"), (15, "blue"), (24.9, "blue"), (25, "red"), (39.9, "red"), (40, "black"), (100, "black"), (math.nan, "green")],
)
def test_thresholds(spark, slope, want):
    assert one(spark, d=terrain.classify(float(slope))).d == want


def test_wrap_keeps_both_ends(spark):
    r = one(spark, a=geo.wrap_turn(180.0), b=geo.wrap_turn(-180.0), c=geo.wrap_turn(270.0), d=geo.clamp_turn(100.0))
    assert (r.a, r.b, r.c, r.d) == (180.0, -180.0, -90.0, 40.0)


def test_compass_sectors(spark):
    r = one(spark, **{f"b{i}": geo.compass(float(b)) for i, b in enumerate((0, 22.4, 22.5, 180, 337.4, 337.5, 359.9))})
    assert list(r) == ["N", "N", "NE", "S", "NW", "N", "N"]


def test_rolling_window_sections(spark):
    """10 / 45 / 10 m drops per 100 m step: the steep middle decides."""
    z, pts, lat = 2500.0, [], 46.97
    for i in range(13):
        pts.append((10.27, lat - 0.0009 * i, z))
        z -= 45.0 if 4 <= i < 8 else 10.0
    df = spark.range(1).select(line(spark, pts).alias("points"))
    r = paths.with_path_metrics(df).first()
    assert 40 < r.max_slope_pct < 50 and 15 < r.avg_slope_pct < 30 and r.difficulty == "black"


def test_short_and_empty_paths(spark):
    empty = F.array().cast("array<struct<lon:double,lat:double,elevation:double>>")
    for pts, size in ((empty, 0), (line(spark, [(10, 46, 100)]), 1)):
        r = paths.with_path_metrics(spark.range(1).select(pts.alias("points"))).first()
        assert (r.length_m, r.drop_m, r.avg_slope_pct, r.difficulty) == (0.0, 0.0, 0.0, "green"), size


def test_width_and_warnings(spark):
    r = one(
        spark,
        flat=paths.belt_width_m(0.5, F.lit("green")),
        mid=paths.belt_width_m(-20.0, F.lit("red")),
        tight=paths.belt_width_m(60.0, F.lit("blue")),
        w=paths.warnings(75.0, -60.0, F.lit("left"), F.lit("black")),
        ok=paths.warnings(20.0, 5.0, F.lit("flat"), F.lit("blue")),
    )
    assert (r.flat, r.mid, r.tight) == (25.0, 25.0, 20.0)
    assert [x.warning_type for x in r.w] == ["ExcavatorWarning", "TooSteepWarning"] and r.ok == []


def test_belt_area(spark):
    """Ribbon area = length x width + round caps (polygon caps are slightly smaller)."""
    pts = [(10.0, 46.0 - 0.0001 * i, 100.0) for i in range(30)]
    r = spark.range(1).select(line(spark, pts).alias("p")).select(
        paths.belt_polygon(F.col("p"), 20.0).alias("ring"), paths.length_m(F.col("p")).alias("len")
    ).first()
    xy = [(q.lon * M * math.cos(math.radians(46.0)) * 6371000 * math.pi / 180 / M, q.lat * 6371000 * math.pi / 180) for q in r.ring]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(xy, xy[1:]))) / 2
    assert area == pytest.approx(r.len * 20 + math.pi * 100, rel=0.01)
    assert r.ring[0] == r.ring[-1]


@pytest.mark.parametrize(("s", "e", "bad"), [(1500, 2000, False), (2000, 1500, True), (2000, 2000, True)])
def test_lift_uphill(spark, s, e, bad):
    assert (one(spark, v=rules.lift_uphill(float(s), float(e))).v is not None) == bad


@pytest.mark.parametrize(("drop", "bad"), [(100, False), (-100, True), (4, True), (5, False)])
def test_target_drop(spark, drop, bad):
    assert (one(spark, v=rules.target_downhill(2000.0, 2000.0 - drop)).v is not None) == bad


@pytest.mark.parametrize(("lat", "lon", "bad"), [(46.005, 10.0, False), (46.1, 10.1, True)])
def test_target_range(spark, lat, lon, bad):
    assert (one(spark, v=rules.target_distance(46.0, 10.0, lat, lon)).v is not None) == bad


def test_similarity(spark):
    a = [(10 + 0.001 * i, 47.0, 0) for i in range(4)]
    b = [(10.0, 47 - 0.001 * i, 0) for i in range(4)]
    A, B = line(spark, a), line(spark, b)
    r = one(spark, same=paths.similar_paths(A, A), other=paths.similar_paths(A, B), short=paths.similar_paths(line(spark, a[:2]), A))
    assert (r.same, r.other, r.short) == (True, False, False)
