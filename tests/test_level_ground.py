"""Pylons on ground without any form, where samples tie and the last bits of the spacing decide."""

from pyspark.sql import functions as F

from terrapath.config import LIFT_TYPES
from terrapath.operators import lifts as L
from terrapath.plans import sqlkit as S
from terrapath.sources import dem as D

KEYS = (3885, 7279, 316679, 885455)


def ends(spark):
    rows = []
    for k in KEYS:
        lon, lat = 10.002 + 0.00003 * ((7 * k) % 1700), 46.99 - 0.00011 * ((13 * k) % 2200)
        rows.append((1, f"L{k + 1}", LIFT_TYPES[k % 4], lon, lat, lon + 0.0004 * (k % 7 - 3), lat + 0.000103717 + 0.00120313 * (k % 13), 2000.0, 2000.0))
    cols = "resort_id int, lift_id string, lift_type string, start_lon double, start_lat double, end_lon double, end_lat double, start_elevation double, end_elevation double"
    return spark.createDataFrame(rows, cols)


def test_length_has_the_bits_of_the_twin(spark, con):
    rows = ends(spark).select("*", L.length_between().alias("m")).collect()
    for r in rows:
        twin = con.execute("SELECT " + S.hav(f"{r.start_lat!r}::double", f"{r.start_lon!r}::double", f"{r.end_lat!r}::double", f"{r.end_lon!r}::double")).fetchone()[0]
        assert r.m == twin


def test_ties_on_level_ground(spark):
    cells = spark.createDataFrame([(0, 0, 2000.0)], "row long, col int, elevation double")
    lifts = L.with_terrain(ends(spark), cells, D.DemMeta(10.0, 47.0, 0.0008, 0.00054, 2000, 64))
    found = {r.lift_id: list(r.clear) for r in L.pylon_phases(lifts).collect()}
    assert found["L7280"] == [2, 10, 18, 27, 43, 51]
    assert found["L3886"] == [2, 4, 8, 11, 14, 17, 21, 24, 28, 31, 35, 38, 42, 45, 47]


def test_length_of_missing_ends(spark):
    none = ends(spark).limit(1).withColumn("end_lat", F.lit(None).cast("double"))
    assert none.select(L.length_between().alias("m")).first().m is None


def test_line_points_have_the_bits_of_the_twin(spark, con):
    from terrapath.plans.lift_plans import TERRAIN

    n = 300
    lifts = spark.range(n).selectExpr(
        "0 AS resort_id", "concat('L', id) AS lift_id", "10.002D + 0.00003D * ((7 * id) % 1700) AS start_lon",
        "46.99D - 0.00011D * ((13 * id) % 2200) AS start_lat", "2000D AS start_elevation", "2500D AS end_elevation", "id",
    ).selectExpr("*", "start_lon + 0.0004D * (id % 7 - 3) AS end_lon", "start_lat + 0.000103717D + 0.00120313D * (id % 13) AS end_lat")
    cells = spark.createDataFrame([(0, 0, 2000.0)], "row long, col int, elevation double")
    found = {(r.lift_id, r.i): (r.lon, r.lat) for r in L.terrain_samples(lifts, cells, D.DemMeta(10.0, 47.0, 0.0008, 0.00054, 2000, 64)).collect()}
    lift = f"""SELECT *, start_lon+0.0004::double*(k%7-3) AS end_lon, start_lat+0.000103717::double+0.00120313::double*(k%13) AS end_lat FROM (
      SELECT k, 10.002::double+0.00003::double*((7*k)%1700) AS start_lon, 46.99::double-0.00011::double*((13*k)%2200) AS start_lat FROM (SELECT unnest(range(0,{n})) AS k))"""
    steps = ",".join(f"{k} AS ({TERRAIN[k]})" for k in ("l1", "l2", "l3", "l4"))
    twin = con.execute(f"WITH lift AS ({lift}),{steps} SELECT 'L'||k, i, lon, lat FROM l4").fetchall()
    assert found == {(k, i): (lon, lat) for k, i, lon, lat in twin}


def test_cable_distance_has_the_bits_of_the_twin(spark, con):
    rows = ends(spark).selectExpr(
        "*", "sqrt(pow(end_lat - start_lat, 2)) * 100000D AS length_m",
        "array(struct(start_lon AS lon, start_lat AS lat, 0D AS elevation), struct(end_lon AS lon, end_lat AS lat, 0D AS elevation)) AS terrain_points",
        "transform(sequence(0, 200), k -> struct(start_lon + k * 1e-6D AS lon, start_lat + k * 1e-5D AS lat, 1D AS elevation)) AS cable_points",
    )
    spots = {(r.lift_id, i): (r.start_lat, r.start_lon, p.lat, p.lon) for r in rows.collect() for i, p in enumerate(r.cable_points)}
    found = {(r.lift_id, r.i): r.x_m for r in L.cable_profile(rows).collect()}
    twin = {k: con.execute("SELECT " + S.hav(*(f"{v!r}::double" for v in p))).fetchone()[0] for k, p in spots.items()}
    assert found == twin


def test_rounding_goes_by_the_scaled_value(spark, con):
    from terrapath.plans.registry import r7

    values = [46.61234585, 46.61234645, 46.61234705, 46.61234765, -46.61234585, 46.61234565, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", r7("v").alias("r")).collect()
    for r in rows:
        assert r.r == con.execute(f"SELECT round({r.v!r}::double, 7)").fetchone()[0]


def test_search_of_many_lifts_equals_each_alone():
    import numpy as np

    from terrapath.functions.liftline import pylon_search

    rng = np.random.default_rng(3)
    sizes = np.array([2, 3, 40, 0, 51, 17])
    z = [np.cumsum(rng.normal(3, 8, n)) for n in sizes]
    par = [30.0 * (sizes - 1.0), *(np.full(len(sizes), v) for v in (60.0, 250.0, 5.0, 12.0, 6.0, 0.04))]
    par[3][5] = np.nan  # unknown clearance: no pylon but those of the spacing
    whole = pylon_search(np.concatenate(z), sizes, *par)
    for k in range(len(sizes)):
        alone = pylon_search(z[k], sizes[k : k + 1], *(p[k : k + 1] for p in par))
        assert all(w[1][w[0] == k].tolist() == a[1].tolist() for w, a in zip(whole, alone, strict=True))
    assert not (whole[0][0] == 5).any() and (whole[1][0] == 5).any() and len(whole[2][0]) > 10


def test_cable_of_many_lifts_equals_each_alone():
    import numpy as np

    from terrapath.functions.liftline import cable_points

    sizes, anchors = np.array([4, 0, 3, 2]), np.array([2, 0, 1, 0])
    lon, lat = np.arange(9) * 0.001, np.arange(9) * 0.002
    length, x, y = np.array([600.0, 100.0, 450.0, 40.0]), np.array([390.0, 150.0, 220.0]), np.array([30.0, 20.0, 25.0])
    rest = [np.array([10.0, 11.0, 12.0, 13.0]), np.array([50.0, 51.0, 52.0, 53.0]), np.full(4, 0.04)]
    lift, *values = cable_points(lon, lat, sizes, length, x, y, anchors, *rest)
    assert np.bincount(lift, minlength=4).tolist() == [11 + 12 + 10, 0, 12 + 11, 11]
    at, ax = np.cumsum(sizes) - sizes, np.cumsum(anchors) - anchors
    for k in (0, 2, 3):
        own, pylon = slice(at[k], at[k] + sizes[k]), slice(ax[k], ax[k] + anchors[k])
        alone = cable_points(lon[own], lat[own], sizes[k : k + 1], length[k : k + 1], x[pylon], y[pylon], anchors[k : k + 1], *(v[k : k + 1] for v in rest))
        assert all(v[lift == k].tolist() == w.tolist() for v, w in zip(values, alone[1:], strict=True))
    z = values[2][lift == 0]
    assert (z[0], z[10], z[22], z[-1]) == (10.0, 20.0, 30.0, 50.0)
