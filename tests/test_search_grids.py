"""Search grids: nodes are not shuffled, and planning searches the whole grid."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapath.functions import gridpath
from terrapath.functions.tracing import haversine
from terrapath.operators import route as R
from terrapath.sources import dem as D

META = D.DemMeta(10.0, 47.0, 0.0008, 0.00054, 100, 100)
REQUESTS = [(k, 10.03 + 0.0001 * k, 46.985, 10.031, 46.985 - 0.0004 * (1 + k % 6)) for k in range(1, 9)]
REQUESTS += [(k + 20, *r) for k, *r in REQUESTS[:3]] + [(40, 10.03, 46.985, 10.03, 46.976)]


@pytest.fixture(scope="module")
def cells(spark):
    grid = spark.range(100 * 100).select(F.floor(F.col("id") / 100).alias("row"), (F.col("id") % 100).cast("int").alias("col"))
    return grid.select("row", "col", (3000.0 - 9.0 * F.col("row") + 3.0 * (F.col("col") % 5)).alias("elevation"))


@pytest.fixture(scope="module")
def requests(spark, cells):
    r = spark.createDataFrame(REQUESTS, "request_id long, lon double, lat double, target_lon double, target_lat double")
    return R.with_elevations(r, cells, META)


def test_nearest_nodes_are_those_of_the_whole_grid(requests, cells):
    nodes = R.grid_nodes(requests, cells, META).join(requests.select("request_id", F.col("lon").alias("x"), F.col("lat").alias("y"), "target_lon", "target_lat"), "request_id")
    near = lambda lon, lat: F.min(F.struct(R.haversine_m(F.col("lat"), F.col("lon"), F.col(lat), F.col(lon)), "row", "col"))
    want = nodes.groupBy("request_id").agg(near("x", "y").alias("a"), near("target_lon", "target_lat").alias("b"))
    want = {r.request_id: (r.a.row, r.a.col, r.b.row, r.b.col) for r in want.collect()}
    got = {r.request_id: (*r.start, *r.target) for r in R.nearest_grid_nodes(requests).collect()}
    assert got == want and len(got) == len(REQUESTS)


def test_no_node_is_shuffled(requests, spark):
    r = spark.createDataFrame(requests.toPandas())
    plan = R.nearest_grid_nodes(r)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" in plan


def test_far_targets_are_reached(spark, cells):
    """The square of these requests has more than 100 nodes a side, and its far corner may lie due south."""
    lat = 47.0 - 63.9 * META.dy
    spots = [(1, 10.03, 46.985, 10.031, 46.972), (2, 10.03, 46.985, 10.031, 46.977), (3, 10.04, lat, 10.04 + 0.0072, lat - 0.0074), (4, 10.04, lat, 10.04 - 0.0072, lat - 0.0074)]
    r = spark.createDataFrame(spots, "request_id long, lon double, lat double, target_lon double, target_lat double")
    paths = R.manual_paths(r, cells, META).collect()
    assert {p.request_id for p in paths} == {1, 2, 3, 4} and not any("fallback" in p.sector_name for p in paths)
    for p in paths:
        _, _, _, lon, lat = spots[p.request_id - 1]
        assert haversine(p.points[-1].lon, p.points[-1].lat, lon, lat) < 25


def test_grades_of_a_large_grid_are_relaxed_apart(monkeypatch):
    lons, lats = gridpath.search_grid(10.0, 46.5, 10.0, 46.4985, 167.0)
    z = 2000.0 + (lats - 46.5) * 30000 + 40 * np.sin(1e4 * lons)
    want = gridpath.least_cost(lons, lats, z, (2, 3), (18, 7), (7.0, 22.0, 60.0))
    monkeypatch.setattr(gridpath, "SWEPT_NODES", 2 * lons.size)
    assert gridpath.least_cost(lons, lats, z, (2, 3), (18, 7), (7.0, 22.0, 60.0)) == want and all(want)
