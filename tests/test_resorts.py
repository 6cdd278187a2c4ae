"""Resorts number their parts independently: equal ids of two resorts never meet."""

import pytest
from pyspark.sql import functions as F

from terrapath.operators import commit as M
from terrapath.operators import graph as G
from terrapath.operators import history as H
from terrapath.operators import lifts as L
from terrapath.operators import route as R
from terrapath.operators.scan import number_rows, with_previous
from terrapath.sources import dem as D

POINTS = "array<struct<lon:double,lat:double,elevation:double>>"


@pytest.fixture(scope="module")
def two(spark):
    """Two resorts with S1, SL1, N1, N2 each; the second one's run is twice as long and falls half as much."""
    rows = []
    for r, n in ((1, 20), (2, 40)):
        pts = [(10.0 + r, 47.0 - 0.0005 * i, 2000.0 - (10 if r == 1 else 2.5) * i) for i in range(n)]
        rows.append((r, "S1", "Segment 1", pts, "N1", "N2", 0.0, "flat"))
    seg = spark.createDataFrame(rows, f"resort_id bigint, segment_id string, name string, points {POINTS}, start_node_id string, end_node_id string, side_slope_pct double, side_slope_dir string")
    slopes = spark.createDataFrame([(1, "SL1", ["S1"]), (2, "SL1", ["S1"])], "resort_id bigint, slope_id string, segment_ids array<string>")
    nodes = [(r[0], k, p[0], p[1], p[2]) for r in rows for k, p in (("N1", r[3][0]), ("N2", r[3][-1]))]
    return seg, slopes, spark.createDataFrame(nodes, "resort_id bigint, node_id string, lon double, lat double, elevation double")


def by_resort(df, *cols):
    out = {}
    for r in df.collect():
        assert r.resort_id not in out
        out[r.resort_id] = tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]
    return out


def test_statistics(two):
    seg, slopes, nodes = two
    facts = G.segment_facts(seg)
    stats = by_resort(G.slope_stats(slopes, facts), "n_segments", "drop_m", "length_m")
    assert stats[1][:2] == (1, pytest.approx(190.0)) and stats[2][:2] == (1, pytest.approx(97.5))
    assert stats[2][2] == pytest.approx(stats[1][2] * 39 / 19, rel=1e-3)
    running = by_resort(G.group_stats(slopes, facts, "slope_id", "segment_ids"), "total_drop", "total_length")
    assert running == {r: (pytest.approx(s[1]), pytest.approx(s[2])) for r, s in stats.items()}
    assert by_resort(G.segment_parent(seg, slopes), "slope_id") == {1: "SL1", 2: "SL1"}
    line = G.joined_points(G.slope_members(slopes), seg, "slope_id")
    assert by_resort(line.groupBy("resort_id").agg(F.count("i").alias("n"), F.max("i").alias("m")), "n", "m") == {1: (20, 19), 2: (40, 39)}
    finished = M.finish_slopes(slopes, facts, nodes)
    names = by_resort(finished, "name")
    assert len(set(names.values())) == 2
    assert by_resort(M.rename_segments(seg, finished, slopes), "name") == names


@pytest.fixture(scope="module")
def hill(spark):
    """Raster that falls 30 m per row."""
    meta = D.DemMeta(9.95, 47.01, 0.001, 0.001, 40, 80)
    cells = spark.range(3200).select((F.col("id") / 80).cast("long").alias("row"), (F.col("id") % 80).cast("int").alias("col"))
    return cells.withColumn("elevation", 3000.0 - 30.0 * F.col("row")), meta


def test_lift_terrain(spark, hill):
    ends = [(r, "L1", "chairlift", "N1", "N2", 10.0, 46.98 + 0.001 * r, 10.001, 46.995, 2100.0, 2600.0) for r in (1, 2)]
    cols = "resort_id bigint, lift_id string, lift_type string, start_node_id string, end_node_id string, start_lon double, start_lat double, end_lon double, end_lat double, start_elevation double, end_elevation double"
    built = L.create(spark.createDataFrame(ends, cols), *hill)
    sizes = by_resort(built.withColumn("n", F.size("terrain_points")), "n")
    assert sizes[1] > sizes[2] > 0


def test_place_lifts(spark, hill):
    near = 0.0001  # 11 m
    rows = [
        (1, 0, "L1", None, None, 10.0, 46.98, 10.0, 46.99, 2100.0, 2400.0),  # two new nodes
        (1, 1, "L2", None, None, 10.0, 46.98 + near, 10.0, 47.0, 2100.0, 2700.0),  # starts at the first one's bottom
        (1, 2, "L3", "N7", None, 10.005, 46.985, 10.0, 46.99 + near, 2200.0, 2400.0),  # given bottom, known top
        (1, 3, "L4", None, None, 10.0, 46.98, 10.0, 46.99, 2400.0, 2100.0),  # downhill
        (1, 4, "L5", "N7", "N7", 10.005, 46.985, 10.006, 46.985, 2200.0, 2300.0),  # same node
        (2, 0, "L1", None, None, 10.0, 46.98, 10.0, 46.99, 2100.0, 2400.0),
    ]
    cols = "resort_id bigint, ord bigint, lift_id string, start_node_id string, end_node_id string, start_lon double, start_lat double, end_lon double, end_lat double, start_elevation double, end_elevation double"
    stations = spark.createDataFrame(rows, cols).withColumn("lift_type", F.lit("gondola"))
    nodes = spark.createDataFrame([(1, "N7", 7, 10.005, 46.985, 2200.0)], "resort_id bigint, node_id string, node_ord bigint, lon double, lat double, elevation double")
    used = spark.createDataFrame([(1, 7), (2, 0)], "resort_id bigint, used bigint")
    lifts, rejected = L.place_lifts(stations, *hill, nodes, used)
    ids = {(r.resort_id, r.lift_id): (r.start_node_id, r.end_node_id) for r in lifts.collect()}
    assert ids == {(1, "L1"): ("N8", "N9"), (1, "L2"): ("N8", "N10"), (1, "L3"): ("N7", "N9"), (2, "L1"): ("N1", "N2")}
    assert {r.lift_id for r in rejected.collect()} == {"L4", "L5"} and rejected.where("reason IS NULL").count() == 0


def test_commit_onto_a_graph(spark, hill):
    at = lambda lon, lat, z: (lon, lat, z)
    rows = [
        (1, 0, [at(10.0, 47.0, 2700.0), at(10.0, 46.995, 2550.0)], "N5"),  # connector
        (1, 1, [at(10.00005, 47.0, 2700.0), at(10.01, 46.995, 2550.0)], None),  # starts at the first one's start
        (1, 2, [at(10.0, 47.0, 2700.0)], None),  # a single point
        (1, 3, [], None),
        (2, 0, [at(10.0, 47.0, 2700.0), at(10.0, 46.995, 2550.0)], None),
    ]
    proposals = spark.createDataFrame(rows, f"resort_id bigint, ord bigint, points {POINTS}, target_node_id string")
    nodes = spark.createDataFrame([(1, "N5", 5, 10.0001, 46.9951, 2540.0)], "resort_id bigint, node_id string, node_ord bigint, lon double, lat double, elevation double")
    counters = spark.createDataFrame([(1, 5, 9)], "resort_id bigint, node bigint, segment bigint")
    segments, rejected = M.commit_paths(proposals, *hill, nodes, counters)
    got = {(r.resort_id, r.ord): r for r in segments.collect()}
    assert {k: (r.segment_id, r.start_node_id, r.end_node_id) for k, r in got.items()} == {
        (1, 0): ("S10", "N6", "N5"), (1, 1): ("S11", "N6", "N7"), (2, 0): ("S1", "N1", "N2"),
    }
    assert tuple(got[1, 0].points[-1]) == (10.0001, 46.9951, 2540.0)
    assert [(r.resort_id, r.ord) for r in rejected.collect()] == [(1, 2)]


def test_no_request_is_lost(spark, hill):
    cells, meta = hill
    holed = cells.withColumn("elevation", F.when((F.col("row") != 15) | (F.col("col") != 70), F.col("elevation")))
    rows = [
        (1, 10.0, 47.0, 10.0005, 46.997),  # fine
        (2, 10.0, 46.997, 10.0005, 47.0),  # uphill
        (3, 10.0205, 46.997, 10.0205, 46.9935),  # the hole is in its grid
        (4, 9.97, 47.0, 9.971, 46.985),  # 1670 m
        (5, 10.0, 47.0, 10.0, 46.9999),  # 11 m, same cell
        (6, 1.0, 1.0, 10.0, 46.99),  # outside
    ]
    requests = spark.createDataFrame(rows, "request_id bigint, lon double, lat double, target_lon double, target_lat double")
    planned, refused = R.plan_or_refuse(requests, holed, meta)
    why = {r.request_id: r.reason for r in refused.collect()}
    done = {r.request_id for r in planned.select("request_id").distinct().collect()}
    assert done | set(why) == {1, 2, 3, 4, 5, 6} and not done & set(why)
    assert {1, 4} <= done and why[3] == R.NO_ELEVATION and "below" in why[2] and "no elevation" in why[6]
    manual = {r.request_id: r.sector_name for r in R.manual_paths(requests, holed, meta).collect()}
    assert 3 not in manual and "Direct" in manual[2] and "Direct" not in manual[4]


def test_previous_row_over_gaps(spark):
    points = spark.range(50).where("id % 4 <> 3 AND id NOT BETWEEN 20 AND 33").select((F.col("id") % 2).alias("k"), F.col("id").alias("pos"))
    got = {(r.k, r.pos): r.before for r in with_previous(points, ["k"], "pos", {"pos": "before"}, chunk=4).collect()}
    last, want = {}, {}
    for r in points.orderBy("pos").collect():
        want[r.k, r.pos] = last.get(r.k)
        last[r.k] = r.pos
    assert got == want


def test_stuck_session_settles_at_once(spark, monkeypatch):
    calls = []
    real = H.cut_lineage
    monkeypatch.setattr(H, "cut_lineage", lambda df: calls.append(1) or real(df))
    n, counts = 48, []
    for chunk in (16, 4):
        calls.clear()
        clicks = spark.range(n).select(F.lit(1).alias("s"), F.col("id").alias("e"), (F.col("id") * 1000).alias("ms"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(None).cast("string").alias("obj"))
        got = H.debounce(clicks, "s", "e", chunk=chunk)
        assert [r.e for r in got.where("accepted").collect()] == [0]
        counts.append(len(calls))
    assert counts[1] <= counts[0] + 1


def test_tables_after_undo(spark):
    log = [
        (1, "ADD_SEGMENTS", None, None, ["S1", "S2"]), (2, "FINISH_SLOPE", "SL1", "Run", ["S1", "S2"]), (3, "ADD_LIFT", "L1", "Lift", None),
        (4, "DELETE_SLOPE", "SL1", None, None), (5, "UNDO", None, None, None), (6, "DELETE_LIFT", "L1", None, None), (7, "ADD_SEGMENTS", None, None, ["S3"]),
    ]
    cols = "op_seq bigint, op string, entity_id string, name string, segment_ids array<string>"

    def tables(rows):
        df = spark.createDataFrame(rows, cols).withColumn("resort_id", F.lit(1))
        seg, slopes, lifts = H.current_tables(df)
        return {r.segment_id: r.name for r in seg.collect()}, [r.entity_id for r in slopes.collect()], [r.entity_id for r in lifts.collect()]

    assert tables(log) == ({"S1": "Run", "S2": "Run", "S3": "Segment 3"}, ["SL1"], [])
    undo = [(10 + i, "UNDO", None, None, None) for i in range(4)]
    assert tables(log + undo[:1]) == ({"S1": "Run", "S2": "Run"}, ["SL1"], [])
    assert tables(log + undo[:2]) == ({"S1": "Run", "S2": "Run"}, ["SL1"], ["L1"])
    assert tables(log + undo) == ({"S1": "Segment 1", "S2": "Segment 2"}, [], [])
    assert tables(log[:4]) == ({}, [], ["L1"])
