"""Tracing, routing, documents and streams."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions import gridpath
from terrapath.operators import fan, route
from terrapath.sources import dem as D
from terrapath.sources import resort_json as J

M = C.METERS_PER_DEGREE


@pytest.fixture(scope="module")
def plane(spark):
    """Fine raster of the plane falling 30 % south and 10 % east around (0, 0)."""
    n = 260
    meta = D.DemMeta(-0.0052, 0.0052, 0.00004, 0.00004, n, n)
    cells = spark.range(n * n).select((F.col("id") / n).cast("long").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    lat, lon = meta.y0 - (F.col("row") + 0.5) * meta.dy, meta.x0 + (F.col("col") + 0.5) * meta.dx
    return cells.withColumn("elevation", 2500.0 + lat * M * 0.30 - lon * M * 0.10), meta


def test_gradient_of_plane(spark, plane):
    p = spark.createDataFrame([(1, 0.00002, 0.00002)], "id int, lon double, lat double")
    g = D.gradient(p, *plane, "id").first()
    assert g.slope_pct == pytest.approx(15.83, abs=1.5) and g.bearing_deg == pytest.approx(161.6, abs=6)


def test_fan_on_plane(spark, plane):
    starts = spark.createDataFrame([(1, 0.00002, 0.00402, 400.0)], "request_id bigint, lon double, lat double, length_m double")
    got = fan.generate_fan(starts, *plane).orderBy("ord").collect()
    assert [r.side for r in got] == ["left", "right"] * 2 + ["center"] * 5
    for r in got:
        steps = [math.dist((a.lon * M, a.lat * M), (b.lon * M, b.lat * M)) for a, b in itertools.pairwise(r.points)]
        assert all(s == pytest.approx(30.0, abs=0.2) for s in steps)
        assert r.points[0].elevation > r.points[-1].elevation
        assert 0.5 * 400 < r.length_m < 1.5 * 400
    left, right = got[0].points[-1], got[1].points[-1]
    assert math.dist((left.lon * M, left.lat * M), (right.lon * M, right.lat * M)) > 30


def test_busy_tile_is_split_without_changing_paths(spark, plane):
    starts = spark.range(40).select(F.col("id").alias("k"), (0.00001 * F.col("id")).alias("lon"), F.lit(0.004).alias("lat"), F.lit(12.0).alias("target_slope_pct"), F.lit("left").alias("side"), F.lit(300.0).alias("length_m"))
    rows = lambda g: sorted((r.k, r.length_m, r.drop_m) for r in fan.trace_downhill(starts, *plane, "k", group_rows=g).collect())
    assert rows(5) == rows(4096)


def brute(lons, lats, z, start, goal, grade):
    import heapq

    n, best, heap = lons.shape[0], {start: 0.0}, [(0.0, start)]
    while heap:
        d, (r, c) = heapq.heappop(heap)
        if d > best[(r, c)]:
            continue
        for dr, dc in gridpath.MOVES:
            q = (r + dr, c + dc)
            if not (0 <= q[0] < n and 0 <= q[1] < n):
                continue
            h = gridpath.haversine(lons[r, c], lats[r, c], lons[q], lats[q])
            nd = d + float(gridpath.edge_cost(np.array(h), np.array(z[r, c] - z[q]), grade))
            if nd < best.get(q, math.inf):
                best[q] = nd
                heapq.heappush(heap, (nd, q))
    return best[goal]


def test_least_cost_is_optimal():
    rng = np.random.default_rng(1)
    lons, lats = gridpath.search_grid(10.0, 46.5, 10.0003, 46.4993, gridpath.haversine(10.0, 46.5, 10.0003, 46.4993))
    z = 2000 + (lats - 46.5) * 30000 + rng.normal(0, 3, lons.shape)
    start, goal = (2, 3), (lons.shape[0] - 2, 5)
    for grade, (cost, rr, cc) in zip((7.0, 22.0, 60.0), gridpath.least_cost(lons, lats, z, start, goal, (7.0, 22.0, 60.0)), strict=True):
        assert cost == pytest.approx(brute(lons, lats, z, start, goal, grade), rel=1e-9)
        assert (rr[0], cc[0]) == start and (rr[-1], cc[-1]) == goal
        assert all(max(abs(a - b), abs(c - d)) == 1 for (a, c), (b, d) in itertools.pairwise(zip(rr, cc)))


def test_huge_costs_leave_no_cycle():
    lons, lats = gridpath.search_grid(10.0, 46.5, 10.0, 46.4985, 167.0)
    z = np.where(np.arange(lons.shape[0])[:, None] % 2 == 0, 2200.0, 2000.0) + np.zeros(lons.shape)
    (hit,) = gridpath.least_cost(lons, lats, z, (0, 0), (lons.shape[0] - 1, 4), (12.0,))
    assert len(set(zip(hit[1], hit[2]))) == len(hit[1])


def test_manual_paths(spark, plane):
    req = spark.createDataFrame(
        [(1, 0.0, 0.002, 0.0003, 0.0005), (2, 0.0, 0.002, 0.0, 0.0021), (3, 0.0, 0.0, 0.5, 0.5)],
        "request_id bigint, lon double, lat double, target_lon double, target_lat double",
    )
    got = route.manual_paths(req, *plane).orderBy("request_id", "avg_slope_pct").collect()
    by = {k: list(v) for k, v in itertools.groupby(got, lambda r: r.request_id)}
    assert set(by) == {1, 2}  # outside the raster: nothing
    assert len(by[1]) >= 2 and all("Left" in r.sector_name for r in by[1])
    assert [r.sector_name for r in by[2]] == ["📍 Direct Line (fallback)"]
    for r in by[1]:
        gaps = [math.dist((a.lon * M, a.lat * M), (b.lon * M, b.lat * M)) for a, b in itertools.pairwise(r.points)]
        assert max(gaps[:-1]) < 7.5
        assert r.points[0].elevation > r.points[-1].elevation


def test_similar_paths_are_dropped(spark):
    p = lambda dx: [(10 + dx + 0.001 * i, 47.0, 100.0 - i) for i in range(5)]
    df = spark.createDataFrame(
        [(1, 0, 20.0, p(0.0)), (1, 1, 10.0, p(0.00001)), (1, 2, 30.0, p(0.01))],
        "request_id bigint, ord int, avg_slope_pct double, points array<struct<lon:double,lat:double,elevation:double>>",
    )
    assert sorted(r.ord for r in route.drop_similar(df).collect()) == [1, 2]


def test_document_round_trip(spark, sf, tmp_path):
    import json

    from terrapath.plans.resort_plans import document_fragments
    from terrapath.sources import fixtures as X

    frags = document_fragments(spark, sf)
    J.write_fragments(frags, str(tmp_path / "docs"))
    docs = {}
    for r in sorted(frags.collect(), key=lambda r: (r.resort_id, r.part, r.item)):
        docs[r.resort_id] = docs.get(r.resort_id, "") + r.text
    for text in docs.values():
        assert json.loads(text)["version"] == "2.0"
    texts = spark.createDataFrame(list(docs.items()), "resort_id bigint, text string")
    good, bad = J.load_part(J.parse_documents(texts), "segments")
    want = X.segments(spark, sf).select("resort_id", F.col("segment_id").alias("id"), "points", "side_slope_pct", "side_slope_dir")
    cols = want.columns
    assert bad.count() == 0 and good.select(*cols).exceptAll(want).count() == 0 and good.count() == want.count()


def test_gpx_is_well_formed(spark, sf):
    import xml.etree.ElementTree as ET

    from terrapath.plans import catalog

    rows = catalog.QUERIES["snk1_gpx_fragments"](spark, sf).collect()
    one = min(r.resort_id for r in rows)
    text = "".join(r.text for r in sorted((r for r in rows if r.resort_id == one), key=lambda r: (r.part, r.item, r.piece)))
    root = ET.fromstring(text)
    assert root.findall("{*}trk/{*}trkseg/{*}trkpt")


def test_raster_tiles_on_disk(spark, plane, tmp_path):
    cells, meta = plane
    D.write_tiles(cells, str(tmp_path / "dem"))
    tiles = spark.read.parquet(str(tmp_path / "dem"))
    box = D.crop(tiles, meta, (-0.001, -0.001, 0.001, 0.001))
    assert box.count() == D.crop(cells, meta, (-0.001, -0.001, 0.001, 0.001)).count() > 0
    assert "PartitionFilters: [" in box._jdf.queryExecution().toString() and "tile_r" in box._jdf.queryExecution().toString()


def run_stream(spark, df, path, transform, name):
    df.repartition(1).sortWithinPartitions(df.columns[1]).write.parquet(path)
    q = (
        transform(spark.readStream.schema(df.schema).parquet(path))
        .writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_equals_batch_clicks(spark, sf, tmp_path):
    from terrapath.operators import history as H
    from terrapath.plans.event_plans import click_events
    from terrapath.streaming.clicks import debounce_stream

    ev = click_events(spark, sf).withColumn("ts", F.timestamp_millis(F.col("ms") + 1_700_000_000_000))
    got = run_stream(spark, ev, str(tmp_path / "c"), debounce_stream, "clicks_out")
    want = H.debounce(ev, "session_id", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_equals_batch_edits(spark, sf, tmp_path):
    from terrapath.operators import history as H
    from terrapath.sources import fixtures as X
    from terrapath.streaming.edits import replay_stream

    log = X.edit_log(spark, sf).select("resort_id", "op_seq", "op")
    got = run_stream(spark, log, str(tmp_path / "e"), replay_stream, "edits_out").select("resort_id", "op_seq", "undoes")
    want, _ = H.replay_edits(log)
    key = lambda r: (r.resort_id, r.op_seq, r.undoes or -1)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
