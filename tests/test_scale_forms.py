"""The chunked forms equal the plain ones, also when one key holds most rows."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.operators import history as H
from terrapath.operators import profile as P
from terrapath.operators.scan import number_rows, running_total, with_previous
from terrapath.operators.snapping import nearest_node, snap_sequence


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds more than a third of the rows."""
    df = spark.range(600).select(
        F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 7).alias("k"), ((F.col("id") * 7919) % 600).alias("o"), (F.col("id") % 11).alias("v")
    )
    return df


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_numbering(skewed):
    got = number_rows(skewed, ["k"], ["o"]).select("k", "o", "pos")
    want = skewed.select("k", "o", (F.row_number().over(W.partitionBy("k").orderBy("o")) - 1).alias("pos"))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("chunk", [3, 16, 4096])
def test_running_total_and_previous(skewed, chunk):
    n = number_rows(skewed, ["k"], ["o"])
    w = W.partitionBy("k").orderBy("pos")
    got = running_total(n, ["k"], "pos", {"s": F.col("v")}, chunk).select("k", "pos", "s")
    assert rows(got) == rows(n.select("k", "pos", F.sum("v").over(w).alias("s")))
    got = with_previous(n, ["k"], "pos", {"v": "p"}, chunk).select("k", "pos", F.coalesce("p", F.lit(-1)))
    assert rows(got) == rows(n.select("k", "pos", F.coalesce(F.lag("v").over(w), F.lit(-1))))


def test_chunked_distance_and_steepness(spark, sf):
    from terrapath.sources import fixtures as X

    t = X.tracks(spark, sf)
    a = P.steepest_sections(P.with_distance(t, "path_id", chunk=4), "path_id")
    b = P.steepest_sections(P.with_distance(t, "path_id"), "path_id")
    cols = ["path_id", *[F.round(n, 5) for n in ("length_m", "max_slope_pct")], "difficulty"]
    assert rows(a.select(*cols)) == rows(b.select(*cols))


def brute_debounce(events):
    out, last = [], {}
    for s, e, ms, x, y, o in sorted(events):
        lx, ly, lo, lm = last.get(s, (None, None, None, None))
        ok = (lm is None or ms - lm >= C.DEBOUNCE_MS) and (o != lo if o else (x, y) != (lx, ly))
        if ok:
            last[s] = (x, y, o or lo, ms)
        out.append((s, e, ok))
    return sorted(out)


def test_debounce_in_chunks(spark):
    rng = random.Random(5)
    ev, ms = [], 0
    for i in range(400):
        ms += rng.choice([20, 60, 200, 400])
        ev.append((0 if rng.random() < 0.6 else rng.randint(1, 3), i, ms, float(rng.randint(0, 2)), 1.0, rng.choice([None, "a", "b"])))
    df = spark.createDataFrame(ev, "s int, e int, ms bigint, x double, y double, obj string")
    for chunk in (4, 256):
        assert rows(H.debounce(df, "s", "e", chunk=chunk).select("s", "e", "accepted")) == brute_debounce(ev)


def brute_replay(log, depth):
    out, stacks = [], {}
    for r, o, op in sorted(log):
        st = stacks.setdefault(r, [])
        if op == "UNDO":
            out.append((r, o, st.pop() if st else -1))
        else:
            st.append(o)
            del st[:-depth]
            out.append((r, o, -1))
    return sorted(out), {r: st for r, st in stacks.items()}


@pytest.mark.parametrize("chunk", [3, 8, 256])
def test_undo_in_chunks(spark, chunk):
    rng = random.Random(chunk)
    log = [(0 if rng.random() < 0.7 else rng.randint(1, 3), i, rng.choice(["ADD_SEGMENTS", "UNDO", "ADD_LIFT", "UNDO", "FINISH_SLOPE"] if (i // 60) % 2 else ["ADD_LIFT", "ADD_SEGMENTS", "UNDO"])) for i in range(500)]
    df = spark.createDataFrame(log, "resort_id int, op_seq bigint, op string")
    ev, st = H.replay_edits(df, depth=6, chunk=chunk)
    want, stacks = brute_replay(log, 6)
    assert rows(ev.select("resort_id", "op_seq", F.coalesce("undoes", F.lit(-1)))) == want
    assert {r.resort_id: r.stack for r in st.collect()} == stacks


def test_undo_cap(spark):
    """55 actions then 55 undos: 50 succeed, 5 find nothing."""
    log = [(1, i, "ADD_SEGMENTS") for i in range(55)] + [(1, 55 + i, "UNDO") for i in range(55)]
    ev, _ = H.replay_edits(spark.createDataFrame(log, "resort_id int, op_seq bigint, op string"), chunk=16)
    assert ev.where("undoes is not null").count() == 50


def hav(a, b):
    import math

    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * C.EARTH_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_snapping_is_sequential(spark):
    """A dense cloud with many copies of one spot and some existing nodes."""
    rng = random.Random(3)
    pts = []
    for i in range(220):
        spot = (10.0, 46.0) if rng.random() < 0.35 else (10.0 + rng.random() * 0.002, 46.0 + rng.random() * 0.0015)
        pts.append((1, i, *spot, 5.0))
    old = [(1, "N1", 1, 10.0005, 46.0005, 1.0), (1, "N2", 2, 10.0012, 46.0010, 1.0)]
    nodes, want = [(o[1], (o[3], o[4])) for o in old], []
    for r, i, x, y, _ in pts:
        near = sorted((hav((x, y), p), k) for k, (_, p) in enumerate(nodes) if hav((x, y), p) < 30.0)
        if not near:
            nodes.append((f"N{len(nodes) + 1}", (x, y)))
        want.append((r, i, nodes[near[0][1]][0] if near else nodes[-1][0], not near))
    df = spark.createDataFrame(pts, "resort_id int, o bigint, lon double, lat double, elevation double")
    ex = spark.createDataFrame(old, "resort_id int, node_id string, node_ord bigint, lon double, lat double, elevation double")
    used = spark.createDataFrame([(1, 2)], "resort_id int, used bigint")
    got = snap_sequence(df, "resort_id", "o", ex, used)
    assert rows(got) == sorted(want)


def test_nearest_node_strict_and_ties(spark):
    n = spark.createDataFrame([("N1", 1, 10.0, 46.0), ("N2", 2, 10.0, 46.0), ("N3", 3, 10.01, 46.0)], "node_id string, node_ord bigint, lon double, lat double")
    p = spark.createDataFrame([(1, 10.0001, 46.0), (2, 10.005, 46.0)], "t int, lon double, lat double")
    assert {r.t: r.node_id for r in nearest_node(p, n, "t").collect()} == {1: "N1", 2: None}
