"""Resort-graph joins, statistics, feature tables and removals."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions import geo, paths, terrain
from terrapath.operators import graph as G
from terrapath.operators import profile as P
from terrapath.operators import snapping as K
from terrapath.operators.scan import running_total
from terrapath.plans import sqlkit as S
from terrapath.plans.registry import query, r4, r7
from terrapath.plans.scalar import WARN_N, WIDTH
from terrapath.sources import fixtures as X

c = F.col


def facts(spark, sf):
    return G.segment_facts(X.segments(spark, sf))


# ---------------------------------------------------------------- node joins


def _nearest_sql(threshold: int) -> str:
    return (
        S.with_("tap", "station")
        + f"SELECT t.tap_id, n.node_id, round(n.d,4) AS distance_m FROM tap t LEFT JOIN (SELECT tap_id, arg_min(node_id,(round(d,6)*1e9+node_ord)) AS node_id, min(d) AS d FROM (SELECT t.tap_id, s.node_id, s.node_ord, {S.hav('s.lat','s.lon','t.lat','t.lon')} AS d FROM tap t, station s) WHERE d<{threshold} GROUP BY 1) n ON n.tap_id=t.tap_id"
    )


def _nearest(spark, sf, threshold):
    return K.nearest_node(X.taps(spark, sf), X.stations(spark, sf), "tap_id", threshold).select(
        "tap_id", "node_id", r4("distance_m").alias("distance_m")
    )


@query("join2_nearest_node_30m", _nearest_sql(30))
def join2(spark, sf):
    return _nearest(spark, sf, 30.0)


@query("join3_nearest_node_80m", _nearest_sql(80))
def join3(spark, sf):
    return _nearest(spark, sf, 80.0)


@query(
    "gen15_connector_tagging",
    _nearest_sql(80).replace(
        "SELECT t.tap_id, n.node_id, round(n.d,4) AS distance_m",
        "SELECT t.tap_id, n.node_id AS target_node_id, n.node_id IS NOT NULL AS is_connector, CASE WHEN n.node_id IS NOT NULL THEN '🔗 ' ELSE '' END||'🎯 Path '||t.tap_id AS sector_name",
    ),
)
def gen15(spark, sf):
    from terrapath.operators.route import tag_connectors

    p = X.taps(spark, sf).withColumn("sector_name", F.concat(F.lit("🎯 Path "), "tap_id"))
    return tag_connectors(p, X.stations(spark, sf), "tap_id").select("tap_id", "target_node_id", "is_connector", "sector_name")


@query(
    "join5_segment_slope",
    S.with_("seg", "slope_seg")
    + "SELECT s.segment_id, min(ss.slope_id) AS slope_id FROM seg s LEFT JOIN slope_seg ss ON ss.segment_id=s.segment_id GROUP BY 1",
)
def join5(spark, sf):
    return G.segment_parent(X.segments(spark, sf), X.slopes(spark, sf)).select("segment_id", "slope_id")


@query(
    "join6_slope_members",
    S.with_("seg", "slope_seg")
    + "SELECT slope_id, pos, s.segment_id, round(length_m,4) AS length_m FROM slope_seg ss JOIN seg s ON s.segment_id=ss.segment_id",
)
def join6(spark, sf):
    return (
        G.slope_members(X.slopes(spark, sf))
        .join(facts(spark, sf).select("resort_id", "segment_id", "length_m"), ["resort_id", "segment_id"])
        .select("slope_id", "pos", "segment_id", r4("length_m").alias("length_m"))
    )


_LEN = S.hav("start_lat", "start_lon", "end_lat", "end_lon")


@query(
    "join7_end_nodes",
    S.with_("lift", "lnode")
    + f"""SELECT l.lift_id, round(coalesce(b.elevation-a.elevation,0.0),4) AS rise_m, round({S.hav('a.lat','a.lon','b.lat','b.lon')},4) AS length_m FROM lift l
    LEFT JOIN lnode a ON a.node_id=l.start_node_id AND a.node_ord%100<>7 LEFT JOIN lnode b ON b.node_id=l.end_node_id AND b.node_ord%100<>7""",
)
def join7(spark, sf):
    """Rise is 0 and length NULL where a station node is missing (every 100th node is dropped here)."""
    nodes = X.lift_nodes(spark, sf).where(c("node_ord") % 100 != 7)
    ends = X.table(spark, sf, "customer").select(
        X.resort_of(c("c_custkey")).alias("resort_id"),
        F.concat(F.lit("L"), c("c_custkey") + 1).alias("lift_id"),
        F.concat(F.lit("N"), X.LIFT_NODE_BASE + 2 * c("c_custkey")).alias("start_node_id"),
        F.concat(F.lit("N"), X.LIFT_NODE_BASE + 2 * c("c_custkey") + 1).alias("end_node_id"),
    )
    j = G.with_end_nodes(ends, nodes, "left")
    return j.select("lift_id", r4(G.lift_rise(j)).alias("rise_m"), r4(G.lift_length()).alias("length_m"))


_EDGE = "edge AS (SELECT resort_id, segment_id AS edge_id, start_node_id, end_node_id FROM seg UNION ALL SELECT resort_id, lift_id, start_node_id, end_node_id FROM lift)"
_ENDS = "ends AS (SELECT DISTINCT edge_id, node_id FROM (SELECT edge_id, start_node_id AS node_id FROM edge UNION ALL SELECT edge_id, end_node_id FROM edge))"


def graph(spark, sf):
    return X.segments(spark, sf), X.slopes(spark, sf), X.lift_ends(spark, sf), X.nodes(spark, sf)


@query(
    "join8_node_degree",
    S.with_("seg", "lift", "node").rstrip() + f",\n{_EDGE},\n{_ENDS}\nSELECT n.node_id, count(e.edge_id) AS degree FROM node n LEFT JOIN ends e ON e.node_id=n.node_id GROUP BY 1",
)
def join8(spark, sf):
    seg, _, lifts, nodes = graph(spark, sf)
    return G.degrees(nodes, G.edges(seg, lifts)).select("node_id", "degree")


@query(
    "join9_isolated_nodes",
    S.with_("node", "slope_seg", "seg") + "SELECT node_id FROM node WHERE node_id NOT IN (SELECT start_node_id FROM seg JOIN slope_seg USING (segment_id) UNION ALL SELECT end_node_id FROM seg JOIN slope_seg USING (segment_id))",
)
def join9(spark, sf):
    """Nodes left alone when only finished segments are kept and all lifts are gone."""
    seg, slopes, lifts, nodes = graph(spark, sf)
    finished = seg.join(G.slope_members(slopes), ["resort_id", "segment_id"], "left_semi")
    return G.connected_nodes(nodes, G.edges(finished, lifts.where(F.lit(False))), keep=False).select("node_id")


@query(
    "val11_integrity",
    S.with_("slope_seg", "seg", "lift", "pnode")
    + """SELECT 'slope_segment' AS kind, slope_id AS owner, segment_id AS missing FROM slope_seg WHERE segment_id NOT IN (SELECT segment_id FROM seg)
    UNION ALL SELECT 'segment_node', segment_id, end_node_id FROM seg WHERE end_node_id NOT IN (SELECT node_id FROM pnode)
    UNION ALL SELECT 'segment_node', segment_id, start_node_id FROM seg WHERE start_node_id NOT IN (SELECT node_id FROM pnode)""",
)
def val11(spark, sf):
    """Dangling references as a report."""
    seg = X.segments(spark, sf)
    nodes = X.path_nodes(spark, sf).select("resort_id", "node_id")
    lost = G.slope_members(X.slopes(spark, sf)).join(seg, ["resort_id", "segment_id"], "left_anti")
    a = lost.select(F.lit("slope_segment").alias("kind"), c("slope_id").alias("owner"), c("segment_id").alias("missing"))
    ends = seg.select("resort_id", "segment_id", F.explode(F.array("start_node_id", "end_node_id")).alias("node_id"))
    b = ends.join(nodes, ["resort_id", "node_id"], "left_anti").select(
        F.lit("segment_node").alias("kind"), c("segment_id").alias("owner"), c("node_id").alias("missing")
    )
    return a.unionByName(b)


# ---------------------------------------------------------------- slope and resort statistics

SLOPE_STATS = {
    "sst": f"SELECT *, {S.cls('steepest')} AS difficulty FROM (SELECT ss.slope_id, max(ss.resort_id) AS resort_id, sum(length_m) AS length_m, sum(drop_m) AS drop_m, greatest(max(max_slope_pct),0.0) AS steepest, bool_or({WARN_N}>0) AS has_warnings, arg_min(start_elev,pos) AS top, arg_max(end_elev,pos) AS bottom FROM slope_seg ss JOIN seg s ON s.segment_id=ss.segment_id GROUP BY 1)"
}
_SST = S.with_("seg", "slope_seg", **SLOPE_STATS)


def resorts(spark, sf):
    """Every resort that has a segment, a slope or a lift."""
    lifts = X.table(spark, sf, "customer").select(X.resort_of(c("c_custkey")).alias("resort_id"))
    return X.segments(spark, sf).select("resort_id").union(X.slopes(spark, sf).select("resort_id")).union(lifts).distinct()


def stats(spark, sf):
    return G.slope_stats(X.slopes(spark, sf), facts(spark, sf))


@query("agg1_slope_totals", _SST + "SELECT slope_id, round(length_m,4) AS length_m, round(drop_m,4) AS drop_m FROM sst")
def agg1(spark, sf):
    return stats(spark, sf).select("slope_id", r4("length_m").alias("length_m"), r4("drop_m").alias("drop_m"))


@query("agg2_steepest_section", _SST + "SELECT slope_id, round(steepest,4) AS steepest_pct FROM sst")
def agg2(spark, sf):
    return stats(spark, sf).select("slope_id", r4("steepest_pct").alias("steepest_pct"))


@query("agg3_slope_difficulty", _SST + "SELECT slope_id, difficulty FROM sst")
def agg3(spark, sf):
    return stats(spark, sf).select("slope_id", "difficulty")


@query("agg4_slope_warnings", _SST + "SELECT slope_id, has_warnings FROM sst")
def agg4(spark, sf):
    return stats(spark, sf).select("slope_id", "has_warnings")


_AGG5 = (
    S.with_("seg", "slope_seg", "slope")
    + f"""SELECT slope_id, round(start_elev,4) AS start_elev, round(current_elev,4) AS current_elev, round(start_elev-current_elev,4) AS total_drop, round(len,4) AS total_length,
   round(CASE WHEN len>0 THEN (start_elev-current_elev)/len*100 ELSE 0.0 END,4) AS avg_gradient, round(mx,4) AS max_gradient, {S.cls('mx')} AS difficulty FROM (
   SELECT l.slope_id, CASE WHEN ok THEN a ELSE 0.0 END AS start_elev, CASE WHEN ok THEN b ELSE 0.0 END AS current_elev, CASE WHEN ok THEN len ELSE 0.0 END AS len, CASE WHEN ok THEN mx ELSE 0.0 END AS mx FROM (
   SELECT p.slope_id, f.start_elev AS a, e.end_elev AS b, f.n IS NOT NULL AND e.n IS NOT NULL AS ok FROM slope p LEFT JOIN seg f ON f.segment_id=p.segment_ids[1] LEFT JOIN seg e ON e.segment_id=p.segment_ids[-1]) l
   LEFT JOIN (SELECT slope_id, sum(length_m) AS len, max(max_slope_pct) AS mx FROM slope_seg ss JOIN seg s ON s.segment_id=ss.segment_id GROUP BY 1) t ON t.slope_id=l.slope_id)"""
)


@query("agg5_running_segment_stats", _AGG5)
def agg5(spark, sf):
    g = G.group_stats(X.slopes(spark, sf), facts(spark, sf), "slope_id", "segment_ids")
    nums = ("start_elev", "current_elev", "total_drop", "total_length", "avg_gradient", "max_gradient")
    return g.select("slope_id", *[r4(n).alias(n) for n in nums], "difficulty")


_RES = S.with_(
    "seg", "slope_seg", "slope", "lift", **SLOPE_STATS,
    ra="SELECT resort_id, count(*) AS n, sum(drop_m) AS v, sum(length_m) AS l, max(length_m) AS m FROM seg GROUP BY 1",
    rb="SELECT resort_id, max(length_m) AS m FROM sst GROUP BY 1",
    rc="SELECT resort_id, count(*) AS n FROM slope GROUP BY 1",
    rd="SELECT resort_id, count(*) AS n FROM lift GROUP BY 1",
    ids="SELECT resort_id FROM seg UNION SELECT resort_id FROM slope UNION SELECT resort_id FROM lift",
)


@query(
    "agg6_resort_stats",
    _RES
    + """SELECT i.resort_id, CASE WHEN ra.n>0 THEN coalesce(rc.n,0) ELSE 0 END AS total_slopes, coalesce(ra.n,0) AS total_segments, round(coalesce(ra.v,0.0),4) AS total_vertical_m,
    round(coalesce(ra.l,0.0),4) AS total_length_m, round(coalesce(greatest(ra.m,rb.m),0.0),4) AS longest_run_m, coalesce(rd.n,0) AS total_lifts
    FROM ids i LEFT JOIN ra ON ra.resort_id=i.resort_id LEFT JOIN rb ON rb.resort_id=i.resort_id LEFT JOIN rc ON rc.resort_id=i.resort_id LEFT JOIN rd ON rd.resort_id=i.resort_id""",
)
def agg6(spark, sf):
    f, slopes = facts(spark, sf), X.slopes(spark, sf)
    r = G.resort_stats(slopes, f, X.lift_ends(spark, sf), G.slope_stats(slopes, f))
    return r.select(
        "resort_id", "total_slopes", "total_segments", "total_lifts",
        *[r4(n).alias(n) for n in ("total_vertical_m", "total_length_m", "longest_run_m")],
    )


_EVERY = S.with_("seg", "slope_seg", "slope", "lift", **SLOPE_STATS, ids="SELECT resort_id FROM seg UNION SELECT resort_id FROM slope UNION SELECT resort_id FROM lift")


@query(
    "agg7_length_by_difficulty",
    _EVERY + "SELECT i.resort_id, " + ",".join(f"round(sum(CASE WHEN difficulty='{d}' THEN length_m ELSE 0.0 END)/1000,4) AS {d}_km" for d in C.DIFFICULTIES) + " FROM ids i LEFT JOIN sst ON sst.resort_id=i.resort_id GROUP BY 1",
)
def agg7(spark, sf):
    return (
        resorts(spark, sf)
        .join(stats(spark, sf), "resort_id", "left")
        .groupBy("resort_id")
        .agg(*[r4(F.sum(F.when(c("difficulty") == d, c("length_m")).otherwise(0.0)) / 1000).alias(f"{d}_km") for d in C.DIFFICULTIES])
    )


@query("agg8_slope_sums", _EVERY + "SELECT i.resort_id, round(coalesce(sum(drop_m),0.0),4) AS vertical_m, round(coalesce(sum(length_m),0.0),4) AS length_m FROM ids i LEFT JOIN sst ON sst.resort_id=i.resort_id GROUP BY 1")
def agg8(spark, sf):
    total = lambda n: r4(F.coalesce(F.sum(n), F.lit(0.0)))
    every = resorts(spark, sf).join(stats(spark, sf), "resort_id", "left")
    return every.groupBy("resort_id").agg(total("drop_m").alias("vertical_m"), total("length_m").alias("length_m"))


@query(
    "agg9_lift_totals",
    S.with_("lift")
    + f"SELECT resort_id, round(sum(end_elevation-start_elevation),4) AS rise_m, round(sum({_LEN}),4) AS length_m, "
    + ",".join(f"sum(CASE WHEN lift_type='{t}' THEN 1 ELSE 0 END) AS {t}" for t in C.LIFT_TYPES)
    + " FROM lift GROUP BY 1",
)
def agg9(spark, sf):
    l = X.lift_ends(spark, sf)
    d = geo.haversine_m(c("start_lat"), c("start_lon"), c("end_lat"), c("end_lon"))
    return l.groupBy("resort_id").agg(
        r4(F.sum(c("end_elevation") - c("start_elevation"))).alias("rise_m"),
        r4(F.sum(d)).alias("length_m"),
        *[F.count_if(c("lift_type") == t).alias(t) for t in C.LIFT_TYPES],
    )


@query(
    "agg10_slope_panel",
    _SST
    + "SELECT s.slope_id, round(coalesce(f.start_elev,0.0),4) AS top_elev, round(coalesce(e.end_elev,0.0),4) AS bottom_elev, round(t.length_m,4) AS length_m, round(t.drop_m,4) AS drop_m, round(CASE WHEN t.length_m>0 THEN t.drop_m/t.length_m*100 ELSE 0.0 END,4) AS avg_gradient, round(steepest,4) AS steepest_pct, t.difficulty FROM slope s JOIN sst t ON t.slope_id=s.slope_id LEFT JOIN seg f ON f.segment_id=s.segment_ids[1] LEFT JOIN seg e ON e.segment_id=s.segment_ids[-1]",
)
def agg10(spark, sf):
    f, slopes = facts(spark, sf), X.slopes(spark, sf)
    g = G.slope_stats(slopes, f)
    both = ["resort_id", "slope_id"]
    edge = lambda at, pt, out: slopes.select(*both, F.element_at("segment_ids", at).alias("segment_id")).join(
        f.select("resort_id", "segment_id", c(f"{pt}.elevation").alias(out)), ["resort_id", "segment_id"]
    ).drop("segment_id")
    j = g.join(edge(1, "first_pt", "top_elev"), both, "left").join(edge(-1, "last_pt", "bottom_elev"), both, "left")
    return j.select(
        "slope_id",
        r4(F.coalesce("top_elev", F.lit(0.0))).alias("top_elev"),
        r4(F.coalesce("bottom_elev", F.lit(0.0))).alias("bottom_elev"),
        r4("length_m").alias("length_m"),
        r4("drop_m").alias("drop_m"),
        r4(paths.avg_slope_pct(c("drop_m"), c("length_m"))).alias("avg_gradient"),
        r4("steepest_pct").alias("steepest_pct"),
        "difficulty",
    )


@query(
    "agg11_segment_details",
    S.with_("seg", "slope_seg")
    + f"SELECT slope_id, pos+1 AS line, difficulty, round(length_m,4) AS length_m, round(max_slope_pct,4) AS steepest_pct, round({WIDTH},4) AS width_m, {WARN_N} AS n_warnings FROM slope_seg ss JOIN seg s ON s.segment_id=ss.segment_id",
)
def agg11(spark, sf):
    return (
        G.slope_members(X.slopes(spark, sf))
        .join(facts(spark, sf), ["resort_id", "segment_id"])
        .select(
            "slope_id",
            (c("pos") + 1).alias("line"),
            "difficulty",
            r4("length_m").alias("length_m"),
            r4("max_slope_pct").alias("steepest_pct"),
            r4("width_m").alias("width_m"),
            F.size("warnings").alias("n_warnings"),
        )
    )


@query(
    "agg13_node_centre",
    S.with_("node") + "SELECT resort_id, round(avg(lon),6) AS lon, round(avg(lat),6) AS lat, count(*) AS n FROM node GROUP BY 1",
)
def agg13(spark, sf):
    return X.nodes(spark, sf).groupBy("resort_id").agg(
        F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"), F.count(F.lit(1)).alias("n")
    )


@query(
    "agg14_slope_centre",
    S.with_("seg", "slope", "slope_seg")
    + "SELECT s.slope_id, round((f.start_lon+e.end_lon)/2,7) AS mid_lon, round((f.start_lat+e.end_lat)/2,7) AS mid_lat, round(m.lon,6) AS mean_lon, round(m.lat,6) AS mean_lat FROM slope s LEFT JOIN seg f ON f.segment_id=s.segment_ids[1] LEFT JOIN seg e ON e.segment_id=s.segment_ids[-1] LEFT JOIN (SELECT slope_id, avg((start_lon+end_lon)/2) AS lon, avg((start_lat+end_lat)/2) AS lat FROM slope_seg ss JOIN seg g ON g.segment_id=ss.segment_id GROUP BY 1) m ON m.slope_id=s.slope_id",
)
def agg14(spark, sf):
    listed = X.slopes(spark, sf).select("resort_id", "slope_id", F.posexplode("segment_ids").alias("pos", "segment_id"), (F.size("segment_ids") - 1).alias("last"))
    j = listed.join(facts(spark, sf).select("resort_id", "segment_id", "first_pt", "last_pt"), ["resort_id", "segment_id"], "left")
    first, last = (F.max(F.when(c("pos") == p, c(pt))) for p, pt in ((F.lit(0), "first_pt"), (c("last"), "last_pt")))
    g = j.groupBy("resort_id", "slope_id").agg(
        first.alias("a"),
        last.alias("b"),
        *[F.avg((c(f"first_pt.{k}") + c(f"last_pt.{k}")) / 2).alias(f"m_{k}") for k in ("lon", "lat")],
    )
    return g.select(
        "slope_id",
        r7((c("a.lon") + c("b.lon")) / 2).alias("mid_lon"),
        r7((c("a.lat") + c("b.lat")) / 2).alias("mid_lat"),
        F.round("m_lon", 6).alias("mean_lon"),
        F.round("m_lat", 6).alias("mean_lat"),
    )


@query(
    "agg15_lift_centre",
    S.with_("lift") + "SELECT lift_id, round((start_lon+end_lon)/2,7) AS lon, round((start_lat+end_lat)/2,7) AS lat FROM lift",
)
def agg15(spark, sf):
    return X.lift_ends(spark, sf).select(
        "lift_id", r7((c("start_lon") + c("end_lon")) / 2).alias("lon"), r7((c("start_lat") + c("end_lat")) / 2).alias("lat")
    )


_JOINED = """jp AS (SELECT slope_id, row_number() OVER (PARTITION BY slope_id ORDER BY pos, seq)-1 AS i, lon, lat, elevation, pos FROM (
  SELECT ss.slope_id, ss.pos, p.*, min(ss.pos) OVER (PARTITION BY ss.slope_id) AS p0, min(p.seq) OVER (PARTITION BY ss.slope_id, ss.pos) AS s0
  FROM slope_seg ss JOIN seg_pts p ON 'S'||p.n=ss.segment_id) WHERE pos=p0 OR seq>s0)"""


def slope_points(spark, sf):
    return G.joined_points(G.slope_members(X.slopes(spark, sf)), X.segments(spark, sf), "slope_id")


@query(
    "agg18_slope_geometry",
    S.with_("slope_seg", "seg_pts").rstrip() + f",\n{_JOINED}\nSELECT slope_id, i, round(lon,7) AS lon, round(lat,7) AS lat, round(elevation,4) AS elevation FROM jp",
)
def agg18(spark, sf):
    return slope_points(spark, sf).select(
        "slope_id", "i", r7("lon").alias("lon"), r7("lat").alias("lat"), r4("elevation").alias("elevation")
    )


@query(
    "snk10_slope_profile",
    S.with_("slope_seg", "seg_pts").rstrip()
    + f""",\n{_JOINED}\nSELECT slope_id, i, round(sum(coalesce(d,0.0)) OVER (PARTITION BY slope_id ORDER BY i),4) AS x_m, round(elevation,4) AS y_m FROM (
    SELECT *, {S.hav('pla','plo','lat','lon')} AS d FROM (SELECT *, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo FROM jp WINDOW w AS (PARTITION BY slope_id ORDER BY i)))""",
)
def snk10_slope(spark, sf):
    return P.with_distance(slope_points(spark, sf), ["resort_id", "slope_id"], "i").select(
        "slope_id", "i", r4("cum_m").alias("x_m"), r4("elevation").alias("y_m")
    )


@query(
    "snk13_segment_boundaries",
    S.with_("seg", "slope_seg")
    + f"SELECT slope_id, pos, round(sum(length_m) OVER (PARTITION BY slope_id ORDER BY pos),4) AS x_m, {S.case_map(C.SLOPE_COLORS,'difficulty')} AS color FROM slope_seg ss JOIN seg s ON s.segment_id=ss.segment_id",
)
def snk13(spark, sf):
    parts = G.slope_members(X.slopes(spark, sf)).join(facts(spark, sf).select("resort_id", "segment_id", "length_m", "difficulty"), ["resort_id", "segment_id"])
    return running_total(parts, ["resort_id", "slope_id"], "pos", {"x_m": c("length_m")}).select(
        "slope_id", "pos", r4("x_m").alias("x_m"), terrain.slope_color(c("difficulty")).alias("color")
    )


_OPEN = "SELECT * FROM seg WHERE segment_id NOT IN (SELECT segment_id FROM slope_seg)"


@query(
    "snk15_building_profile",
    S.with_("seg", "slope_seg", "seg_pts", open=_OPEN, mx=f"SELECT path_id, greatest(max(avg_slope_pct),0.0) AS m FROM open GROUP BY 1",
    bp="SELECT p.path_id, row_number() OVER (PARTITION BY p.path_id ORDER BY p.seg_no, p.seq)-1 AS i, p.lon, p.lat, p.elevation FROM seg_pts p JOIN open o ON o.n=p.n")
    + f"SELECT b.path_id, i, round(sum(coalesce(d,0.0)) OVER (PARTITION BY b.path_id ORDER BY i),4) AS x_m, round(elevation,4) AS y_m, {S.case_map(C.SLOPE_COLORS, S.cls('m'))} AS color FROM (SELECT *, {S.hav('pla','plo','lat','lon')} AS d FROM (SELECT *, lag(lat) OVER w AS pla, lag(lon) OVER w AS plo FROM bp WINDOW w AS (PARTITION BY path_id ORDER BY i))) b JOIN mx ON mx.path_id=b.path_id",
)
def snk15(spark, sf):
    """Unfinished runs: segments joined without junction removal, colour from the largest average."""
    seg = X.segments(spark, sf).join(G.slope_members(X.slopes(spark, sf)), ["resort_id", "segment_id"], "left_anti")
    line = G.joined_points(seg.select("resort_id", "path_id", c("seg_no").alias("pos"), "segment_id"), seg, "path_id", skip_junctions=False)
    avg = paths.avg_slope_pct(paths.drop_m(c("points")), paths.length_m(c("points")))
    color = seg.groupBy("resort_id", "path_id").agg(F.greatest(F.max(avg), F.lit(0.0)).alias("m"))
    return (
        P.with_distance(line, ["resort_id", "path_id"], "i")
        .join(color, ["resort_id", "path_id"])
        .select("path_id", "i", r4("cum_m").alias("x_m"), r4("elevation").alias("y_m"), terrain.slope_color(terrain.classify(c("m"))).alias("color"))
    )


@query(
    "agg20_building_max_avg",
    S.with_("seg", "slope_seg", open=_OPEN) + f"SELECT path_id, round(greatest(max(avg_slope_pct),0.0),4) AS max_avg_pct, {S.cls('greatest(max(avg_slope_pct),0.0)')} AS difficulty FROM open GROUP BY 1",
)
def agg20(spark, sf):
    seg = facts(spark, sf).join(G.slope_members(X.slopes(spark, sf)), ["resort_id", "segment_id"], "left_anti")
    g = seg.groupBy("resort_id", "path_id").agg(F.greatest(F.max("avg_slope_pct"), F.lit(0.0)).alias("m"))
    return g.select("path_id", r4("m").alias("max_avg_pct"), terrain.classify(c("m")).alias("difficulty"))


# ---------------------------------------------------------------- feature tables and sinks


@query(
    "snk2_save_gating",
    S.with_("seg", "slope", "lift") + "SELECT resort_id, resort_id IN (SELECT resort_id FROM slope UNION SELECT resort_id FROM lift WHERE lift_no%8=1) AS can_save FROM (SELECT resort_id FROM seg UNION SELECT resort_id FROM slope UNION SELECT resort_id FROM lift)",
)
def snk2(spark, sf):
    """A resort can be exported when it has a slope or a lift; seven of eight lifts count as removed here."""
    some = X.slopes(spark, sf).select("resort_id").union(
        X.table(spark, sf, "customer").where(c("c_custkey") % 8 == 1).select(X.resort_of(c("c_custkey")).alias("resort_id"))
    )
    return resorts(spark, sf).join(some.distinct().withColumn("can_save", F.lit(True)), "resort_id", "left").select(
        "resort_id", F.coalesce("can_save", F.lit(False)).alias("can_save")
    )


_RGB = {d: "[" + ",".join(map(str, v[:3])) + "," for d, v in C.SLOPE_RGBA.items()}


@query(
    "snk3_segment_features",
    S.with_("seg", "slope_seg", "seg_pts", **SLOPE_STATS,
    par="SELECT s.*, t.slope_id, coalesce(t.difficulty, s.difficulty) AS shown FROM seg s LEFT JOIN slope_seg ss ON ss.segment_id=s.segment_id LEFT JOIN sst t ON t.slope_id=ss.slope_id",
    mid="SELECT n, arg_min(lon, abs(k-(m//2))) AS lon, arg_min(lat, abs(k-(m//2))) AS lat FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY seq)-1 AS k, count(*) OVER (PARTITION BY n) AS m FROM seg_pts) GROUP BY n")
    + f"SELECT segment_id, slope_id, shown AS difficulty, {S.case_map(_RGB,'shown')}||CASE WHEN par.n%10=0 THEN '180]' ELSE '100]' END AS color, CASE WHEN slope_id IS NOT NULL THEN 'Slope '||slope_id ELSE 'Building: '||segment_id END AS icon_name, round(mid.lon,7) AS icon_lon, round(mid.lat,7) AS icon_lat FROM par JOIN mid ON mid.n=par.n",
)
def snk3(spark, sf):
    """Segment features: parent slope decides the class, highlighted ones (every tenth) are more opaque."""
    f, slopes = facts(spark, sf), X.slopes(spark, sf)
    owned = G.segment_parent(f, slopes).join(
        G.slope_stats(slopes, f).select("resort_id", "slope_id", c("difficulty").alias("_d")), ["resort_id", "slope_id"], "left"
    )
    shown = F.coalesce("_d", "difficulty")
    rgb = F.slice(terrain.lookup(C.SLOPE_RGBA, shown), 1, 3)
    alpha = F.when((c("path_id") * 8 + c("seg_no") + 1) % 10 == 0, 180).otherwise(100)
    mid = F.element_at("points", F.floor(F.size("points") / 2).cast("int") + 1)
    return owned.select(
        "segment_id",
        "slope_id",
        shown.alias("difficulty"),
        F.concat(F.lit("["), F.array_join(F.concat(rgb, F.array(alpha)), ","), F.lit("]")).alias("color"),
        F.when(c("slope_id").isNotNull(), F.concat(F.lit("Slope "), "slope_id")).otherwise(F.concat(F.lit("Building: "), "segment_id")).alias("icon_name"),
        r7(mid["lon"]).alias("icon_lon"),
        r7(mid["lat"]).alias("icon_lat"),
    )


@query(
    "snk5_node_features",
    S.with_("node") + "SELECT 'node' AS type, node_id AS id, round(lon,7) AS lon, round(lat,7) AS lat, round(elevation+20,4) AS z, 'Node '||node_id AS name FROM node",
)
def snk5(spark, sf):
    return X.nodes(spark, sf).select(
        F.lit("node").alias("type"),
        c("node_id").alias("id"),
        r7("lon").alias("lon"),
        r7("lat").alias("lat"),
        r4(c("elevation") + 20).alias("z"),
        F.concat(F.lit("Node "), "node_id").alias("name"),
    )


# ---------------------------------------------------------------- removals and sets


@query(
    "grf4_delete_slope",
    S.with_("seg", "slope", "slope_seg", "lift", "node",
    gone="SELECT slope_id FROM slope WHERE path_id%5=1",
    sg="SELECT * FROM seg WHERE segment_id NOT IN (SELECT segment_id FROM slope_seg WHERE slope_id IN (SELECT slope_id FROM gone))")
    + """SELECT 'slopes' AS part, count(*) AS n FROM slope WHERE slope_id NOT IN (SELECT slope_id FROM gone) UNION ALL SELECT 'segments', count(*) FROM sg
    UNION ALL SELECT 'nodes', count(*) FROM node WHERE node_id IN (SELECT start_node_id FROM sg UNION SELECT end_node_id FROM sg UNION SELECT start_node_id FROM lift UNION SELECT end_node_id FROM lift)""",
)
def grf4(spark, sf):
    seg, slopes, lifts, nodes = graph(spark, sf)
    gone = slopes.where(c("path_id") % 5 == 1).select("resort_id", "slope_id")
    return _counts(dict(zip(("slopes", "segments", "nodes"), G.delete_slopes(slopes, seg, lifts, nodes, gone))))


def _counts(tables):
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "grf5_delete_lift",
    S.with_("seg", "lift", "node", keep="SELECT * FROM lift WHERE lift_no%3<>1")
    + """SELECT 'lifts' AS part, count(*) AS n FROM keep UNION ALL SELECT 'nodes', count(*) FROM node WHERE node_id IN (SELECT start_node_id FROM seg UNION SELECT end_node_id FROM seg UNION SELECT start_node_id FROM keep UNION SELECT end_node_id FROM keep)""",
)
def grf5(spark, sf):
    seg, _, lifts, nodes = graph(spark, sf)
    gone = lifts.where(c("lift_no") % 3 == 1).select("resort_id", "lift_id")
    return _counts(dict(zip(("lifts", "nodes"), G.delete_lifts(seg, lifts, nodes, gone))))


@query(
    "grf6_cancel_slope",
    S.with_("seg", "slope_seg", "lift", "node", kept="SELECT * FROM seg WHERE segment_id IN (SELECT segment_id FROM slope_seg)")
    + """SELECT 'segments' AS part, count(*) AS n FROM kept UNION ALL SELECT 'log', count(*) FROM (SELECT n FROM seg WHERE segment_id IN (SELECT segment_id FROM slope_seg) OR seg_no%2=1)
    UNION ALL SELECT 'nodes', count(*) FROM node WHERE node_id IN (SELECT start_node_id FROM kept UNION SELECT end_node_id FROM kept UNION SELECT start_node_id FROM lift UNION SELECT end_node_id FROM lift)""",
)
def grf6(spark, sf):
    seg, slopes, lifts, nodes = graph(spark, sf)
    op = F.when(c("seg_no") % 2 == 0, "ADD_SEGMENTS").otherwise("FINISH_SLOPE")
    log = seg.select("resort_id", (c("path_id") * 8 + c("seg_no")).alias("op_seq"), op.alias("op"), F.array("segment_id").alias("segment_ids"))
    return _counts(dict(zip(("segments", "log", "nodes"), G.cancel_building(seg, slopes, log, lifts, nodes))))


@query(
    "srt5_latest_segment",
    S.with_("seg") + "SELECT resort_id, arg_max(segment_id, n) AS segment_id FROM seg GROUP BY 1",
)
def srt5(spark, sf):
    n = c("path_id") * 8 + c("seg_no")
    return X.segments(spark, sf).groupBy("resort_id").agg(F.max_by("segment_id", n).alias("segment_id"))


@query(
    "set4_remaining_segments",
    S.with_("slope") + "SELECT slope_id, array_to_string(list_filter(segment_ids, lambda s: cast(replace(s,'S','') as bigint)%3<>0),',') AS remaining FROM slope",
)
def set4(spark, sf):
    undone = F.filter("segment_ids", lambda s: F.substring(s, 2, 20).cast("long") % 3 == 0)
    return X.slopes(spark, sf).select(
        "slope_id", F.array_join(F.array_except("segment_ids", undone), ",").alias("remaining")
    )


@query(
    "set5_finished_segments",
    S.with_("seg", "slope_seg") + "SELECT resort_id, count(*) AS n_segments, sum(CASE WHEN segment_id IN (SELECT segment_id FROM slope_seg) THEN 1 ELSE 0 END) AS n_finished FROM seg GROUP BY 1",
)
def set5(spark, sf):
    done = G.slope_members(X.slopes(spark, sf)).select("resort_id", "segment_id").distinct().withColumn("done", F.lit(True))
    j = X.segments(spark, sf).select("resort_id", "segment_id").join(done, ["resort_id", "segment_id"], "left")
    return j.groupBy("resort_id").agg(F.count(F.lit(1)).alias("n_segments"), F.count("done").alias("n_finished"))


@query(
    "set6_longest_run",
    S.with_("seg", "slope_seg", **SLOPE_STATS) + "SELECT resort_id, round(max(length_m),4) AS longest_m FROM (SELECT resort_id, length_m FROM seg UNION ALL SELECT resort_id, length_m FROM sst) GROUP BY 1",
)
def set6(spark, sf):
    f = facts(spark, sf)
    s = G.slope_stats(X.slopes(spark, sf), f)
    return f.select("resort_id", "length_m").unionByName(s.select("resort_id", "length_m")).groupBy("resort_id").agg(r4(F.max("length_m")).alias("longest_m"))

