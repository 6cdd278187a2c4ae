"""Routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions import paths, rules
from terrapath.operators import route as R
from terrapath.plans import sqlkit as S
from terrapath.plans.fan_plans import FAN, fan
from terrapath.plans.registry import query, r4, r7
from terrapath.sources import fixtures as X

c = F.col


def world(spark, sf):
    return X.dem_cells(spark, sf), X.dem_meta(spark, sf)


_DIRECT = S.hav("t.lat", "t.lon", "t.target_lat", "t.target_lon")
GRID = {
    "rq": f"SELECT t.*, {_DIRECT} AS d, a.elevation AS za, b.elevation AS zb FROM tgt t LEFT JOIN dem a ON a.row={S.row_of('t.lat')} AND a.col={S.col_of('t.lon')} LEFT JOIN dem b ON b.row={S.row_of('t.target_lat')} AND b.col={S.col_of('t.target_lon')}",
    "rq1": f"SELECT *, {S.brg('(lon+target_lon)/2','(lat+target_lat)/2','target_lon','target_lat')} AS b, least(cast(trunc(d*2.0/15.0) as bigint)+1,100) AS n FROM rq WHERE za-zb>0 AND d>=30",
    "rq2": f"SELECT *, {S.dest_lon('(lon+target_lon)/2','(lat+target_lat)/2',S.pmod('b+180'),'d')} AS o1, {S.dest_lat('(lon+target_lon)/2','(lat+target_lat)/2',S.pmod('b+180'),'d')} AS o2 FROM rq1",
    "rq3": f"SELECT *, {S.dest_lon('o1','o2',S.pmod('b-90'),'d')} AS ox, {S.dest_lat('o1','o2',S.pmod('b-90'),'d')} AS oy FROM rq2",
    "gc": f"SELECT request_id, n, b, lon AS slon, lat AS slat, target_lon, target_lat, col, {S.dest_lon('ox','oy',S.pmod('b+90'),'(col*15.0)')} AS cx, {S.dest_lat('ox','oy',S.pmod('b+90'),'(col*15.0)')} AS cy FROM (SELECT *, unnest(range(0,n)) AS col FROM rq3)",
    "gn": f"SELECT *, {S.dest_lon('cx','cy','b','(row*15.0)')} AS lon, {S.dest_lat('cx','cy','b','(row*15.0)')} AS lat FROM (SELECT *, unnest(range(0,n)) AS row FROM gc)",
    "gz": f"SELECT g.request_id, g.n, g.row, g.col, g.lon, g.lat, g.slon, g.slat, g.target_lon, g.target_lat, m.elevation FROM gn g LEFT JOIN dem m ON m.row={S.row_of('g.lat')} AND m.col={S.col_of('g.lon')}",
}
_G = S.with_("tgt", "dem", **GRID)


def ready(spark, sf):
    r = R.with_elevations(X.targets(spark, sf), *world(spark, sf))
    return r.where(rules.plan_ready(c("elevation"), c("target_elevation"), c("direct_m")))


def grid(spark, sf):
    return R.grid_nodes(ready(spark, sf), *world(spark, sf))


@query(
    "gen6_search_grid",
    _G
    + "SELECT request_id, max(n) AS n_side, count(*) AS n_nodes, count(*) FILTER (WHERE elevation IS NULL)>0 AS rejected, round(avg(elevation),3) AS mean_z, round(avg(lon),7) AS mean_lon, round(avg(lat),7) AS mean_lat FROM gz GROUP BY 1",
)
def gen6(spark, sf):
    return (
        grid(spark, sf)
        .groupBy("request_id")
        .agg(
            F.max("n").alias("n_side"),
            F.count(F.lit(1)).alias("n_nodes"),
            F.bool_or(c("elevation").isNull()).alias("rejected"),
            F.round(F.avg("elevation"), 3).alias("mean_z"),
            r7(F.avg("lon")).alias("mean_lon"),
            r7(F.avg("lat")).alias("mean_lat"),
        )
    )


@query(
    "join4_nearest_grid_node",
    _G
    + f"SELECT request_id, (first(row ORDER BY ds,row,col)) AS start_row, (first(col ORDER BY ds,row,col)) AS start_col, (first(row ORDER BY dt,row,col)) AS target_row, (first(col ORDER BY dt,row,col)) AS target_col FROM (SELECT *, {S.hav('lat','lon','slat','slon')} AS ds, {S.hav('lat','lon','target_lat','target_lon')} AS dt FROM gz) GROUP BY 1",
)
def join4(spark, sf):
    g = R.nearest_grid_nodes(ready(spark, sf))
    return g.select(
        "request_id",
        c("start.row").alias("start_row"),
        c("start.col").alias("start_col"),
        c("target.row").alias("target_row"),
        c("target.col").alias("target_col"),
    )


_EDGES = {
    **GRID,
    "ge": f"SELECT a.request_id, a.row, a.col, {S.hav('a.lat','a.lon','b.lat','b.lon')} AS h, a.elevation-b.elevation AS dz FROM gz a, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) m(dr,dc), gz b WHERE b.request_id=a.request_id AND b.row=a.row+dr AND b.col=a.col+dc",
    "gs": "SELECT *, dz/h*100 AS s FROM ge",
}


@query(
    "join10_grid_neighbours",
    S.with_("tgt", "dem", **_EDGES)
    + "SELECT request_id, count(*) AS n_edges, round(avg(h),4) AS mean_m, round(avg(abs(s)),3) AS mean_abs_slope FROM gs GROUP BY 1",
)
def join10(spark, sf):
    e = R.edge_profile(ready(spark, sf), *world(spark, sf), 22.0)
    return e.select("request_id", "n_edges", r4("mean_m").alias("mean_m"), F.round("mean_abs_slope", 3).alias("mean_abs_slope"))


@query(
    "gen7_edge_cost",
    S.with_("tgt", "dem", **_EDGES)
    + "SELECT request_id, round(avg(ln(h*exp(abs(s-22.0)/8.0)*CASE WHEN s<0 THEN exp(abs(s)/8.0) ELSE 1.0 END)),4) AS mean_log_cost FROM gs WHERE h>=0.1 AND s IS NOT NULL GROUP BY 1",
)
def gen7(spark, sf):
    e = R.edge_profile(ready(spark, sf), *world(spark, sf), 22.0)
    return e.where(c("mean_log_cost").isNotNull()).select("request_id", r4("mean_log_cost").alias("mean_log_cost"))


@query("gen8_least_cost_path")
def gen8(spark, sf):
    """Cost and hops per request and grade; optimality is tested against brute force."""
    p = R.least_cost_paths(ready(spark, sf), *world(spark, sf)).where(c("reason").isNull())
    return p.select("request_id", "target_slope_pct", r4("cost").alias("cost"), F.size("rows").alias("n_nodes"))


@query("gen9_path_points")
def gen9(spark, sf):
    p = R.least_cost_paths(ready(spark, sf), *world(spark, sf)).where(c("reason").isNull())
    p = p.select("request_id", "target_slope_pct", F.posexplode(R.path_points()).alias("i", "p"))
    return p.select("request_id", "target_slope_pct", "i", "p.lon", "p.lat", "p.elevation")


@query("gen10_smooth_resample")
def gen10(spark, sf):
    p = R.plan(X.targets(spark, sf), *world(spark, sf))
    return p.select("request_id", "ord", F.size("points").alias("n_points"), r4(paths.length_m(c("points"))).alias("length_m"))


@query("gen11_plan")
def gen11(spark, sf):
    p = R.plan(X.targets(spark, sf), *world(spark, sf))
    return p.select("request_id", "ord", "sector_name", r4("avg_slope_pct").alias("avg_slope_pct"), r4("cost").alias("cost"))


@query(
    "gen11_refused",
    _G
    + """SELECT request_id, CASE WHEN za IS NULL OR zb IS NULL THEN 'no elevation at start or target' WHEN za<=zb THEN 'target is not below the start' WHEN d<30 THEN 'target is too close' ELSE 'elevation missing in the search grid' END AS reason
    FROM rq WHERE za IS NULL OR zb IS NULL OR za<=zb OR d<30 OR request_id IN (SELECT request_id FROM gz WHERE elevation IS NULL)""",
)
def gen11_refused(spark, sf):
    """Requests without a plan on grids of 100 x 100 nodes at most and why; ``gen11_plan`` searches the whole grids."""
    return R.plan_or_refuse(X.targets(spark, sf), *world(spark, sf), C.GRID_MAX_CELLS)[1].select("request_id", "reason")


@query("gen6_truncated_grids", _G + "SELECT request_id, cast(trunc(d*2.0/15.0) as bigint)+1>100 AS truncated FROM rq1")
def gen6_truncated(spark, sf):
    """Requests whose search square is larger than the 100 x 100 nodes that ``grid_nodes`` makes of it at most."""
    return ready(spark, sf).select("request_id", R.grid_truncated().alias("truncated"))


_SIM = """sim AS (SELECT a.request_id, a.ord AS a, b.ord AS b FROM fan a JOIN fan b ON a.request_id=b.request_id AND a.ord<b.ord WHERE (
   SELECT avg(pow(p.lon-q.lon,2)+pow(p.lat-q.lat,2)) FROM (VALUES (0.1::double),(0.2::double),(0.3::double),(0.4::double),(0.5::double),(0.6::double),(0.7::double),(0.8::double),(0.9::double)) t(pc)
   JOIN tr p ON p.id=a.tid AND p.step=trunc(pc*(a.n-1)) JOIN tr q ON q.id=b.tid AND q.step=trunc(pc*(b.n-1)))<1e-8)"""
_SIMQ = FAN.rstrip() + ",\n" + _SIM + "\n"


@query("join12_similar_pairs", _SIMQ + "SELECT request_id, a, b FROM sim")
def join12(spark, sf):
    return R.similar_pairs(fan(spark, sf))


@query("gen12_similarity", _SIMQ + "SELECT request_id, count(*) AS n_similar FROM sim GROUP BY 1")
def gen12(spark, sf):
    return R.similar_pairs(fan(spark, sf)).groupBy("request_id").agg(F.count(F.lit(1)).alias("n_similar"))


_DEDUP = (
    _SIMQ.rstrip()
    + """,
  rk AS (SELECT request_id, ord, row_number() OVER (PARTITION BY request_id ORDER BY round(avg_slope_pct,6), ord) AS r FROM fan),
  nb AS (SELECT k.request_id, k.ord, k.r, coalesce(list(s.o) FILTER (WHERE s.o IS NOT NULL), []::bigint[]) AS l FROM rk k LEFT JOIN (SELECT request_id, a AS x, b AS o FROM sim UNION ALL SELECT request_id, b, a FROM sim) s ON s.request_id=k.request_id AND s.x=k.ord GROUP BY ALL),
  gd AS (SELECT request_id, 1::bigint AS r, [ord]::bigint[] AS kept FROM nb WHERE r=1 UNION ALL SELECT g.request_id, n.r, CASE WHEN list_has_any(g.kept, n.l) THEN g.kept ELSE g.kept || [n.ord] END FROM gd g JOIN nb n ON n.request_id=g.request_id AND n.r=g.r+1)
"""
)


@query("gen13_greedy_dedup", _DEDUP + "SELECT request_id, unnest(kept) AS ord FROM (SELECT request_id, arg_max(kept, r) AS kept FROM gd GROUP BY 1)")
def gen13(spark, sf):
    return R.distinct_ords(fan(spark, sf).withColumn("ord", c("ord").cast("int")))


@query(
    "srt1_order_by_slope",
    FAN + "SELECT request_id, ord, row_number() OVER (PARTITION BY request_id ORDER BY round(avg_slope_pct,6), ord) AS place FROM fan",
)
def srt1(spark, sf):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("request_id").orderBy(F.round("avg_slope_pct", 6), "ord"))
    return fan(spark, sf).select("request_id", "ord", place.cast("long").alias("place"))


@query("gen14_manual_paths")
def gen14(spark, sf):
    p = R.manual_paths(X.targets(spark, sf), *world(spark, sf))
    return p.select("request_id", "ord", "sector_name", "target_difficulty", F.size("points").alias("n_points"), r4("avg_slope_pct").alias("avg_slope_pct"))


@query(
    "pth14_straight_line",
    S.with_("tgt", "dem", rq=GRID["rq"])
    + f"SELECT request_id, {S.cls('(za-zb)/d*100')} AS target_difficulty, round((za-zb)/d*100,4) AS avg_slope_pct, 2 AS n_points FROM rq WHERE za IS NOT NULL AND zb IS NOT NULL AND d>0",
)
def pth14(spark, sf):
    r = R.with_elevations(X.targets(spark, sf), *world(spark, sf)).where(c("elevation").isNotNull() & c("target_elevation").isNotNull())
    return R.straight_line(r).select("request_id", "target_difficulty", r4("avg_slope_pct").alias("avg_slope_pct"), F.size("points").alias("n_points"))


@query(
    "gen16_request_sources",
    S.with_("req", "dem", "station")
    + f"SELECT 'click' AS source, request_id AS id, round(d.elevation,4) AS elevation FROM req r JOIN dem d ON d.row={S.row_of('r.lat')} AND d.col={S.col_of('r.lon')} WHERE d.elevation IS NOT NULL UNION ALL SELECT 'node', node_ord, round(elevation,4) FROM station",
)
def gen16(spark, sf):
    """Starts from map clicks (elevation read from the raster) and from nodes (their own elevation)."""
    from terrapath.sources import dem as D

    click = D.lookup_elevation(X.requests(spark, sf), *world(spark, sf)).where(c("elevation").isNotNull())
    a = click.select(F.lit("click").alias("source"), c("request_id").alias("id"), r4("elevation").alias("elevation"))
    b = X.stations(spark, sf).select(F.lit("node").alias("source"), c("node_ord").alias("id"), r4("elevation").alias("elevation"))
    return a.unionByName(b)


@query(
    "srt7_grid_order",
    _G + "SELECT request_id, min(row*1000+col) AS first_node, max(row*1000+col) AS last_node FROM gz GROUP BY 1",
)
def srt7(spark, sf):
    node = F.struct("row", "col")
    g = grid(spark, sf).groupBy("request_id").agg(F.min(node).alias("a"), F.max(node).alias("b"))
    code = lambda n: (c(f"{n}.row") * 1000 + c(f"{n}.col")).cast("long")
    return g.select("request_id", code("a").alias("first_node"), code("b").alias("last_node"))


_RGBN = {"green": "34,197,94", "blue": "59,130,246", "red": "239,68,68", "black": "31,41,55"}


@query(
    "snk6_proposal_features",
    FAN.rstrip()
    + f""",
  one AS (SELECT f.request_id, f.ord, f.n, p.lon, p.lat, p.z, p.step, {S.case_map(_RGBN,'f.difficulty')} AS rgb FROM fan f JOIN tr p ON p.id=f.tid)
  SELECT request_id, ord, 'start_marker' AS kind, round(lon,7) AS lon, round(lat,7) AS lat, round(z,4) AS elevation, '[255,255,255,200]' AS color FROM one WHERE step=0
  UNION ALL SELECT request_id, ord, 'proposal_body', round(lon,7), round(lat,7), round(z,4), '['||rgb||CASE WHEN ord=0 THEN ',255]' ELSE ',150]' END FROM one WHERE step=n//2
  UNION ALL SELECT request_id, ord, 'proposal_endpoint', round(lon,7), round(lat,7), round(z,4), '[249,115,22,230]' FROM one WHERE step=n-1""",
)
def snk6(spark, sf):
    """Start, body and end markers of every proposal in one pass; the first proposal is selected."""
    from terrapath import config as C
    from terrapath.functions import terrain

    text = lambda a: F.concat(F.lit("["), F.array_join(a, ","), F.lit("]"))
    const = lambda v: F.lit(str(v).replace(" ", ""))
    rgb = F.slice(terrain.lookup(C.SLOPE_RGBA, c("difficulty")), 1, 3)
    body = text(F.concat(rgb, F.array(F.when(c("ord") == 0, 255).otherwise(150))))
    mark = lambda k, at, col: F.struct(F.lit(k).alias("kind"), F.element_at("points", at).alias("p"), col.alias("color"))
    marks = F.array(
        mark("start_marker", 1, const(C.START_MARKER_RGBA)),
        mark("proposal_body", F.floor(F.size("points") / 2).cast("int") + 1, body),
        mark("proposal_endpoint", -1, const(C.ENDPOINT_RGBA)),
    )
    return fan(spark, sf).where(F.size("points") > 0).select("request_id", "ord", F.inline(marks)).select(
        "request_id", "ord", "kind", r7("p.lon").alias("lon"), r7("p.lat").alias("lat"), r4("p.elevation").alias("elevation"), "color"
    )


