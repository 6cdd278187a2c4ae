"""Lift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions import terrain
from terrapath.operators import lifts as L
from terrapath.plans import sqlkit as S
from terrapath.plans.registry import query, r4, r7, rounded
from terrapath.plans.scalar import _NAME_L
from terrapath.sources import fixtures as X

c = F.col
_D = S.hav("start_lat", "start_lon", "end_lat", "end_lon")
_DD = "d*i/n"

TERRAIN = {
    "l1": f"SELECT *, {_D} AS d, {S.brg('start_lon','start_lat','end_lon','end_lat')} AS bb FROM lift",
    "l2": "SELECT *, CASE WHEN d<30 THEN 1 ELSE greatest(2, cast(trunc(d/30.0) as bigint)) END AS n FROM l1",
    "l3": "SELECT *, unnest(range(0,n+1)) AS i FROM l2",
    "l4": f"SELECT *, CASE WHEN i=0 THEN start_lon WHEN i=n THEN end_lon ELSE {S.dest_lon('start_lon','start_lat','bb','(d*(i::double/n))')} END AS lon, CASE WHEN i=0 THEN start_lat WHEN i=n THEN end_lat ELSE {S.dest_lat('start_lon','start_lat','bb','(d*(i::double/n))')} END AS lat FROM l3",
    "ter": f"SELECT l.*, CASE WHEN i=0 THEN start_elevation WHEN i=n THEN end_elevation ELSE coalesce(m.elevation, start_elevation+(i::double/n)*(end_elevation-start_elevation)) END AS z FROM l4 l LEFT JOIN dem m ON m.row={S.row_of('l.lat')} AND m.col={S.col_of('l.lon')}",
}
_T = S.with_("lift", **TERRAIN)


def pylon_ctes(types: str) -> dict[str, str]:
    """Three-phase pylon search in SQL; ``types`` gives (lift_no, lt)."""
    rows = ",".join(f"('{t}',{','.join(str(float(x)) + '::double' for x in v)})" for t, v in C.PYLON_TABLE.items())
    worst = """SELECT {k}, s, e, zs, ze, max(v) AS v, first(j ORDER BY v DESC, j) AS j FROM (
       SELECT q.*, t.i AS j, q.clr-((1-(t.i-s)::double/(e-s))*zs+((t.i-s)::double/(e-s))*ze-4*(sag*((e-s)*step))*((t.i-s)::double/(e-s))*(1-(t.i-s)::double/(e-s))-t.z) AS v
       FROM {src} q JOIN tz t ON t.lift_no=q.lift_no AND t.i BETWEEN q.s+q.mi AND q.e-q.mi) GROUP BY ALL HAVING max(v)>0"""
    keys = "lift_no, lt, step, mi, mx, clr, hgt, stn, sag, nn"

    def recurse(name: str, seed: str) -> str:
        found = worst.format(k=keys, src=f"{name}")
        return f"""SELECT {keys}, s, e, zs, ze, -1 AS w FROM ({seed}) UNION ALL
      (WITH f AS MATERIALIZED ({found}) SELECT {keys.replace('lift_no','f.lift_no',1)}, CASE WHEN side=0 THEN s ELSE j END, CASE WHEN side=0 THEN j ELSE e END,
        CASE WHEN side=0 THEN zs ELSE t.z+hgt END, CASE WHEN side=0 THEN t.z+hgt ELSE ze END, j FROM f JOIN tz t ON t.lift_no=f.lift_no AND t.i=f.j, (VALUES (0),(1)) sd(side))"""

    return {
        "cfg": f"SELECT * FROM (VALUES {rows}) t(lt,hgt,stn,mns,mxs,clr,sag)",
        "tz": "SELECT lift_no, i, z, lon, lat FROM ter",
        "par": f"SELECT y.lift_no, y.lt, x.d/x.n AS step, greatest(2,cast(trunc(mns/(x.d/x.n)) as bigint)) AS mi, cast(trunc(mxs/(x.d/x.n)) as bigint) AS mx, clr, hgt, stn, sag, x.n+1 AS nn, x.start_elevation+stn AS z0, x.end_elevation+stn AS z1 FROM ({types}) y JOIN l2 x ON x.lift_no=y.lift_no JOIN cfg ON cfg.lt=y.lt WHERE x.n>=2",
        "ph1": recurse("ph1", f"SELECT {keys}, 0::bigint AS s, nn-1 AS e, z0 AS zs, z1 AS ze FROM par"),
        "p1": "SELECT p.lift_no, p.lt, p.nn, p.mx, list_sort(coalesce(list(DISTINCT w) FILTER (WHERE w>=0), []::bigint[])) AS p FROM ph1 p GROUP BY ALL",
        "ph2": "SELECT lift_no, lt, nn, mx, 0 AS r, p FROM p1 UNION ALL SELECT lift_no, lt, nn, mx, r+1, q FROM (SELECT *, list_sort(list_distinct(p || list_filter(list_transform(range(1,len(a)), lambda k: CASE WHEN a[k+1]-a[k]>mx THEN (a[k]+a[k+1])//2 END), lambda m: m IS NOT NULL AND m>0 AND m<nn-1))) AS q FROM (SELECT *, [0]||p||[nn-1] AS a FROM ph2)) WHERE r<20 AND q<>p",
        "p2": "SELECT lift_no, lt, arg_max(p, r) AS p FROM ph2 GROUP BY 1,2",
        "anc": "SELECT *, unnest(range(1,len(a))) AS k FROM (SELECT p2.lift_no, p2.lt, [0]||p||[par.nn-1] AS a FROM p2 JOIN par ON par.lift_no=p2.lift_no AND par.lt=p2.lt)",
        "sp3": "SELECT par.*, a[k] AS s, a[k+1] AS e, CASE WHEN k=1 THEN z0 ELSE t1.z+hgt END AS zs, CASE WHEN k=len(a)-1 THEN z1 ELSE t2.z+hgt END AS ze FROM anc JOIN par ON par.lift_no=anc.lift_no AND par.lt=anc.lt JOIN tz t1 ON t1.lift_no=anc.lift_no AND t1.i=a[k] JOIN tz t2 ON t2.lift_no=anc.lift_no AND t2.i=a[k+1]",
        "ph3": recurse("ph3", f"SELECT {keys}, s, e, zs, ze FROM sp3"),
        "p3": "SELECT p2.lift_no, p2.lt, list_sort(list_distinct(p2.p || coalesce(x.w, []::bigint[]))) AS p FROM p2 LEFT JOIN (SELECT lift_no, lt, list(DISTINCT w) FILTER (WHERE w>=0) AS w FROM ph3 GROUP BY 1,2) x ON x.lift_no=p2.lift_no AND x.lt=p2.lt",
        "pyl": "SELECT q.lift_no, q.lt, q.k, q.i, q.i*par.step AS dist, t.lon, t.lat, t.z AS ground, par.hgt FROM (SELECT lift_no, lt, unnest(range(1,len(p)+1)) AS k, unnest(p) AS i FROM p3) q JOIN par ON par.lift_no=q.lift_no AND par.lt=q.lt JOIN tz t ON t.lift_no=q.lift_no AND t.i=q.i",
    }


def cable_ctes(types: str) -> dict[str, str]:
    return {
        "ax": f"SELECT y.lift_no, y.lt, 0 AS k, 0.0::double AS x, start_elevation+stn AS y, d, n+1 AS nn, sag FROM ({types}) y JOIN l2 x ON x.lift_no=y.lift_no JOIN cfg ON cfg.lt=y.lt UNION ALL SELECT p.lift_no, p.lt, p.k, dist, ground+p.hgt, d, n+1, sag FROM pyl p JOIN l2 x ON x.lift_no=p.lift_no JOIN cfg ON cfg.lt=p.lt UNION ALL SELECT y.lift_no, y.lt, 1000000, d, end_elevation+stn, d, n+1, sag FROM ({types}) y JOIN l2 x ON x.lift_no=y.lift_no JOIN cfg ON cfg.lt=y.lt",
        "sg": "SELECT *, greatest(10, cast(trunc((x2-x)/20.0) as bigint)) AS m FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS k2 FROM ax WINDOW w AS (PARTITION BY lift_no, lt ORDER BY k)) WHERE x2>x",
        "cp": "SELECT *, (x+(x2-x)*j/m)/d*(nn-1) AS pos, j::double/m AS f FROM (SELECT *, unnest(range(CASE WHEN k2>1 THEN 1 ELSE 0 END, m+1)) AS j FROM sg)",
        "cab": "SELECT c.lift_no, c.lt, row_number() OVER (PARTITION BY c.lift_no, c.lt ORDER BY k2, j)-1 AS i, a.lon+(b.lon-a.lon)*(pos-trunc(pos)) AS lon, a.lat+(b.lat-a.lat)*(pos-trunc(pos)) AS lat, (1-f)*y+f*y2-4*(sag*(x2-x))*f*(1-f) AS z FROM cp c JOIN tz a ON a.lift_no=c.lift_no AND a.i=cast(trunc(pos) as bigint) JOIN tz b ON b.lift_no=c.lift_no AND b.i=least(cast(trunc(pos) as bigint)+1, nn-1)",
    }


_OWN = "SELECT lift_no, lift_type AS lt FROM lift"
_P = S.with_("lift", recursive=True, **TERRAIN, **pylon_ctes(_OWN))
_PC = S.with_("lift", recursive=True, **TERRAIN, **pylon_ctes(_OWN), **cable_ctes(_OWN))


def world(spark, sf):
    return X.dem_cells(spark, sf), X.dem_meta(spark, sf)


def terrain_lifts(spark, sf):
    return L.with_terrain(X.lift_ends(spark, sf), *world(spark, sf))


def full_lifts(spark, sf):
    return L.build(terrain_lifts(spark, sf))


@query(
    "lft1_terrain_samples",
    _T + "SELECT lift_id, i, round(lon,7) AS lon, round(lat,7) AS lat, round(z,4) AS elevation FROM ter",
)
def lft1(spark, sf):
    return L.terrain_samples(X.lift_ends(spark, sf), *world(spark, sf)).select(
        "lift_id", "i", r7("lon").alias("lon"), r7("lat").alias("lat"), r4("elevation").alias("elevation")
    )


@query(
    "lft2_cable_elevation",
    "SELECT event_id, round((1-t)*1500+t*(1500+value)-4*(0.06::double*(100+event_id%200))*t*(1-t),4) AS z FROM (SELECT *, (event_id%11)/10.0::double AS t FROM events)",
)
def lft2(spark, sf):
    k = c("event_id")
    z = L.cable_elevation((k % 11) / F.lit(10.0), 1500.0, 1500.0 + c("value"), (100 + k % 200).cast("double"), 0.06)
    return X.table(spark, sf, "events").select("event_id", r4(z).alias("z"))


def _joined(a):
    return F.array_join(F.transform(a, lambda i: i.cast("string")), ",")


@query("lft3_clearance", _P + "SELECT 'L'||(lift_no+1) AS lift_id, array_to_string(p,',') AS idx FROM p1")
def lft3(spark, sf):
    return L.pylon_phases(terrain_lifts(spark, sf)).select("lift_id", _joined(c("clear")).alias("idx"))


@query("lft4_spacing", _P + "SELECT 'L'||(lift_no+1) AS lift_id, array_to_string(p,',') AS idx FROM p2")
def lft4(spark, sf):
    return L.pylon_phases(terrain_lifts(spark, sf)).select("lift_id", _joined(c("spaced")).alias("idx"))


@query(
    "lft5_pylons",
    _P
    + "SELECT 'L'||(lift_no+1) AS lift_id, i AS index, round(dist,4) AS distance_m, round(lon,7) AS lon, round(lat,7) AS lat, round(ground,4) AS ground_m, hgt AS height_m FROM pyl",
)
def lft5(spark, sf):
    p = L.with_pylons(terrain_lifts(spark, sf)).select("lift_id", F.explode_outer("pylons").alias("p")).where(c("p").isNotNull())
    return p.select(
        "lift_id",
        "p.index",
        r4("p.distance_m").alias("distance_m"),
        r7("p.lon").alias("lon"),
        r7("p.lat").alias("lat"),
        r4("p.ground_elevation_m").alias("ground_m"),
        "p.height_m",
    )


@query(
    "lft6_cable_points",
    _PC + "SELECT 'L'||(lift_no+1) AS lift_id, i, round(lon,7) AS lon, round(lat,7) AS lat, round(z,4) AS elevation FROM cab",
)
def lft6(spark, sf):
    p = full_lifts(spark, sf).select("lift_id", F.posexplode_outer("cable_points").alias("i", "p"))
    return p.select("lift_id", "i", r7("p.lon").alias("lon"), r7("p.lat").alias("lat"), r4("p.elevation").alias("elevation"))


_ALT = "SELECT l.lift_no, cfg0.lt FROM lift l, (VALUES ('surface_lift'),('chairlift'),('gondola'),('aerial_tram')) cfg0(lt) WHERE cfg0.lt<>l.lift_type"


@query(
    "lft7_change_type",
    S.with_("lift", recursive=True, **TERRAIN, **pylon_ctes(_ALT), **cable_ctes(_ALT))
    + f"SELECT 'L'||(y.lift_no+1) AS lift_id, y.lt AS new_type, {_NAME_L.replace('num','(y.lift_no+1)')} AS name, coalesce(np,0) AS n_pylons, nc AS n_cable, round(zs,3) AS cable_sum FROM (SELECT a.lift_no, a.lt, a.lt AS t, x.d AS len, x.end_elevation-x.start_elevation AS rise, {S.brg('x.end_lon','x.end_lat','x.start_lon','x.start_lat')} AS b FROM ({_ALT}) a JOIN l2 x ON x.lift_no=a.lift_no) y LEFT JOIN (SELECT lift_no, lt, count(*) AS np FROM pyl GROUP BY 1,2) p ON p.lift_no=y.lift_no AND p.lt=y.lt JOIN (SELECT lift_no, lt, count(*) AS nc, sum(z) AS zs FROM cab GROUP BY 1,2) q ON q.lift_no=y.lift_no AND q.lt=y.lt",
)
def lft7(spark, sf):
    w = L.what_if_types(terrain_lifts(spark, sf))
    z = F.aggregate("cable_points", F.lit(0.0), lambda a, p: a + p["elevation"])
    return w.select(
        "lift_id", "new_type", "name", F.size("pylons").alias("n_pylons"), F.size("cable_points").alias("n_cable"),
        rounded(z, 3).alias("cable_sum"),
    )


@query(
    "lft8_add_lift",
    S.with_("lift", recursive=True, **TERRAIN, **pylon_ctes("SELECT lift_no, lift_type AS lt FROM lift WHERE end_elevation>start_elevation"))
    + "SELECT l.lift_id, end_elevation>start_elevation AS added, coalesce(np,0) AS n_pylons FROM lift l LEFT JOIN (SELECT lift_no, count(*) AS np FROM pyl GROUP BY 1) p ON p.lift_no=l.lift_no",
)
def lft8(spark, sf):
    added, rejected = L.add_lifts(X.lift_ends(spark, sf), *world(spark, sf))
    a = added.select("lift_id", F.lit(True).alias("added"), F.size("pylons").alias("n_pylons"))
    return a.unionByName(rejected.select("lift_id", F.lit(False).alias("added"), F.lit(0).alias("n_pylons")))


@query("lft9_rise_length", S.with_("lift") + f"SELECT lift_id, round(end_elevation-start_elevation,4) AS rise_m, round({_D},4) AS length_m FROM lift")
def lft9(spark, sf):
    return X.lift_ends(spark, sf).select(
        "lift_id", r4(c("end_elevation") - c("start_elevation")).alias("rise_m"), r4(L.length_between()).alias("length_m")
    )


@query("lft10_pylon_top", _P + "SELECT 'L'||(lift_no+1) AS lift_id, k AS number, round(ground+hgt,4) AS top_m FROM pyl")
def lft10(spark, sf):
    p = L.with_pylons(terrain_lifts(spark, sf)).select("lift_id", F.posexplode_outer("pylons").alias("i", "p")).where(c("p").isNotNull())
    return p.select("lift_id", (c("i") + 1).alias("number"), r4(c("p.ground_elevation_m") + c("p.height_m")).alias("top_m"))


@query(
    "srt6_anchor_order",
    _P + "SELECT 'L'||(lift_no+1) AS lift_id, k AS place, round(dist,4) AS distance_m FROM pyl",
)
def srt6(spark, sf):
    order = lambda a, b: F.when(a["distance_m"] < b["distance_m"], -1).when(a["distance_m"] > b["distance_m"], 1).otherwise(0)
    p = L.with_pylons(terrain_lifts(spark, sf)).select("lift_id", F.posexplode_outer(F.array_sort("pylons", order)).alias("i", "p")).where(c("p").isNotNull())
    return p.select("lift_id", (c("i") + 1).alias("place"), r4("p.distance_m").alias("distance_m"))


@query(
    "set3_pylon_union",
    _P + "SELECT 'L'||(lift_no+1) AS lift_id, len(p) AS n_pylons, len(list_distinct(p)) AS n_distinct FROM p3",
)
def set3(spark, sf):
    p = L.with_pylons(terrain_lifts(spark, sf)).where(F.size("terrain_points") >= 3)
    idx = F.transform("pylons", lambda x: x["index"])
    return p.select("lift_id", F.size("pylons").alias("n_pylons"), F.size(F.array_distinct(idx)).alias("n_distinct"))


@query(
    "agg12_lift_panel",
    S.with_("lift", recursive=True, **TERRAIN, **pylon_ctes(_OWN),
    pg="SELECT lift_no, max(CASE WHEN d2>dist THEN abs((g2-(ground+hgt))/(d2-dist)*100) END) AS mg, count(*) AS np FROM (SELECT *, lead(dist) OVER w AS d2, lead(ground+hgt) OVER w AS g2 FROM pyl WINDOW w AS (PARTITION BY lift_no ORDER BY k)) GROUP BY 1")
    + "SELECT lift_id, round(end_elevation-start_elevation,4) AS rise_m, round(d,4) AS horizontal_m, round(sqrt((end_elevation-start_elevation)*(end_elevation-start_elevation)+d*d),4) AS inclined_m, coalesce(np,0) AS n_pylons, round((end_elevation-start_elevation)/d*100,4) AS avg_gradient, round(coalesce(mg,0.0),4) AS max_gradient FROM l2 LEFT JOIN pg ON pg.lift_no=l2.lift_no",
)
def agg12(spark, sf):
    p = L.with_pylons(terrain_lifts(spark, sf))
    rise = c("end_elevation") - c("start_elevation")
    return p.select(
        "lift_id",
        r4(rise).alias("rise_m"),
        r4("length_m").alias("horizontal_m"),
        r4(F.sqrt(rise * rise + c("length_m") * c("length_m"))).alias("inclined_m"),
        F.size("pylons").alias("n_pylons"),
        r4(F.when(c("length_m") > 0, rise / c("length_m") * 100.0).otherwise(0.0)).alias("avg_gradient"),
        r4(L.steepest_between_pylons()).alias("max_gradient"),
    )


_RGBA = {t: str(v).replace(" ", "") for t, v in C.LIFT_RGBA.items()}


@query(
    "snk4_lift_features",
    _PC
    + f"""SELECT l.lift_id AS lift_id, 'pylon' AS kind, k-1 AS idx, round(p.lon,7) AS lon, round(p.lat,7) AS lat, round(ground+hgt+20,4) AS z, 'Pylon '||k||' on '||l.lift_id AS name, '[107,114,128,230]' AS color FROM pyl p JOIN lift l ON l.lift_no=p.lift_no
    UNION ALL SELECT l.lift_id, 'cable', c.i, round(c.lon,7), round(c.lat,7), round(c.z+10,4), l.lift_id, {S.case_map(_RGBA,'l.lift_type')} FROM cab c JOIN lift l ON l.lift_no=c.lift_no
    UNION ALL SELECT lift_id, 'icon', 0, round((start_lon+end_lon)/2,7), round((start_lat+end_lat)/2,7), round((start_elevation+end_elevation)/2+20,4), lift_id, {S.case_map(_RGBA,'lift_type')} FROM lift""",
)
def snk4(spark, sf):
    """Cable vertices, pylon markers and mid icons in one pass over each lift row."""
    color = F.concat(F.lit("["), F.array_join(terrain.lookup(C.LIFT_RGBA, c("lift_type")), ","), F.lit("]"))

    def feature(kind, i, lon, lat, z, name, col):
        return F.struct(
            F.lit(kind).alias("kind"), i.cast("int").alias("idx"), r7(lon).alias("lon"), r7(lat).alias("lat"), r4(z).alias("z"),
            name.alias("name"), col.alias("color"),
        )

    gray = F.lit(str(C.NODE_PYLON_RGBA).replace(" ", ""))
    pylons = F.transform(
        "pylons",
        lambda p, i: feature("pylon", i, p["lon"], p["lat"], p["ground_elevation_m"] + p["height_m"] + 20, F.concat(F.lit("Pylon "), i + 1, F.lit(" on "), c("lift_id")), gray),
    )
    cable = F.transform("cable_points", lambda p, i: feature("cable", i, p["lon"], p["lat"], p["elevation"] + 10, c("lift_id"), color))
    mid = lambda k: (c(f"start_{k}") + c(f"end_{k}")) / 2
    icon = F.array(feature("icon", F.lit(0), mid("lon"), mid("lat"), mid("elevation") + 20, c("lift_id"), color))
    return full_lifts(spark, sf).select("lift_id", F.inline_outer(F.concat(pylons, cable, icon)))


@query(
    "snk14_lift_profile",
    S.with_("lift", recursive=True, **TERRAIN, **pylon_ctes(_OWN), **cable_ctes(_OWN),
    cx=f"SELECT c.*, l.lift_id, l.d, l.n, {S.hav('l.start_lat','l.start_lon','c.lat','c.lon')} AS x FROM cab c JOIN l2 l ON l.lift_no=c.lift_no",
    cy="SELECT *, x/d*n AS pos, least(cast(trunc(x/d*n) as bigint),n) AS lo FROM cx")
    + "SELECT lift_id, c.i, round(x,3) AS x_m, round(c.z,3) AS cable_m, round(a.z*(1-(pos-lo))+b.z*(pos-lo),3) AS ground_m, round(x/d*100,3) AS share_pct FROM cy c JOIN tz a ON a.lift_no=c.lift_no AND a.i=lo JOIN tz b ON b.lift_no=c.lift_no AND b.i=least(lo+1,n)",
)
def snk14(spark, sf):
    p = L.cable_profile(full_lifts(spark, sf))
    return p.select("lift_id", "i", *[rounded(n, 3).alias(n) for n in ("x_m", "cable_m", "ground_m", "share_pct")])

