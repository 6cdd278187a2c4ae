"""Trace and fan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.operators import fan as N
from terrapath.plans import sqlkit as S
from terrapath.plans.registry import query, r4, r7
from terrapath.plans.terrain_plans import gradient_ctes
from terrapath.sources import fixtures as X

c = F.col


def world(spark, sf):
    return X.dem_cells(spark, sf), X.dem_meta(spark, sf)


def grades_cte() -> str:
    rows = ",".join(f"({o},'{d}','{g}',{t}::double)" for o, d, g, t in C.GRADE_TARGETS)
    return f"SELECT * FROM (VALUES {rows}) t(grade_ord,target_difficulty,grade,tgt)"


def trace_ctes(src: str) -> dict[str, str]:
    """All steps of the traces in CTE ``src`` (id, lon, lat, tgt, sgn, len), as recursive CTE ``tr``."""
    ring = f"(SELECT unnest([{','.join(str(int(b)) for b in C.RING_BEARINGS)}])::double AS b, r, w FROM (VALUES (15.0::double,2.0::double),(30.0::double,1.0::double)) t(r,w))"
    wrap = lambda x: f"(CASE WHEN {x}>180 THEN {x}-360 WHEN {x}<-180 THEN {x}+360 ELSE {x} END)"
    step = f"""
    WITH cur AS MATERIALIZED (SELECT * FROM tr WHERE dist<len),
    smp AS (SELECT id, z, b, r, w, {S.dest_lon('lon','lat','b','r')} AS slon, {S.dest_lat('lon','lat','b','r')} AS slat FROM cur, {ring}),
    gxy AS (SELECT id, sum((z-d.elevation)/r*100*w*sin(radians(b)))/sum(w) AS gx, sum((z-d.elevation)/r*100*w*cos(radians(b)))/sum(w) AS gy
      FROM smp s JOIN dem d ON d.row={S.row_of('s.slat')} AND d.col={S.col_of('s.slon')} WHERE {S.inside('s.slon','s.slat')} AND d.elevation IS NOT NULL GROUP BY id),
    a1 AS (SELECT c.*, coalesce(sqrt(gx*gx+gy*gy),0.0) AS slope, coalesce({S.pmod('degrees(atan2(gx,gy))+360.0')},0.0) AS fall,
      CASE WHEN len-dist>30 THEN greatest(5.0,least(tgt*2.5,(tgt/100.0*len-fallen)/(len-dist)*100.0)) ELSE tgt END AS want FROM cur c LEFT JOIN gxy g ON c.id=g.id),
    a2 AS (SELECT *, {S.pmod('fall+sgn*(CASE WHEN slope>0 AND want<slope THEN least(greatest(degrees(acos(greatest(-1.0,least(1.0,want/slope)))),2.0),89.0) ELSE 2.0 END)')} AS tb,
      {S.pmod('degrees(atan2(list_sum(list_transform(bl,lambda q: sin(radians(q)))),list_sum(list_transform(bl,lambda q: cos(radians(q))))))')} AS mb FROM a1),
    a3 AS (SELECT *, CASE WHEN slope<15 AND len(bl)>=2 THEN {S.pmod('mb+(1.0-0.8::double*(1.0-slope/15.0))*' + wrap('(tb-mb)'))} ELSE tb END AS b1 FROM a2),
    a4 AS (SELECT *, {wrap('(b1-bl[-1])')} AS turn FROM a3),
    a5 AS (SELECT *, CASE WHEN len(bl)>0 AND abs(turn)>40 THEN {S.pmod('bl[-1]+CASE WHEN turn>0 THEN 40.0 ELSE -40.0 END')} ELSE b1 END AS b2 FROM a4),
    a6 AS (SELECT *, {S.dest_lon('lon','lat','b2','30.0::double')} AS nlon, {S.dest_lat('lon','lat','b2','30.0::double')} AS nlat FROM a5)
    SELECT a.id, step+1, nlon, nlat, d.elevation, tgt, sgn, a.len, dist+{S.hav('a.lat','a.lon','nlat','nlon')}, fallen+(z-d.elevation),
      CASE WHEN len(bl)>=4 THEN bl[2:4] || [b2] ELSE bl || [b2] END
    FROM a6 a JOIN dem d ON d.row={S.row_of('nlat')} AND d.col={S.col_of('nlon')} WHERE {S.inside('nlon','nlat')} AND d.elevation IS NOT NULL"""
    init = f"SELECT s.id, 0 AS step, s.lon, s.lat, d.elevation AS z, s.tgt, s.sgn, s.len, 0.0::double AS dist, 0.0::double AS fallen, []::double[] AS bl FROM {src} s JOIN dem d ON d.row={S.row_of('s.lat')} AND d.col={S.col_of('s.lon')} WHERE d.elevation IS NOT NULL"
    return {
        "tr": f"{init} UNION ALL ({step})",
        "tsum": "SELECT id, count(*) AS n, max(dist) AS length_m, arg_min(z,step)-arg_max(z,step) AS drop_m, arg_max(lon,step) AS end_lon, arg_max(lat,step) AS end_lat FROM tr GROUP BY id HAVING count(*)>=4",
        "tres": f"SELECT *, {S.cls('avg_slope_pct')} AS difficulty FROM (SELECT *, CASE WHEN length_m>0 THEN drop_m/length_m*100 ELSE 0.0 END AS avg_slope_pct FROM tsum)",
    }


_FAN_CTES = {
    "src": "SELECT request_id AS id, lon, lat FROM req",
    **gradient_ctes("src"),
    "gr": grades_cte(),
    "want": "SELECT request_id, r.lon, r.lat, r.length_m, o.*, s.sgn, s.side, grade_ord*2+s.k AS ord, request_id*16+grade_ord*2+s.k AS tid FROM req r JOIN grad g ON g.id=r.request_id AND g.elevation IS NOT NULL CROSS JOIN gr o JOIN (VALUES ('left',0,-1.0::double),('right',1,1.0::double),('center',0,1.0::double)) s(side,k,sgn) ON (s.side='center')=(o.tgt>=g.slope_pct)",
    "tsrc": "SELECT tid AS id, lon, lat, tgt, sgn, length_m AS len FROM want",
    **trace_ctes("tsrc"),
    "wt": "SELECT w.*, t.n, t.length_m AS traced_m, t.drop_m, t.avg_slope_pct, t.difficulty, t.end_lon, t.end_lat FROM want w LEFT JOIN tres t ON t.id=w.tid",
    "fire": "SELECT w.request_id, w.grade_ord FROM wt w WHERE side='center' AND (SELECT count(*) FROM wt v WHERE v.request_id=w.request_id AND v.side='center' AND v.grade_ord<=w.grade_ord)>4 AND (SELECT count(DISTINCT v.target_difficulty) FROM wt v WHERE v.request_id=w.request_id AND v.grade_ord<w.grade_ord AND v.n IS NOT NULL AND v.target_difficulty IN ('green','blue','red'))=3",
    "fan": "SELECT w.* FROM wt w LEFT JOIN (SELECT request_id, min(grade_ord) AS g FROM fire GROUP BY 1) f ON f.request_id=w.request_id WHERE (f.g IS NULL OR w.grade_ord<=f.g) AND w.n IS NOT NULL",
}
FAN = S.with_("req", "dem", recursive=True, **_FAN_CTES)
_NAME = "upper(target_difficulty[1])||target_difficulty[2:]||' '||upper(side[1])||side[2:]||' ('||upper(grade[1])||grade[2:]||')'"


def fan(spark, sf):
    return N.generate_fan(X.requests(spark, sf), *world(spark, sf))


@query(
    "gen4_fan",
    FAN
    + f"SELECT request_id, ord, {_NAME} AS sector_name, n AS n_points, round(traced_m,4) AS length_m, round(drop_m,4) AS drop_m, round(avg_slope_pct,4) AS avg_slope_pct, difficulty, round(end_lon,7) AS end_lon, round(end_lat,7) AS end_lat FROM fan",
)
def gen4(spark, sf):
    f = fan(spark, sf)
    end = F.element_at("points", -1)
    return f.select(
        "request_id",
        "ord",
        "sector_name",
        F.size("points").alias("n_points"),
        *[r4(n).alias(n) for n in ("length_m", "drop_m", "avg_slope_pct")],
        "difficulty",
        r7(end["lon"]).alias("end_lon"),
        r7(end["lat"]).alias("end_lat"),
    )


_ONE = S.with_(
    "req", "dem", recursive=True,
    tsrc="SELECT request_id AS id, lon, lat, (7+5*(request_id%9))::double AS tgt, CASE WHEN request_id%3=0 THEN -1.0::double ELSE 1.0::double END AS sgn, length_m AS len FROM req",
    **trace_ctes("tsrc"),
)


def single(spark, sf, seed=None):
    k = c("request_id")
    starts = X.requests(spark, sf).select(
        "*",
        (7 + 5 * (k % 9)).cast("double").alias("target_slope_pct"),
        F.element_at(F.array(*map(F.lit, ("left", "right", "center"))), (k % 3 + 1).cast("int")).alias("side"),
    )
    return N.trace_downhill(starts, *world(spark, sf), "request_id", seed=seed)


@query(
    "gen1_trace_downhill",
    _ONE
    + "SELECT t.id AS request_id, step AS i, round(lon,7) AS lon, round(lat,7) AS lat, round(z,4) AS elevation FROM tr t JOIN tsum s ON s.id=t.id",
)
def gen1(spark, sf):
    t = single(spark, sf).where(c("points").isNotNull()).select("request_id", F.posexplode("points").alias("i", "p"))
    return t.select(
        "request_id", "i", r7("p.lon").alias("lon"), r7("p.lat").alias("lat"), r4("p.elevation").alias("elevation")
    )


@query(
    "gen2_trace_summary",
    _ONE
    + "SELECT id AS request_id, round(length_m,4) AS length_m, round(drop_m,4) AS drop_m, round(avg_slope_pct,4) AS avg_slope_pct, difficulty FROM tres",
)
def gen2(spark, sf):
    return (
        single(spark, sf)
        .where(c("points").isNotNull())
        .select("request_id", *[r4(n).alias(n) for n in ("length_m", "drop_m", "avg_slope_pct")], "difficulty")
    )


@query("gen1_trace_with_noise")
def gen1_noise(spark, sf):
    """Seeded noise variant (engine-own hash, so rows only)."""
    return (
        single(spark, sf, seed=11)
        .where(c("points").isNotNull())
        .select("request_id", F.size("points").alias("n_points"), r4("length_m").alias("length_m"))
    )


_SIDES = S.with_("req", "dem", **{k: _FAN_CTES[k] for k in ("src", *gradient_ctes("src"), "gr", "want")})


@query(
    "gen3_side_decision",
    _SIDES + "SELECT request_id, ord, side FROM want",
)
def gen3(spark, sf):
    from terrapath.sources import dem as D

    cells, m = world(spark, sf)
    r = X.requests(spark, sf)
    g = D.gradient(r, cells, m, "request_id").where(c("elevation").isNotNull())
    return N.expand_grades(g, "slope_pct").select("request_id", "ord", "side")


@query(
    "join11_grade_sides",
    _SIDES + "SELECT side, target_difficulty, grade, count(*) AS n FROM want GROUP BY ALL",
)
def join11(spark, sf):
    from terrapath.sources import dem as D

    cells, m = world(spark, sf)
    g = D.gradient(X.requests(spark, sf), cells, m, "request_id").where(c("elevation").isNotNull())
    return N.expand_grades(g, "slope_pct").groupBy("side", "target_difficulty", "grade").agg(F.count(F.lit(1)).alias("n"))


@query(
    "win6_center_stop",
    FAN + "SELECT request_id, count(*) AS n_proposals, sum(CASE WHEN side='center' THEN 1 ELSE 0 END) AS n_center FROM fan GROUP BY 1",
)
def win6(spark, sf):
    return (
        fan(spark, sf)
        .groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("n_proposals"), F.count_if(c("side") == "center").alias("n_center"))
    )


@query(
    "win8_bearing_memory",
    "SELECT user_id, event_id, round("
    + S.pmod("degrees(atan2(sum(sin(radians(b))) OVER w, sum(cos(radians(b))) OVER w))")
    + ",4) AS mean_deg FROM (SELECT event_id//64 AS user_id, event_id, ((event_id*7)%90)::double AS b FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
)
def win8(spark, sf):
    """Moving mean of the last four bearings of a track (64 rows per track)."""
    from pyspark.sql import Window as W

    b = F.radians(((c("event_id") * 7) % 90).cast("double"))
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-3, 0)
    mean = F.pmod(F.degrees(F.atan2(F.sum(F.sin(b)).over(w), F.sum(F.cos(b)).over(w))), F.lit(360.0))
    return X.table(spark, sf, "events").select(F.floor(c("event_id") / 64).alias("user_id"), "event_id").select(
        "user_id", "event_id", r4(mean).alias("mean_deg")
    )


_FAN600 = S.with_("req", "dem", recursive=True, **{**_FAN_CTES, "tsrc": "SELECT tid AS id, lon, lat, tgt, sgn, 610.0::double AS len FROM want"})


@query(
    "gen5_fan_new_length",
    _FAN600
    + "SELECT request_id, count(*) AS n_proposals, max(n) AS max_points, round(avg(traced_m),4) AS mean_length FROM fan GROUP BY 1",
)
def gen5(spark, sf):
    f = N.generate_fan(X.requests(spark, sf).withColumn("length_m", F.lit(610.0)), *world(spark, sf))
    return f.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_proposals"),
        F.max(F.size("points")).alias("max_points"),
        r4(F.avg("length_m")).alias("mean_length"),
    )


@query(
    "agg17_fan_counts",
    FAN
    + "SELECT request_id, "
    + ",".join(f"sum(CASE WHEN target_difficulty='{d}' THEN 1 ELSE 0 END) AS {d}" for d in C.DIFFICULTIES)
    + " FROM fan GROUP BY 1",
)
def agg17(spark, sf):
    return (
        fan(spark, sf)
        .groupBy("request_id")
        .agg(*[F.count_if(c("target_difficulty") == d).alias(d) for d in C.DIFFICULTIES])
    )


@query(
    "srt2_fan_order",
    FAN + f"SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS place, {_NAME} AS sector_name FROM fan",
)
def srt2(spark, sf):
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("request_id").orderBy("ord"))
    return fan(spark, sf).select("request_id", place.cast("long").alias("place"), "sector_name")


@query(
    "srt3_closest_gradient",
    FAN + "SELECT request_id, arg_min(ord, abs(round(avg_slope_pct,6)-20.0)*1e6+ord/1000.0) AS best_ord, min(ord) AS default_ord FROM fan GROUP BY 1",
)
def srt3(spark, sf):
    """Best proposal for a wanted gradient of 20 % and the default (first) selection (SRT4)."""
    score = F.struct(F.abs(F.round("avg_slope_pct", 6) - 20.0), "ord")
    return (
        fan(spark, sf)
        .groupBy("request_id")
        .agg(F.min_by("ord", score).alias("best_ord"), F.min("ord").alias("default_ord"))
    )


@query(
    "srt4_default_selection",
    FAN + "SELECT r.request_id, min(f.ord) AS selected FROM req r LEFT JOIN fan f ON f.request_id=r.request_id GROUP BY 1",
)
def srt4(spark, sf):
    """First proposal of every request, none where the fan is empty."""
    first = fan(spark, sf).groupBy("request_id").agg(F.min("ord").alias("selected"))
    return X.requests(spark, sf).select("request_id").join(first, "request_id", "left")


@query(
    "agg19_proposal_summary",
    FAN + "SELECT request_id, ord, round(avg_slope_pct-tgt,4) AS off_target, round(traced_m,4) AS length_m, round(drop_m,4) AS drop_m FROM fan",
)
def agg19(spark, sf):
    return fan(spark, sf).select(
        "request_id",
        "ord",
        r4(c("avg_slope_pct") - c("target_slope_pct")).alias("off_target"),
        r4("length_m").alias("length_m"),
        r4("drop_m").alias("drop_m"),
    )
