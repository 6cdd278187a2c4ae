"""Column-function queries: geodesy, terrain rules, path metrics, validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions import geo, paths, rules, terrain
from terrapath.plans import sqlkit as S
from terrapath.plans.registry import query, r4, r7
from terrapath.sources import fixtures as X

c = F.col

# ---------------------------------------------------------------- geodesy


@query(
    "geo1_haversine",
    S.with_("tgt") + f"SELECT request_id, round({S.hav('lat','lon','target_lat','target_lon')},4) AS d_m FROM tgt",
)
def geo1(spark, sf):
    return X.targets(spark, sf).select(
        "request_id", r4(geo.haversine_m(c("lat"), c("lon"), c("target_lat"), c("target_lon"))).alias("d_m")
    )


@query(
    "geo2_initial_bearing",
    S.with_("tgt") + f"SELECT request_id, round({S.brg('lon','lat','target_lon','target_lat')},4) AS bearing FROM tgt",
)
def geo2(spark, sf):
    return X.targets(spark, sf).select(
        "request_id", r4(geo.bearing_deg(c("lon"), c("lat"), c("target_lon"), c("target_lat"))).alias("bearing")
    )


_B, _D = "((request_id*7)%360)::double", "(15.0::double*(request_id%40))"


@query(
    "geo3_destination",
    S.with_("req")
    + f"SELECT request_id, round({S.dest_lon('lon','lat',_B,_D)},7) AS to_lon, round({S.dest_lat('lon','lat',_B,_D)},7) AS to_lat FROM req",
)
def geo3(spark, sf):
    k = c("request_id")
    hit = geo.destination(c("lon"), c("lat"), ((k * 7) % 360).cast("double"), 15.0 * (k % 40).cast("double"))
    return (
        X.requests(spark, sf)
        .select("request_id", hit.alias("p"))
        .select("request_id", r7("p.lon").alias("to_lon"), r7("p.lat").alias("to_lat"))
    )


@query(
    "geo4_point_distance",
    S.with_("seg_step") + "SELECT n, seq, round(d,4) AS d_m FROM seg_step",
)
def geo4(spark, sf):
    steps = X.segments(spark, sf).select(
        (c("path_id") * 8 + c("seg_no") + 1).alias("n"),
        c("seg_no"),
        F.posexplode(F.concat(F.array(F.lit(0.0)), paths.step_lengths(c("points")))).alias("i", "d"),
    )
    return steps.select("n", (c("seg_no") * 10 + c("i")).alias("seq"), r4("d").alias("d_m"))


_T4 = "lon, lat, target_lon, target_lat"


@query(
    "geo5_compass",
    S.with_("tgt") + f"SELECT request_id, {S.compass(S.brg('lon','lat','target_lon','target_lat'))} AS dir FROM tgt",
)
def geo5(spark, sf):
    return X.targets(spark, sf).select(
        "request_id", geo.compass(geo.bearing_deg(c("lon"), c("lat"), c("target_lon"), c("target_lat"))).alias("dir")
    )


@query(
    "geo6_utm_zone",
    """SELECT c_custkey AS id, 'EPSG:'||(CASE WHEN la>=0 THEN '326' ELSE '327' END)||printf('%02d', cast(floor((lo+180)/6)+1 as int)) AS epsg
    FROM (SELECT c_custkey, (c_custkey*37)%360-180+0.25::double AS lo, (c_custkey*11)%160-80+0.5::double AS la FROM customer)""",
)
def geo6(spark, sf):
    k = c("c_custkey")
    lon, lat = ((k * 37) % 360 - 180).cast("double") + 0.25, ((k * 11) % 160 - 80).cast("double") + 0.5
    return X.table(spark, sf, "customer").select(k.alias("id"), geo.utm_code(lon, lat).alias("epsg"))


_TURN = """SELECT c_custkey AS id, a, CASE WHEN a>180 THEN a-360 WHEN a<-180 THEN a+360 ELSE a END AS w
    FROM (SELECT c_custkey, ((c_custkey*13)%721-360)::double AS a FROM customer)"""


@query("geo7_turn_clamp", f"SELECT id, w AS turn, greatest(-40.0,least(40.0,w)) AS clamped FROM ({_TURN})")
def geo7(spark, sf):
    a = ((c("c_custkey") * 13) % 721 - 360).cast("double")
    return X.table(spark, sf, "customer").select(
        c("c_custkey").alias("id"), geo.wrap_turn(a).alias("turn"), geo.clamp_turn(a).alias("clamped")
    )


@query(
    "geo8_circular_mean",
    "SELECT g AS id, round("
    + S.pmod("degrees(atan2(sum(sin(radians(b))),sum(cos(radians(b)))))")
    + ",4) AS mean_deg FROM (SELECT c_custkey AS g, unnest([(c_custkey*7)%360, (c_custkey*7+30)%360, (c_custkey*11)%360+0.5, (c_custkey*3)%90+1])::double AS b FROM customer) GROUP BY g",
)
def geo8(spark, sf):
    k = c("c_custkey")
    b = F.array((k * 7) % 360, (k * 7 + 30) % 360, (k * 11) % 360 + 0.5, (k * 3) % 90 + 1).cast("array<double>")
    return X.table(spark, sf, "customer").select(k.alias("id"), r4(geo.circular_mean_deg(b)).alias("mean_deg"))


_GEO9 = """SELECT *, degrees(atan2(sin(radians(b1))+sin(radians(b2)), cos(radians(b1))+cos(radians(b2)))) AS m0 FROM (
  SELECT c_custkey AS id, ((c_custkey*17)%360)::double AS tb, (c_custkey%31)::double AS s,
   ((c_custkey*17+20)%360)::double AS b1, ((c_custkey*17+35)%360)::double AS b2 FROM customer)"""


@query(
    "geo9_momentum_blend",
    "SELECT id, round(CASE WHEN s<15 THEN "
    + S.pmod(
        "m+(1.0-0.8::double*(1.0-s/15.0))*(CASE WHEN tb-m>180 THEN tb-m-360 WHEN tb-m<-180 THEN tb-m+360 ELSE tb-m END)"
    )
    + f" ELSE tb END,4) AS bearing FROM (SELECT *, {S.pmod('m0')} AS m FROM ({_GEO9}))",
)
def geo9(spark, sf):
    k = c("c_custkey")
    recent = F.array((k * 17 + 20) % 360, (k * 17 + 35) % 360).cast("array<double>")
    out = terrain.blend_momentum(((k * 17) % 360).cast("double"), recent, (k % 31).cast("double"))
    return X.table(spark, sf, "customer").select(k.alias("id"), r4(out).alias("bearing"))


@query(
    "geo11_raster_index",
    S.with_("req")
    + f"SELECT request_id, {S.row_of('lat')} AS row, {S.col_of('lon')} AS col, round(lon*3600,4) AS x_arcsec FROM req",
)
def geo11(spark, sf):
    m = X.dem_meta(spark, sf)
    return X.requests(spark, sf).select(
        "request_id",
        geo.raster_row(c("lat"), m.y0, m.dy).cast("long").alias("row"),
        geo.raster_col(c("lon"), m.x0, m.dx).cast("long").alias("col"),
        r4(geo.to_arcsec(c("lon"))).alias("x_arcsec"),
    )


@query(
    "geo12_coord_key",
    "SELECT c_custkey AS id, printf('%.6f', 10.002::double+0.00003::double*((7*c_custkey)%1700)+0.0000004::double) AS key FROM customer",
)
def geo12(spark, sf):
    return X.requests(spark, sf).select(c("request_id").alias("id"), geo.coord_key(c("lon") + 0.0000004).alias("key"))


# ---------------------------------------------------------------- terrain rules


@query(
    "ter5_classify",
    f"SELECT event_id, s, {S.cls('s')} AS difficulty FROM (SELECT event_id, CASE WHEN event_id%97=0 THEN 'nan'::double ELSE value-20 END AS s FROM events)",
)
def ter5(spark, sf):
    s = F.when(c("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(c("value") - 20)
    return X.table(spark, sf, "events").select("event_id", s.alias("s"), terrain.classify(s).alias("difficulty"))


@query(
    "ter6_lookups",
    f"SELECT event_id, {S.case_map(C.SLOPE_COLORS,'d')} AS color, {S.case_map(C.DIFFICULTY_EMOJI,'d')} AS emoji, "
    f"{S.case_map(C.LIFT_ICONS,'t')} AS icon, {S.case_map(C.LIFT_DISPLAY,'t')} AS display FROM (SELECT event_id, {S.cls('value')} AS d, "
    "(['surface_lift','chairlift','gondola','aerial_tram'])[event_id%4+1] AS t FROM events)",
)
def ter6(spark, sf):
    d = terrain.classify(c("value"))
    t = F.element_at(F.array(*[F.lit(x) for x in C.LIFT_TYPES]), (c("event_id") % 4 + 1).cast("int"))
    return X.table(spark, sf, "events").select(
        "event_id",
        terrain.slope_color(d).alias("color"),
        terrain.lookup(C.DIFFICULTY_EMOJI, d).alias("emoji"),
        terrain.lookup(C.LIFT_ICONS, t).alias("icon"),
        terrain.lookup(C.LIFT_DISPLAY, t).alias("display"),
    )


_TG = "SELECT event_id, (event_id%60)::double AS t, least(value,90.0)::double AS g FROM events"
_ANG = "CASE WHEN g>0 AND t<g THEN least(greatest(degrees(acos(greatest(-1.0,least(1.0,t/g)))),2.0),89.0) ELSE 2.0 END"


@query("ter7_traverse_angle", f"SELECT event_id, round({_ANG},4) AS angle FROM ({_TG})")
def ter7(spark, sf):
    t, g = (c("event_id") % 60).cast("double"), F.least(c("value"), F.lit(90.0))
    return X.table(spark, sf, "events").select("event_id", r4(terrain.traverse_angle(t, g)).alias("angle"))


@query("ter8_step_noise")
def ter8(spark, sf):
    """Hash-based noise: no SQL twin because the hash is the engine's own."""
    k = c("request_id")
    return X.requests(spark, sf).select(
        "request_id",
        F.explode(F.sequence(F.lit(1), F.lit(8))).alias("step"),
    ).select("request_id", "step", terrain.noise_deg(k, c("step"), (k % 90).cast("double"), 7).alias("noise_deg"))


@query(
    "ter9_effective_slope",
    "SELECT event_id, round(g*cos(radians(t)),4) AS effective, round(g*sin(radians(t)),4) AS cross_pct FROM (" + _TG + ")",
)
def ter9(spark, sf):
    t, g = (c("event_id") % 60).cast("double"), F.least(c("value"), F.lit(90.0))
    return X.table(spark, sf, "events").select(
        "event_id",
        r4(terrain.effective_slope(g, t)).alias("effective"),
        r4(terrain.cross_slope(g, t)).alias("cross_pct"),
    )


# ---------------------------------------------------------------- path metrics (bounded paths)


def seg_metrics(spark, sf):
    return paths.with_path_metrics(X.segments(spark, sf))


@query(
    "pth1_endpoints",
    S.with_("seg_sum")
    + "SELECT 'S'||n AS segment_id, round(start_lon,7) AS start_lon, round(start_lat,7) AS start_lat, round(end_lon,7) AS end_lon, round(end_lat,7) AS end_lat FROM seg_sum",
)
def pth1(spark, sf):
    s = X.segments(spark, sf).select(
        "segment_id", paths.first_point(c("points")).alias("a"), paths.last_point(c("points")).alias("b")
    )
    return s.select(
        "segment_id",
        *[r7(f"{p}.{k}").alias(f"{n}_{k}") for p, n in (("a", "start"), ("b", "end")) for k in ("lon", "lat")],
    )


@query("pth2_drop", S.with_("seg_sum") + "SELECT 'S'||n AS segment_id, round(drop_m,4) AS drop_m FROM seg_sum")
def pth2(spark, sf):
    return X.segments(spark, sf).select("segment_id", r4(paths.drop_m(c("points"))).alias("drop_m"))


@query("pth3_length", S.with_("seg_sum") + "SELECT 'S'||n AS segment_id, round(length_m,4) AS length_m FROM seg_sum")
def pth3(spark, sf):
    return X.segments(spark, sf).select("segment_id", r4(paths.length_m(c("points"))).alias("length_m"))


@query(
    "pth4_avg_slope",
    S.with_("seg") + "SELECT segment_id, round(avg_slope_pct,4) AS avg_slope_pct FROM seg",
)
def pth4(spark, sf):
    return X.segments(spark, sf).select(
        "segment_id",
        r4(paths.avg_slope_pct(paths.drop_m(c("points")), paths.length_m(c("points")))).alias("avg_slope_pct"),
    )


@query("pth5_difficulty", S.with_("seg") + "SELECT segment_id, round(max_slope_pct,4) AS max_slope_pct, difficulty FROM seg")
def pth5(spark, sf):
    return seg_metrics(spark, sf).select("segment_id", r4("max_slope_pct").alias("max_slope_pct"), "difficulty")


_LO = S.case_map({k: v[0] for k, v in C.BELT_WIDTH_M.items()}, "difficulty") + "::double"
_HI = S.case_map({k: v[1] for k, v in C.BELT_WIDTH_M.items()}, "difficulty") + "::double"
WIDTH = f"(CASE WHEN abs(side)<1 THEN {_HI} ELSE greatest({_LO},least({_HI},500.0::double/abs(side))) END)"


@query("pth6_belt_width", S.with_("seg") + f"SELECT segment_id, round({WIDTH},4) AS width_m FROM seg")
def pth6(spark, sf):
    return seg_metrics(spark, sf).select(
        "segment_id", r4(paths.belt_width_m(c("side_slope_pct"), c("difficulty"))).alias("width_m")
    )


EXC = f"abs(side) > 500.0/{_LO}"
WARN_N = f"(CASE WHEN {EXC} THEN 1 ELSE 0 END + CASE WHEN avg_slope_pct>=70 THEN 1 ELSE 0 END + CASE WHEN avg_slope_pct<5 THEN 1 ELSE 0 END)"
_MSG_X = (
    f"CASE WHEN {EXC} THEN printf('🚜 Excavator Warning: %.1fm vertical side cut required across %.0fm piste width. "
    f"Cross-slope %.0f%% (terrain leans %s)', round_even(abs(side)*{WIDTH}/200,1), round_even({WIDTH},0), round_even(abs(side),0), side_dir) END"
)
_MSG_S = "CASE WHEN avg_slope_pct>=70 THEN printf('⚠️ Too Steep Warning: Gradient %.0f%% exceeds maximum safe slope of 70%% - may require terrain modification', round_even(avg_slope_pct,0)) END"
_MSG_F = "CASE WHEN avg_slope_pct<5 THEN printf('📐 Too Flat Warning: Gradient %.0f%% is below minimum skiable slope of 5%% - skiers may need to push', round_even(avg_slope_pct,0)) END"


@query(
    "pth7_warnings",
    S.with_("seg")
    + f"SELECT segment_id, {WARN_N}>0 AS has_warnings, {WARN_N} AS n_warnings, concat_ws(' | ', {_MSG_X}, {_MSG_S}, {_MSG_F}) AS messages FROM seg",
)
def pth7(spark, sf):
    w = seg_metrics(spark, sf).select(
        "segment_id",
        paths.warnings(c("avg_slope_pct"), c("side_slope_pct"), c("side_slope_dir"), c("difficulty")).alias("w"),
    )
    return w.select(
        "segment_id",
        (F.size("w") > 0).alias("has_warnings"),
        F.size("w").alias("n_warnings"),
        F.array_join(F.transform("w", lambda x: x["message"]), " | ").alias("messages"),
    )


@query(
    "pth8_vertical_cut",
    S.with_("seg") + f"SELECT segment_id, round(abs(side)*{WIDTH}/200,4) AS cut_m FROM seg",
)
def pth8(spark, sf):
    return seg_metrics(spark, sf).select(
        "segment_id",
        r4(
            paths.vertical_cut_m(c("side_slope_pct"), paths.belt_width_m(c("side_slope_pct"), c("difficulty")))
        ).alias("cut_m"),
    )


@query("pth9_belt_polygon")
def pth9(spark, sf):
    """Ribbon ring per segment; checked by its area in the tests (re-aimed geometry, no SQL twin)."""
    s = seg_metrics(spark, sf)
    return s.select(
        "segment_id",
        paths.belt_polygon(c("points"), paths.belt_width_m(c("side_slope_pct"), c("difficulty"))).alias("ring"),
    )


_NAME_S = (
    "printf('%d (%s %s %s%s)', num, "
    + "(CASE d "
    + " ".join(f"WHEN '{d}' THEN {S.pick(S.words(C.SLOPE_PREFIXES[d]), 'num')}" for d in C.DIFFICULTIES)
    + f" END), {S.compass('b')}, CASE WHEN dz>500 THEN 'Summit ' WHEN dz>300 THEN 'Big ' ELSE '' END, {S.pick(S.words(C.SLOPE_SUFFIXES),'num')})"
)


@query(
    "pth10_slope_name",
    f"SELECT num, {_NAME_S} AS name FROM (SELECT event_id+1 AS num, {S.cls('value')} AS d, ((event_id*17)%360)::double AS b, (event_id%700)::double AS dz FROM events)",
)
def pth10(spark, sf):
    k = c("event_id")
    return X.table(spark, sf, "events").select(
        (k + 1).alias("num"),
        paths.slope_name(
            terrain.classify(c("value")), k + 1, (k % 700).cast("double"), F.lit(0.0), ((k * 17) % 360).cast("double")
        ).alias("name"),
    )


_NAME_L = (
    "printf('%d (%s%s %s %s%s)', num, CASE WHEN rise>500 THEN '' WHEN len<500 THEN "
    + S.pick(S.words(C.LENGTH_WORDS["short"]), "num")
    + "||' ' WHEN len>1500 THEN "
    + S.pick(S.words(C.LENGTH_WORDS["long"]), "num")
    + "||' ' ELSE '' END, (CASE t "
    + " ".join(f"WHEN '{t}' THEN {S.pick(S.words(C.LIFT_PREFIXES[t]), 'num')}" for t in C.LIFT_TYPES)
    + f" END), {S.compass('b')}, CASE WHEN rise>500 THEN 'Summit ' ELSE '' END, (CASE t "
    + " ".join(f"WHEN '{t}' THEN {S.pick(S.words(C.LIFT_SUFFIXES[t]), 'num')}" for t in C.LIFT_TYPES)
    + " END))"
)


@query(
    "pth11_lift_name",
    S.with_("lift")
    + f"SELECT num, {_NAME_L} AS name FROM (SELECT lift_no+1 AS num, lift_type AS t, {S.hav('start_lat','start_lon','end_lat','end_lon')} AS len, end_elevation-start_elevation AS rise, {S.brg('end_lon','end_lat','start_lon','start_lat')} AS b FROM lift)",
)
def pth11(spark, sf):
    e = X.lift_ends(spark, sf)
    return e.select(
        (c("lift_no") + 1).alias("num"),
        paths.lift_name(
            c("lift_type"),
            paths.id_number(c("lift_id"), "lift"),
            geo.haversine_m(c("start_lat"), c("start_lon"), c("end_lat"), c("end_lon")),
            c("end_elevation") - c("start_elevation"),
            geo.bearing_deg(c("end_lon"), c("end_lat"), c("start_lon"), c("start_lat")),
        ).alias("name"),
    )


@query(
    "pth12_number_from_id",
    "SELECT 'SL'||(event_id+1) AS slope_id, event_id+1 AS slope_no, 'L'||(user_id+1) AS lift_id, user_id+1 AS lift_no FROM events",
)
def pth12(spark, sf):
    e = X.table(spark, sf, "events").select(
        F.concat(F.lit("SL"), c("event_id") + 1).alias("slope_id"), F.concat(F.lit("L"), c("user_id") + 1).alias("lift_id")
    )
    return e.select(
        "slope_id",
        paths.id_number(c("slope_id"), "slope").alias("slope_no"),
        "lift_id",
        paths.id_number(c("lift_id"), "lift").alias("lift_no"),
    )


_INIT = "upper({0}[1])||{0}[2:]"


@query(
    "pth13_grade_name",
    "SELECT event_id, "
    + f"{_INIT.format('d')}||' '||{_INIT.format('sd')}||' ('||{_INIT.format('g')}||')' AS name FROM (SELECT event_id, {S.cls('value')} AS d, (['left','right','center'])[event_id%3+1] AS sd, (['gentle','steep'])[event_id%2+1] AS g FROM events)",
)
def pth13(spark, sf):
    k = c("event_id")
    side = F.element_at(F.array(*map(F.lit, ("left", "right", "center"))), (k % 3 + 1).cast("int"))
    grade = F.element_at(F.array(*map(F.lit, ("gentle", "steep"))), (k % 2 + 1).cast("int"))
    return X.table(spark, sf, "events").select(
        "event_id", paths.grade_name(terrain.classify(c("value")), side, grade).alias("name")
    )


# ---------------------------------------------------------------- validators

_VAL1 = "CASE WHEN e<=s THEN printf('Lift Must Go Uphill — %.0fm → %.0fm (%+.0fm)', round_even(s,0), round_even(e,0), round_even(e-s,0)) END"


@query(
    "val1_lift_uphill",
    S.with_("lift") + f"SELECT lift_id, {_VAL1} AS reason FROM (SELECT lift_id, start_elevation AS s, end_elevation AS e FROM lift)",
)
def val1(spark, sf):
    return X.lift_ends(spark, sf).select(
        "lift_id", rules.lift_uphill(c("start_elevation"), c("end_elevation"))["text"].alias("reason")
    )


@query(
    "val2_lift_nodes_differ",
    "SELECT event_id, CASE WHEN user_id%10=event_id%10 THEN 'same_node' END AS reason FROM events",
)
def val2(spark, sf):
    n = lambda k: F.concat(F.lit("N"), c(k) % 10)
    return X.table(spark, sf, "events").select(
        "event_id", rules.lift_nodes_differ(n("user_id"), n("event_id"))["code"].alias("reason")
    )


_V3 = "SELECT event_id, value AS s, (event_id%60)::double AS t FROM events"


@query(
    "val3_target_downhill",
    f"SELECT event_id, CASE WHEN s-t<5 THEN printf('Not Downhill Enough — drop: %.0fm, need: 5m', round_even(s-t,0)) END AS reason FROM ({_V3})",
)
def val3(spark, sf):
    return X.table(spark, sf, "events").select(
        "event_id", rules.target_downhill(c("value"), (c("event_id") % 60).cast("double"))["text"].alias("reason")
    )


@query(
    "val4_target_distance",
    S.with_("tgt")
    + f"SELECT request_id, CASE WHEN d>1000 THEN printf('Target Too Far — %.0fm (max: 1000m)', round_even(d,0)) END AS reason FROM (SELECT request_id, {S.hav('lat','lon','target_lat-0.004','target_lon')} AS d FROM tgt)",
)
def val4(spark, sf):
    return X.targets(spark, sf).select(
        "request_id",
        rules.target_distance(c("lat"), c("lon"), c("target_lat") - 0.004, c("target_lon"))["text"].alias("reason"),
    )


@query(
    "val5_point_valid",
    "SELECT path_id, count(*) AS n, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS n_valid FROM (SELECT event_id//64 AS path_id, event_id%31<>0 AS ok FROM events) GROUP BY 1",
)
def val5(spark, sf):
    z = F.when(c("event_id") % 62 == 0, F.lit(float("nan"))).when(c("event_id") % 31 != 0, c("value"))
    return (
        X.table(spark, sf, "events")
        .select(F.floor(c("event_id") / 64).alias("path_id"), rules.point_valid(z).alias("ok"))
        .groupBy("path_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_valid"))
    )


@query(
    "val6_lift_valid",
    "SELECT c_custkey AS id, CASE WHEN c_custkey%5=4 THEN 'lift_type' WHEN c_custkey%7<2 THEN 'terrain_points' WHEN c_custkey%11<2 THEN 'cable_points' END AS code FROM customer",
)
def val6(spark, sf):
    k = c("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, [*C.LIFT_TYPES, "zipline"])), (k % 5 + 1).cast("int"))
    rep = lambda m: F.array_repeat(F.lit(1.0), (k % m).cast("int"))
    return X.table(spark, sf, "customer").select(
        k.alias("id"), rules.lift_valid(kind, rep(7), rep(11))["code"].alias("code")
    )


@query(
    "val7_commit_points",
    "SELECT c_custkey AS id, (['skip','reject','commit'])[least(c_custkey%5,2)+1] AS action FROM customer",
)
def val7(spark, sf):
    size = F.size(F.array_repeat(F.lit(1.0), (c("c_custkey") % 5).cast("int")))
    action = F.when(size == 0, "skip").when(size < 2, "reject").otherwise("commit")
    return X.table(spark, sf, "customer").select(c("c_custkey").alias("id"), action.alias("action"))


@query(
    "val9_plan_ready",
    S.with_("tgt", "dem")
    + f"""SELECT request_id, coalesce(za-zb>0 AND {S.hav('lat','lon','target_lat','target_lon')}>=30, false) AS ready FROM (
     SELECT t.*, a.elevation AS za, b.elevation AS zb FROM tgt t LEFT JOIN dem a ON a.row={S.row_of('t.lat')} AND a.col={S.col_of('t.lon')}
     LEFT JOIN dem b ON b.row={S.row_of('t.target_lat')} AND b.col={S.col_of('t.target_lon')})""",
)
def val9(spark, sf):
    from terrapath.sources import dem as D

    cells, m = X.dem_cells(spark, sf), X.dem_meta(spark, sf)
    t = D.lookup_elevation(X.targets(spark, sf), cells, m, out="za")
    t = D.lookup_elevation(t, cells, m, "target_lon", "target_lat", "zb")
    d = geo.haversine_m(c("lat"), c("lon"), c("target_lat"), c("target_lon"))
    return t.select("request_id", F.coalesce(rules.plan_ready(c("za"), c("zb"), d), F.lit(False)).alias("ready"))


@query(
    "val10_outside_terrain",
    S.with_("req", "dem")
    + f"SELECT request_id, CASE WHEN d.elevation IS NULL THEN printf('Outside Terrain — Point (%.4f, %.4f) has no elevation data.', round(lat,4), round(lon,4)) END AS reason FROM req r LEFT JOIN dem d ON d.row={S.row_of('r.lat')} AND d.col={S.col_of('r.lon')}",
)
def val10(spark, sf):
    from terrapath.sources import dem as D

    p = D.lookup_elevation(X.requests(spark, sf), X.dem_cells(spark, sf), X.dem_meta(spark, sf))
    return p.select("request_id", rules.outside_terrain(c("lat"), c("lon"), c("elevation"))["text"].alias("reason"))
