"""Raster and row-form path queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions import terrain
from terrapath.operators import profile as P
from terrapath.operators.scan import running_total
from terrapath.plans import sqlkit as S
from terrapath.plans.registry import query, r4, r7
from terrapath.sources import dem as D
from terrapath.sources import fixtures as X
from terrapath.sources import lookups as LK

c = F.col

# ---------------------------------------------------------------- raster


@query(
    "src1_dem_load",
    S.with_("dem_raw", "dem")
    + "SELECT r.row, r.col, round(r.elevation,4) AS raw, round(d.elevation,4) AS elevation FROM dem_raw r JOIN dem d USING (row,col)",
)
def src1(spark, sf):
    raw = X.dem_raw(spark, sf)
    return D.clean_nodata(raw.withColumn("raw", c("elevation")), -9999.0).select(
        "row", c("col").cast("long").alias("col"), r4("raw").alias("raw"), r4("elevation").alias("elevation")
    )


@query(
    "src2_dem_bounds",
    f"SELECT round(10.0::double,7) AS west, round({S.SOUTH},7) AS south, round({S.EAST},7) AS east, round(47.0::double,7) AS north",
)
def src2(spark, sf):
    """Extent derived from the cells themselves (min/max of cell edges)."""
    m = X.dem_meta(spark, sf)
    return (
        X.dem_cells(spark, sf)
        .agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
        .select(
            r7(m.x0 + c("c0") * m.dx).alias("west"),
            r7(m.y0 - (c("r1") + 1) * m.dy).alias("south"),
            r7(m.x0 + (c("c1") + 1) * m.dx).alias("east"),
            r7(m.y0 - c("r0") * m.dy).alias("north"),
        )
    )


_BOX = (10.01, 46.85, 10.04, 46.95)


@query(
    "src3_dem_crop",
    S.with_("dem")
    + "SELECT row, col, round(elevation,4) AS elevation FROM dem WHERE row BETWEEN trunc((47.0::double-46.95::double)/0.00054::double) AND trunc((47.0::double-46.85::double)/0.00054::double) AND col BETWEEN trunc((10.01::double-10.0::double)/0.0008::double) AND trunc((10.04::double-10.0::double)/0.0008::double)",
)
def src3(spark, sf):
    return D.crop(X.dem_cells(spark, sf), X.dem_meta(spark, sf), _BOX).select(
        "row", c("col").cast("long").alias("col"), r4("elevation").alias("elevation")
    )


@query(
    "src6_lookup_tables",
    "SELECT * FROM (VALUES "
    + ",".join(
        f"({o},'{d}','{g}',{t}::double,{C.BELT_WIDTH_M[d][0]}::double,{C.BELT_WIDTH_M[d][1]}::double,(SELECT count(*) FROM events WHERE value>={t}))"
        for o, d, g, t in C.GRADE_TARGETS
    )
    + ") t(ord,difficulty,grade,target_pct,belt_min,belt_max,n_at_least)",
)
def src6(spark, sf):
    """Grade table as a broadcast dimension next to the number of readings that reach each target."""
    grades = F.array(
        *[
            F.struct(
                F.lit(o).alias("ord"),
                F.lit(d).alias("difficulty"),
                F.lit(g).alias("grade"),
                F.lit(t).alias("target_pct"),
                F.lit(C.BELT_WIDTH_M[d][0]).alias("belt_min"),
                F.lit(C.BELT_WIDTH_M[d][1]).alias("belt_max"),
            )
            for o, d, g, t in C.GRADE_TARGETS
        ]
    )
    hits = X.table(spark, sf, "events").agg(
        F.array(*[F.count_if(c("value") >= t) for *_, t in C.GRADE_TARGETS]).alias("n")
    )
    return hits.select(F.posexplode(grades).alias("i", "g"), "n").select(
        "g.*", F.element_at("n", c("i") + 1).alias("n_at_least")
    )


def _values(rows: list[tuple]) -> str:
    def cell(v: object) -> str:
        if v is None:
            return "NULL::double"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::double" if isinstance(v, float) else f"{v}"

    return "(VALUES " + ",".join("(" + ",".join(map(cell, r)) + ")" for r in rows) + ")"


@query(
    "src6_pylon_config",
    S.with_("lift")
    + f"""SELECT l.resort_id, l.lift_type, count(*) AS n_lifts, p.hi AS pylon_height_m, p.st AS station_height_m, p.mn AS min_spacing_m, p.mx AS max_spacing_m,
    p.cl AS min_clearance_m, p.sag AS sag_factor, k.color, k.icon FROM lift l JOIN {_values(LK.pylon_rows())} p(t,hi,st,mn,mx,cl,sag) ON p.t=l.lift_type
    JOIN {_values(LK.color_rows())} k(entity,kind,color,icon) ON k.entity='lift' AND k.kind=l.lift_type GROUP BY ALL""",
)
def src6_pylons(spark, sf):
    """Pylon configuration and colour of the lift types of every resort; lifts are counted before the tables are met."""
    kinds = X.lift_ends(spark, sf).groupBy("resort_id", "lift_type").agg(F.count("*").alias("n_lifts"))
    color = LK.colors(spark).where("entity = 'lift'").select(c("kind").alias("lift_type"), "color", "icon")
    return kinds.join(F.broadcast(LK.pylons(spark)), "lift_type").join(F.broadcast(color), "lift_type")


@query(
    "src6_threshold_names",
    f"""SELECT t.difficulty, t.floor_pct, t.below_pct, k.color, k.icon, w.part, w.ord, w.word, g.n AS n_readings
    FROM {_values(LK.threshold_rows())} t(difficulty,floor_pct,below_pct)
    JOIN (SELECT d, count(*) AS n FROM (SELECT CASE WHEN value>=40 THEN 'black' WHEN value>=25 THEN 'red' WHEN value>=15 THEN 'blue' WHEN value>=0 THEN 'green' END AS d FROM events) GROUP BY d) g ON g.d=t.difficulty
    JOIN {_values(LK.color_rows())} k(entity,kind,color,icon) ON k.entity='slope' AND k.kind=t.difficulty
    JOIN {_values(LK.name_rows())} w(entity,kind,part,ord,word) ON w.entity='slope' AND w.kind=t.difficulty""",
)
def src6_thresholds(spark, sf):
    """Thresholds, colours and name parts of the difficulties that readings reach."""
    level = F.lit(None)
    for difficulty, floor, _ in LK.threshold_rows():
        level = F.when(c("value") >= floor, difficulty).otherwise(level)
    hits = X.table(spark, sf, "events").groupBy(level.alias("difficulty")).agg(F.count("*").alias("n_readings"))
    hits = hits.join(F.broadcast(LK.thresholds(spark)), "difficulty")
    color = LK.colors(spark).where("entity = 'slope'").select(c("kind").alias("difficulty"), "color", "icon")
    word = LK.names(spark).where("entity = 'slope'").select(c("kind").alias("difficulty"), "part", "ord", "word")
    return hits.join(F.broadcast(color), "difficulty").join(F.broadcast(word), "difficulty")


@query(
    "join1_point_cell",
    S.with_("req", "dem")
    + f"SELECT request_id, d.row, d.col, round(d.elevation,4) AS elevation FROM req r JOIN dem d ON d.row={S.row_of('r.lat')} AND d.col={S.col_of('r.lon')}",
)
def join1(spark, sf):
    m = X.dem_meta(spark, sf)
    row, col = D.cell_index(m, c("lon"), c("lat"))
    return (
        X.requests(spark, sf)
        .select("request_id", row.alias("row"), col.alias("col"))
        .join(X.dem_cells(spark, sf), ["row", "col"])
        .select("request_id", "row", c("col").cast("long").alias("col"), r4("elevation").alias("elevation"))
    )


@query(
    "ter1_elevation",
    S.with_("req", "dem")
    + f"SELECT request_id, round(d.elevation,4) AS elevation FROM req r LEFT JOIN dem d ON d.row={S.row_of('r.lat')} AND d.col={S.col_of('r.lon')}",
)
def ter1(spark, sf):
    return D.lookup_elevation(X.requests(spark, sf), X.dem_cells(spark, sf), X.dem_meta(spark, sf)).select(
        "request_id", r4("elevation").alias("elevation")
    )


def gradient_ctes(src: str) -> dict[str, str]:
    """Gradient of the points in CTE ``src`` (columns id, lon, lat) as CTEs ending in ``grad``."""
    angles = ",".join(str(int(b)) for b in C.RING_BEARINGS)
    return {
        "ring": f"SELECT unnest([{angles}])::double AS b, r, w FROM (VALUES (15.0::double,2.0::double),(30.0::double,1.0::double)) t(r,w)",
        "ctr": f"SELECT p.id, p.lon, p.lat, d.elevation AS z0 FROM {src} p LEFT JOIN dem d ON d.row={S.row_of('p.lat')} AND d.col={S.col_of('p.lon')}",
        "smp": f"SELECT id, z0, b, r, w, {S.dest_lon('lon', 'lat', 'b', 'r')} AS slon, {S.dest_lat('lon', 'lat', 'b', 'r')} AS slat FROM ctr, ring",
        "smz": f"SELECT s.*, (z0-d.elevation)/r*100*w AS k FROM smp s JOIN dem d ON d.row={S.row_of('s.slat')} AND d.col={S.col_of('s.slon')} WHERE {S.inside('s.slon', 's.slat')} AND d.elevation IS NOT NULL AND z0 IS NOT NULL",
        "gxy": "SELECT id, sum(k*sin(radians(b)))/sum(w) AS gx, sum(k*cos(radians(b)))/sum(w) AS gy FROM smz GROUP BY id",
        "grad": f"SELECT c.id, c.lon, c.lat, c.z0 AS elevation, coalesce(gx,0.0) AS gx, coalesce(gy,0.0) AS gy, coalesce(sqrt(gx*gx+gy*gy),0.0) AS slope_pct, coalesce({S.pmod('degrees(atan2(gx,gy))+360.0')},0.0) AS bearing_deg FROM ctr c LEFT JOIN gxy g ON c.id=g.id",
    }


_REQ_GRAD = S.with_("req", "dem", src="SELECT request_id AS id, lon, lat FROM req", **gradient_ctes("src"))


def request_gradient(spark, sf):
    return D.gradient(X.requests(spark, sf), X.dem_cells(spark, sf), X.dem_meta(spark, sf), "request_id")


@query(
    "ter2_gradient",
    _REQ_GRAD + "SELECT id AS request_id, round(slope_pct,4) AS slope_pct, round(bearing_deg,4) AS bearing_deg FROM grad",
)
def ter2(spark, sf):
    return request_gradient(spark, sf).select(
        "request_id", r4("slope_pct").alias("slope_pct"), r4("bearing_deg").alias("bearing_deg")
    )


@query(
    "ter2_gradient_all_cells",
    S.with_(
        "dem",
        src="SELECT row*64+col AS id, 10.0::double+(col+0.15::double)*0.0008::double AS lon, 47.0::double-(row+0.2::double)*0.00054::double AS lat FROM dem",
        **gradient_ctes("src"),
    )
    + f"SELECT {S.cls('slope_pct')} AS difficulty, count(*) AS n_cells, round(avg(slope_pct),4) AS mean_slope FROM grad GROUP BY 1",
)
def ter2_all(spark, sf):
    """Slope class of every raster cell: the whole-raster scale test."""
    cells, m = X.dem_cells(spark, sf), X.dem_meta(spark, sf)
    centres = X.dem_cells(spark, sf, wide=True).select(
        (c("row") * m.n_cols + c("col")).alias("id"),
        (m.x0 + (c("col") + 0.15) * m.dx).alias("lon"),
        (m.y0 - (c("row") + 0.2) * m.dy).alias("lat"),
    )
    g = D.gradient(centres, cells, m, "id")
    return g.groupBy(terrain.classify(c("slope_pct")).alias("difficulty")).agg(
        F.count(F.lit(1)).alias("n_cells"), r4(F.avg("slope_pct")).alias("mean_slope")
    )


@query("agg16_weighted_mean", _REQ_GRAD + "SELECT id AS request_id, round(gx,4) AS grad_east, round(gy,4) AS grad_north FROM grad")
def agg16(spark, sf):
    g = request_gradient(spark, sf)
    b = F.radians("bearing_deg")
    return g.select(
        "request_id",
        (F.round(c("slope_pct") * F.sin(b), 4) + 0.0).alias("grad_east"),
        (F.round(c("slope_pct") * F.cos(b), 4) + 0.0).alias("grad_north"),
    )


@query(
    "ter3_orientation",
    _REQ_GRAD
    + "SELECT id AS request_id, "
    + ", ".join(
        f"CASE WHEN slope_pct>=5 THEN round({e},4) END AS {n}"
        for n, e in (
            ("fall_line", "bearing_deg"),
            ("contour_left", S.pmod("bearing_deg-90")),
            ("contour_right", S.pmod("bearing_deg+90")),
            ("half_left", S.pmod("bearing_deg-45")),
            ("half_right", S.pmod("bearing_deg+45")),
        )
    )
    + f", CASE WHEN slope_pct>=5 THEN {S.case_map(C.SLOPE_COLORS, S.cls('slope_pct'))} END AS color FROM grad",
)
def ter3(spark, sf):
    o = request_gradient(spark, sf).select(
        "request_id", terrain.orientation(c("slope_pct"), c("bearing_deg")).alias("o")
    )
    return o.select(
        "request_id",
        r4("o.fall_line").alias("fall_line"),
        r4("o.contour_left").alias("contour_left"),
        r4("o.contour_right").alias("contour_right"),
        r4("o.half_slope_left").alias("half_left"),
        r4("o.half_slope_right").alias("half_right"),
        c("o.difficulty_color").alias("color"),
    )


_SIDE = f"CASE WHEN slope_pct<0.5 THEN 0.0 ELSE slope_pct*sin(radians(bearing_deg-{S.brg('t.lon','t.lat','t.target_lon','t.target_lat')})) END"


@query(
    "ter4_side_slope",
    S.with_("tgt", "dem", src="SELECT request_id AS id, lon, lat FROM tgt", **gradient_ctes("src"))
    + f"SELECT request_id, round(v,4) AS side_pct, CASE WHEN abs(v)<2 THEN 'flat' WHEN v>0 THEN 'right' ELSE 'left' END AS direction FROM (SELECT request_id, {_SIDE} AS v FROM grad g JOIN tgt t ON g.id=t.request_id)",
)
def ter4(spark, sf):
    t = X.targets(spark, sf)
    g = request_gradient(spark, sf).join(t, "request_id")
    s = terrain.side_slope(c("slope_pct"), c("bearing_deg"), c("lon"), c("lat"), c("target_lon"), c("target_lat"))
    return g.select("request_id", s.alias("s")).select(
        "request_id", r4("s.slope_pct").alias("side_pct"), c("s.direction").alias("direction")
    )


# ---------------------------------------------------------------- row-form paths

TRK = {
    "stp": f"SELECT *, coalesce({S.hav('plat','plon','lat','lon')},0.0) AS d, coalesce(pz-elevation,0.0) AS dz FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(elevation) OVER w AS pz FROM tracks WINDOW w AS (PARTITION BY path_id ORDER BY seq))",
    "cumd": "SELECT *, sum(d) OVER (PARTITION BY path_id ORDER BY seq) AS cum FROM stp",
}


@query(
    "win1_cumulative_distance",
    S.with_("tracks", **TRK) + "SELECT path_id, seq, round(cum,4) AS cum_m, round(elevation,4) AS elevation FROM cumd",
)
def win1(spark, sf):
    return P.with_distance(X.tracks(spark, sf), "path_id").select(
        "path_id", "seq", r4("cum_m").alias("cum_m"), r4("elevation").alias("elevation")
    )


_WIN2 = S.with_(
    "tracks",
    **TRK,
    tot="SELECT path_id, max(cum) AS length_m, arg_min(elevation,seq)-arg_max(elevation,seq) AS drop_m FROM cumd GROUP BY 1",
    endp="SELECT a.path_id, a.seq, a.cum AS c0, a.elevation AS z0, max(b.seq) AS e FROM cumd a JOIN cumd b ON a.path_id=b.path_id AND b.seq>a.seq AND b.cum<=a.cum+300 GROUP BY ALL",
    sec="SELECT p.path_id, max(abs((z0-b.elevation)/(b.cum-c0))*100) AS best FROM endp p JOIN cumd b ON b.path_id=p.path_id AND b.seq=p.e JOIN tot t ON t.path_id=p.path_id WHERE b.cum>c0 AND t.length_m>c0+300 GROUP BY 1",
    win=f"SELECT *, {S.cls('max_slope_pct')} AS difficulty FROM (SELECT t.*, CASE WHEN length_m>0 THEN drop_m/length_m*100 ELSE 0.0 END AS avg_slope_pct, CASE WHEN length_m>=300 THEN greatest(drop_m/length_m*100,coalesce(best,-1e300)) WHEN length_m>0 THEN drop_m/length_m*100 ELSE 0.0 END AS max_slope_pct FROM tot t LEFT JOIN sec s ON t.path_id=s.path_id)",
)


def track_grades(spark, sf):
    return P.steepest_sections(P.with_distance(X.tracks(spark, sf), "path_id"), "path_id")


@query(
    "win2_steepest_section",
    _WIN2
    + "SELECT path_id, round(length_m,4) AS length_m, round(drop_m,4) AS drop_m, round(avg_slope_pct,4) AS avg_slope_pct, round(max_slope_pct,4) AS max_slope_pct, difficulty FROM win",
)
def win2(spark, sf):
    return track_grades(spark, sf).select(
        "path_id",
        *[r4(n).alias(n) for n in ("length_m", "drop_m", "avg_slope_pct", "max_slope_pct")],
        "difficulty",
    )


@query(
    "win2_length_by_difficulty",
    _WIN2 + "SELECT difficulty, count(*) AS runs, round(sum(length_m)/1000,4) AS km FROM win GROUP BY 1",
)
def win2_agg(spark, sf):
    """First end-to-end slice: tracks -> distance -> rolling steepness -> class totals."""
    return (
        track_grades(spark, sf)
        .groupBy("difficulty")
        .agg(F.count(F.lit(1)).alias("runs"), r4(F.sum("length_m") / 1000).alias("km"))
    )


@query(
    "win3_first_last",
    S.with_("tracks")
    + "SELECT path_id, round(arg_min(elevation,seq),4) AS first_elevation, round(arg_max(elevation,seq),4) AS last_elevation FROM tracks GROUP BY 1",
)
def win3(spark, sf):
    return (
        X.tracks(spark, sf)
        .groupBy("path_id")
        .agg(
            r4(F.min_by("elevation", "seq")).alias("first_elevation"),
            r4(F.max_by("elevation", "seq")).alias("last_elevation"),
        )
    )


@query(
    "win4_row_positions",
    S.with_("slope_seg") + "SELECT slope_id, segment_id, pos+1 AS label FROM slope_seg",
)
def win4(spark, sf):
    return X.slopes(spark, sf).select("slope_id", F.posexplode("segment_ids").alias("pos", "segment_id")).select(
        "slope_id", "segment_id", (c("pos") + 1).cast("long").alias("label")
    )


@query(
    "win5_consecutive_difference",
    S.with_("tracks", **TRK)
    + "SELECT path_id, seq, round(d,4) AS step_m, round(dz,4) AS step_drop_m, CASE WHEN d>0 THEN round(dz/d*100,4) END AS step_slope FROM stp",
)
def win5(spark, sf):
    s = P.with_steps(X.tracks(spark, sf), "path_id")
    return s.select(
        "path_id",
        "seq",
        r4("step_m").alias("step_m"),
        r4("step_drop_m").alias("step_drop_m"),
        F.when(c("step_m") > 0, r4(c("step_drop_m") / c("step_m") * 100.0)).alias("step_slope"),
    )


@query(
    "snk10_profile_table",
    S.with_("tracks", **TRK)
    + "SELECT path_id, seq, round(cum,4) AS x_m, round(elevation,4) AS y_m, round(min(elevation) OVER (PARTITION BY path_id),4) AS floor_m FROM cumd",
)
def snk10(spark, sf):
    """Distance x elevation rows; the per-path minimum comes from an aggregate, not a whole-path window."""
    pts = X.tracks(spark, sf)
    low = pts.groupBy("path_id").agg(F.min("elevation").alias("floor_m"))
    return (
        P.with_distance(pts, "path_id")
        .join(low, "path_id")
        .select("path_id", "seq", r4("cum_m").alias("x_m"), r4("elevation").alias("y_m"), r4("floor_m").alias("floor_m"))
    )


@query(
    "snk12_gradient_strip",
    S.with_("tracks", **TRK)
    + f"SELECT path_id, seq, round(cum-d,4) AS x0_m, round(cum,4) AS x1_m, round(dz/d*100,4) AS slope, {S.cls('dz/d*100')} AS difficulty, {S.case_map(C.SLOPE_COLORS, S.cls('dz/d*100'))} AS color FROM cumd WHERE d>0",
)
def snk12(spark, sf):
    g = P.gradient_strip(X.tracks(spark, sf), "path_id")
    return g.select(
        "path_id",
        "seq",
        r4(c("cum_m") - c("step_m")).alias("x0_m"),
        r4("cum_m").alias("x1_m"),
        r4("step_slope_pct").alias("slope"),
        "difficulty",
        terrain.slope_color(c("difficulty")).alias("color"),
    )


@query(
    "win7_id_assignment",
    "SELECT resort_id, event_id, 'S'||(100+row_number() OVER (PARTITION BY resort_id ORDER BY event_id)) AS segment_id FROM (SELECT event_id, "
    + S.RESORT.format(p="(event_id//64)")
    + " AS resort_id FROM events)",
)
def win7(spark, sf):
    """Next ids after a counter of 100, dense per resort even where one resort holds a third of the rows."""
    e = X.table(spark, sf, "events").select(
        X.resort_of(F.floor(c("event_id") / 64)).alias("resort_id"), "event_id"
    )
    n = running_total(e, ["resort_id"], "event_id", {"n": F.lit(1)})
    return n.select("resort_id", "event_id", F.concat(F.lit("S"), c("n") + 100).alias("segment_id"))


@query(
    "win9_resample_positions",
    S.with_("tracks", **TRK, tot="SELECT path_id, max(cum) AS len FROM cumd GROUP BY 1", grid="SELECT path_id, len, unnest(range(0,cast(ceil((len+3.5)/7.0) as bigint))) AS i FROM tot",
    loc="SELECT g.path_id, g.i, g.i*7.0::double AS x, max(c.seq) AS k FROM grid g JOIN cumd c ON c.path_id=g.path_id AND c.cum<=g.i*7.0::double GROUP BY ALL")
    + "SELECT l.path_id, l.i, round(a.lon+(b.lon-a.lon)*coalesce(f,0),7) AS lon, round(a.lat+(b.lat-a.lat)*coalesce(f,0),7) AS lat, round(a.elevation+(b.elevation-a.elevation)*coalesce(f,0),3) AS elevation FROM (SELECT l.*, CASE WHEN b.cum>a.cum THEN least(1.0::double,(x-a.cum)/(b.cum-a.cum)) END AS f, a.seq AS sa, coalesce(b.seq,a.seq) AS sb FROM loc l JOIN cumd a ON a.path_id=l.path_id AND a.seq=l.k LEFT JOIN cumd b ON b.path_id=l.path_id AND b.seq=l.k+1) l JOIN cumd a ON a.path_id=l.path_id AND a.seq=sa JOIN cumd b ON b.path_id=l.path_id AND b.seq=sb",
)
def win9(spark, sf):
    from terrapath.operators.resample import resample

    return resample(P.with_distance(X.tracks(spark, sf), "path_id"), "path_id").select(
        "path_id", "i", r7("lon").alias("lon"), r7("lat").alias("lat"), F.round("elevation", 3).alias("elevation")
    )

