"""Commit, finish, documents and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.operators import commit as M
from terrapath.operators import graph as G
from terrapath.operators.snapping import snap_sequence
from terrapath.plans import sqlkit as S
from terrapath.plans.lift_plans import _OWN, TERRAIN, cable_ctes, full_lifts, pylon_ctes
from terrapath.plans.registry import query, r4
from terrapath.plans.scalar import _NAME_L, _NAME_S
from terrapath.plans.terrain_plans import gradient_ctes
from terrapath.sources import fixtures as X
from terrapath.sources import resort_json as J

c = F.col


def endpoints(spark, sf):
    s = X.segments(spark, sf)
    n = c("path_id") * 8 + c("seg_no")
    ends = F.array(*[F.struct((n * 2 + k).alias("end_ord"), F.element_at("points", at).alias("p")) for k, at in ((0, 1), (1, -1))])
    return s.select("resort_id", F.inline(ends)).select("resort_id", "end_ord", "p.*")


_D = S.hav("nd.la", "nd.lo", "e.lat", "e.lon")
_SNAP = dict(
    ep="SELECT resort_id, (n-1)*2 AS end_ord, start_lon AS lon, start_lat AS lat FROM seg UNION ALL SELECT resort_id, (n-1)*2+1, end_lon, end_lat FROM seg",
    eo="SELECT *, row_number() OVER (PARTITION BY resort_id ORDER BY end_ord) AS i FROM ep",
    sn=f"""SELECT resort_id, 0::bigint AS i, NULL::bigint AS end_ord, NULL::bigint AS nid, false AS created, []::STRUCT(lo DOUBLE, la DOUBLE)[] AS nodes FROM (SELECT DISTINCT resort_id FROM eo)
     UNION ALL SELECT resort_id, i, end_ord, CASE WHEN hit IS NULL THEN len(nodes)+1 ELSE hit.k END, hit IS NULL, CASE WHEN hit IS NULL THEN nodes || [struct_pack(lo:=lon, la:=lat)] ELSE nodes END FROM (
      SELECT e.resort_id, e.i, e.end_ord, e.lon, e.lat, s.nodes, list_sort(list_filter(list_transform(s.nodes, lambda nd, j: struct_pack(d:={_D}, k:=j)), lambda q: q.d<30))[1] AS hit
      FROM sn s JOIN eo e ON e.resort_id=s.resort_id AND e.i=s.i+1)""",
)
_SNAPQ = S.with_("seg", recursive=True, **_SNAP)


@query("grf1_node_snapping", _SNAPQ + "SELECT resort_id, end_ord, 'N'||nid AS node_id, created FROM sn WHERE i>0")
def grf1(spark, sf):
    return snap_sequence(endpoints(spark, sf), "resort_id", "end_ord")


_SIDEV = f"CASE WHEN g.slope_pct<0.5 THEN 0.0 ELSE g.slope_pct*sin(radians(g.bearing_deg-{S.brg('f.lon','f.lat','h.lon','h.lat')})) END"


@query(
    "grf2_commit_paths",
    S.with_("seg", "dem", recursive=True, **_SNAP, src="SELECT n AS id, start_lon AS lon, start_lat AS lat FROM seg", **gradient_ctes("src"),
    pt="SELECT n, lon, lat, row_number() OVER (PARTITION BY n ORDER BY seq) AS r FROM seg_pts")
    + f"SELECT resort_id, n-1 AS ord, 'S'||row_number() OVER (PARTITION BY resort_id ORDER BY n) AS segment_id, 'N'||a AS start_node_id, 'N'||b AS end_node_id, round(v,4) AS side_pct, CASE WHEN abs(v)<2 THEN 'flat' WHEN v>0 THEN 'right' ELSE 'left' END AS side_dir FROM (SELECT s.resort_id, s.n, x.nid AS a, y.nid AS b, {_SIDEV} AS v FROM seg s JOIN sn x ON x.end_ord=(s.n-1)*2 JOIN sn y ON y.end_ord=(s.n-1)*2+1 JOIN grad g ON g.id=s.n JOIN pt f ON f.n=s.n AND f.r=1 JOIN pt h ON h.n=s.n AND h.r=2)",
)
def grf2(spark, sf):
    p = X.segments(spark, sf).select("resort_id", (c("path_id") * 8 + c("seg_no")).alias("ord"), "points", F.lit(None).cast("string").alias("target_node_id"))
    s, _ = M.commit_paths(p, X.dem_cells(spark, sf), X.dem_meta(spark, sf))
    return s.select(
        "resort_id", "ord", "segment_id", "start_node_id", "end_node_id", r4("side_slope_pct").alias("side_pct"), c("side_slope_dir").alias("side_dir")
    )


@query(
    "grf3_finish_slope",
    S.with_("seg", "slope", "slope_seg", "pnode",
    hd="SELECT p.slope_id, f.start_node_id AS a, e.end_node_id AS b, p.path_id FROM slope p JOIN seg f ON f.segment_id=p.segment_ids[1] JOIN seg e ON e.segment_id=p.segment_ids[-1]",
    mx="SELECT slope_id, max(max_slope_pct) AS m FROM slope_seg ss JOIN seg s ON s.segment_id=ss.segment_id GROUP BY 1",
    nm=f"SELECT h.slope_id, h.path_id+1 AS num, {S.cls('m')} AS d, {S.brg('x.lon','x.lat','y.lon','y.lat')} AS b, x.elevation-y.elevation AS dz FROM hd h JOIN mx ON mx.slope_id=h.slope_id JOIN pnode x ON x.node_id=h.a JOIN pnode y ON y.node_id=h.b")
    + f"SELECT slope_id, {_NAME_S} AS name, d AS difficulty FROM nm",
)
def grf3(spark, sf):
    facts = G.segment_facts(X.segments(spark, sf))
    return M.finish_slopes(X.slopes(spark, sf), facts, X.path_nodes(spark, sf)).select("slope_id", "name", "difficulty")


@query(
    "grf3_renamed_segments",
    S.with_("seg", "slope", "slope_seg", "pnode",
    hd="SELECT p.slope_id, f.start_node_id AS a, e.end_node_id AS b, p.path_id FROM slope p JOIN seg f ON f.segment_id=p.segment_ids[1] JOIN seg e ON e.segment_id=p.segment_ids[-1]",
    mx="SELECT slope_id, max(max_slope_pct) AS m FROM slope_seg ss JOIN seg s ON s.segment_id=ss.segment_id GROUP BY 1",
    nm=f"SELECT h.slope_id, h.path_id+1 AS num, {S.cls('m')} AS d, {S.brg('x.lon','x.lat','y.lon','y.lat')} AS b, x.elevation-y.elevation AS dz FROM hd h JOIN mx ON mx.slope_id=h.slope_id JOIN pnode x ON x.node_id=h.a JOIN pnode y ON y.node_id=h.b",
    fin=f"SELECT slope_id, {_NAME_S} AS name FROM nm")
    + "SELECT s.segment_id, coalesce(min(f.name), 'Segment '||min(s.n)) AS name FROM seg s LEFT JOIN slope_seg ss ON ss.segment_id=s.segment_id LEFT JOIN fin f ON f.slope_id=ss.slope_id GROUP BY 1",
)
def grf3_renamed(spark, sf):
    """Segments after their slopes were finished; those of a slope that could not be finished keep their names."""
    segments, slopes = X.segments(spark, sf), X.slopes(spark, sf)
    finished = M.finish_slopes(slopes, G.segment_facts(segments), X.path_nodes(spark, sf))
    return M.rename_segments(segments, finished, slopes).select("segment_id", "name")


# ---------------------------------------------------------------- documents


def documents(spark, sf):
    """One small document per track (bounded: at most 7 segments), with gaps to exercise defaults and rejects."""
    s = X.segments(spark, sf)
    n = c("path_id") * 8 + c("seg_no") + 1
    q = lambda k, v: F.concat(F.lit(f'"{k}":"'), v, F.lit('"'))
    entity = F.concat_ws(
        ",",
        q("id", c("segment_id")),
        F.when(n % 13 != 0, q("name", c("name"))),
        F.concat(F.lit('"points":'), F.to_json("points")),
        q("start_node_id", c("start_node_id")),
        q("end_node_id", c("end_node_id")),
        F.when(n % 5 != 0, F.concat(F.lit('"side_slope_pct":'), c("side_slope_pct").cast("string"))),
        F.when(n % 7 != 0, q("side_slope_dir", c("side_slope_dir"))),
    )
    item = F.concat(F.lit('"'), c("segment_id"), F.lit('":{'), entity, F.lit("}"))
    body = s.groupBy("path_id").agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("body"))
    return body.select(
        c("path_id").alias("resort_id"),
        F.concat(F.lit('{"version":"2.0","nodes":{},"segments":{'), "body", F.lit('},"slopes":{},"lifts":{},"counters":{"node":1,"segment":2,"slope":3,"lift":4}}')).alias("text"),
    )


@query(
    "src4_document_load",
    S.with_("seg")
    + "SELECT segment_id, n%13=0 AS rejected, CASE WHEN n%5=0 THEN 0.0 ELSE side END AS side_slope_pct, CASE WHEN n%7=0 THEN 'flat' ELSE side_dir END AS side_slope_dir, n_pts AS n_points FROM seg WHERE n%13<>0 UNION ALL SELECT segment_id, true, NULL, NULL, NULL FROM seg WHERE n%13=0",
)
def src4(spark, sf):
    good, bad = J.load_part(J.parse_documents(documents(spark, sf)), "segments")
    a = good.select(c("id").alias("segment_id"), F.lit(False).alias("rejected"), "side_slope_pct", "side_slope_dir", F.size("points").alias("n_points"))
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    b = bad.select(c("id").alias("segment_id"), F.lit(True).alias("rejected"), none("double", "side_slope_pct"), none("string", "side_slope_dir"), none("int", "n_points"))
    return a.unionByName(b)


@query(
    "src4_bad_documents",
    "SELECT path_id AS resort_id, CASE WHEN path_id%5=1 THEN 'not a resort document' ELSE 'missing: slopes, counters' END AS reason FROM (SELECT DISTINCT event_id//64 AS path_id FROM events) WHERE path_id%5 IN (1,2)",
)
def src4_bad(spark, sf):
    """Every fifth document cut short, every fifth without two of its parts: none vanishes without a row."""
    p = X.tracks(spark, sf).select(c("path_id").alias("resort_id")).distinct()
    whole = '{"version":"2.0","nodes":{},"segments":{},"slopes":{},"lifts":{},"counters":{"node":1,"segment":2,"slope":3,"lift":4}}'
    text = F.when(c("resort_id") % 5 == 1, F.lit(whole[:40])).when(c("resort_id") % 5 == 2, F.lit('{"nodes":{},"segments":{},"lifts":{}}')).otherwise(F.lit(whole))
    return J.bad_documents(J.parse_documents(p.withColumn("text", text)))


def document_fragments(spark, sf):
    seg, slopes = X.segments(spark, sf), X.slopes(spark, sf)
    nodes, lifts = X.nodes(spark, sf), full_lifts(spark, sf)
    num = lambda col, kind: F.substring(col, len(C.ID_PREFIX[kind]) + 1, 20).cast("long")
    parts = {
        "nodes": nodes.select("resort_id", c("node_ord").alias("item"), F.struct(c("node_id").alias("id"), X.point().alias("location")).alias("entity")),
        "segments": seg.select("resort_id", num("segment_id", "segment").alias("item"), F.struct(c("segment_id").alias("id"), "name", "points", "start_node_id", "end_node_id", "side_slope_pct", "side_slope_dir").alias("entity")),
        "slopes": slopes.select("resort_id", num("slope_id", "slope").alias("item"), F.struct(c("slope_id").alias("id"), "name", "segment_ids", "start_node_id", "end_node_id").alias("entity")),
        "lifts": lifts.select("resort_id", (c("lift_no") + 1).alias("item"), F.struct(c("lift_id").alias("id"), "name", "start_node_id", "end_node_id", "lift_type", "terrain_points", "pylons", "cable_points").alias("entity")),
    }
    top = lambda df, n: df.groupBy("resort_id").agg(F.max("item").cast("int").alias(n))
    counters = top(parts["nodes"], "node").join(top(parts["segments"], "segment"), "resort_id", "left").join(top(parts["slopes"], "slope"), "resort_id", "left")
    # the lift number is in its row: no lift is built to count it
    last_lift = X.table(spark, sf, "customer").groupBy(X.resort_of(c("c_custkey")).alias("resort_id")).agg((F.max("c_custkey") + 1).cast("int").alias("lift"))
    counters = counters.join(last_lift, "resort_id", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    counters = counters.select("resort_id", F.struct(zero("node"), zero("segment"), zero("slope"), zero("lift")).alias("counters"))
    return J.fragments(parts, counters)


@query(
    "src5_document_fragments",
    S.with_("seg", "slope", "node", "lift", ns="SELECT resort_id, max(node_ord) AS a FROM node GROUP BY 1", ls="SELECT resort_id, max(lift_no+1) AS a FROM lift GROUP BY 1", gs="SELECT resort_id, max(n) AS a FROM seg GROUP BY 1", ss="SELECT resort_id, max(path_id+1) AS a FROM slope GROUP BY 1",
    sq="SELECT resort_id, path_id+1 AS item, CASE WHEN row_number() OVER (PARTITION BY resort_id ORDER BY path_id)=1 THEN '' ELSE ',' END||'\"'||slope_id||'\":{\"id\":\"'||slope_id||'\",\"name\":\"'||name||'\",\"segment_ids\":[\"'||array_to_string(segment_ids,'\",\"')||'\"],\"start_node_id\":\"'||start_node_id||'\",\"end_node_id\":\"'||end_node_id||'\"}' AS text FROM slope")
    + """SELECT resort_id, 5 AS part, item, text FROM sq
    UNION ALL SELECT ns.resort_id, p, 0, t FROM ns, (VALUES (0,'{"version":"2.0","nodes":{'),(2,'},"segments":{'),(4,'},"slopes":{'),(6,'},"lifts":{')) h(p,t)
    UNION ALL SELECT ns.resort_id, 8, 0, '},"counters":{"node":'||ns.a||',"segment":'||coalesce(gs.a,0)||',"slope":'||coalesce(ss.a,0)||',"lift":'||coalesce(ls.a,0)||'}}' FROM ns LEFT JOIN gs ON gs.resort_id=ns.resort_id LEFT JOIN ss ON ss.resort_id=ns.resort_id LEFT JOIN ls ON ls.resort_id=ns.resort_id
    UNION ALL SELECT resort_id, 1, node_ord, NULL FROM node UNION ALL SELECT resort_id, 3, n, NULL FROM seg UNION ALL SELECT resort_id, 7, lift_no+1, NULL FROM lift""",
)
def src5(spark, sf):
    """Document fragments; ``src5_fragment_content`` compares the text of nodes, segments and lifts, which hold doubles."""
    f = document_fragments(spark, sf)
    return f.withColumn("text", F.when(~c("part").isin(1, 3, 7), c("text")))


@query(
    "src5_fragment_content",
    S.with_("seg", "seg_pts", "node", "lift", recursive=True, **TERRAIN,
    sp="SELECT n, count(*) AS k, sum(lon) AS x, sum(elevation) AS z FROM seg_pts GROUP BY 1",
    tp="SELECT lift_id, count(*) AS k, sum(lon) AS x, sum(z) AS z FROM ter GROUP BY 1")
    + f"""SELECT resort_id, 1 AS part, node_id AS id, NULL AS name, 1 AS n_points, round(lon,5) AS sum_lon, round(elevation,3) AS sum_elevation FROM node
    UNION ALL SELECT resort_id, 3, segment_id, 'Segment '||s.n, k, round(x,5), round(z,3) FROM seg s JOIN sp ON sp.n=s.n
    UNION ALL SELECT l.resort_id, 7, l.lift_id, {_NAME_L}, k, round(x,5), round(z,3) FROM (SELECT *, lift_no+1 AS num, lift_type AS t, d AS len, end_elevation-start_elevation AS rise, {S.brg('end_lon','end_lat','start_lon','start_lat')} AS b FROM l2) l JOIN tp ON tp.lift_id=l.lift_id""",
)
def src5_content(spark, sf):
    """Fragments of nodes, segments and lifts, read back from their text."""
    f = document_fragments(spark, sf)
    out = None
    for part, kind, points in ((1, J.NODE, F.array("e.location")), (3, J.SEGMENT, c("e.points")), (7, J.LIFT, c("e.terrain_points"))):
        body = F.concat(F.lit("{"), F.regexp_replace("text", "^,", ""), F.lit("}"))
        e = f.where(c("part") == part).select("resort_id", "part", F.explode(F.from_json(body, f"map<string,{kind}>")).alias("id", "e"))
        total = lambda p, n: F.aggregate(p, F.lit(0.0), lambda a, q: a + q[n])
        name = F.lit(None).cast("string") if part == 1 else c("e.name")
        rows = e.select(
            "resort_id", "part", c("e.id").alias("id"), name.alias("name"), F.size(points).alias("n_points"),
            F.round(total(points, "lon"), 5).alias("sum_lon"), F.round(total(points, "elevation"), 3).alias("sum_elevation"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- GPX


def gpx_parts(spark, sf):
    """Track headers and their point pieces."""
    facts, slopes = G.segment_facts(X.segments(spark, sf)), X.slopes(spark, sf)
    both = ["resort_id", "slope_id"]
    number = slopes.select(*both, "name", (c("path_id") + 1).alias("item"))
    stats = G.slope_stats(slopes, facts).join(number, both)
    slope_tracks = stats.select(
        "resort_id",
        F.lit("slope").alias("kind"),
        "item",
        "name",
        J.slope_desc(c("difficulty"), c("drop_m"), c("length_m")).alias("desc"),
        F.concat(F.lit("slope_"), "difficulty").alias("type"),
    )
    parts = G.slope_members(slopes).join(facts.select("resort_id", "segment_id", "points"), ["resort_id", "segment_id"]).join(number.drop("name"), both)
    first = parts.groupBy(*both).agg(F.min("pos").alias("_first"))
    rest = F.slice("points", 2, F.size("points"))
    slope_pieces = parts.join(first, both).select(
        "resort_id", F.lit("slope").alias("kind"), "item", c("pos").alias("piece"), F.when(c("pos") == c("_first"), c("points")).otherwise(rest).alias("points")
    )
    lifts = full_lifts(spark, sf)
    lift_tracks = lifts.select(
        "resort_id",
        F.lit("lift").alias("kind"),
        (c("lift_no") + 1).alias("item"),
        F.concat("name", F.lit(" - "), "lift_type").alias("name"),
        J.lift_desc(c("end_elevation") - c("start_elevation"), c("length_m")).alias("desc"),
        F.concat(F.lit("lift_"), "lift_type").alias("type"),
    )
    lift_pieces = lifts.select("resort_id", F.lit("lift").alias("kind"), (c("lift_no") + 1).alias("item"), F.lit(0).alias("piece"), c("cable_points").alias("points"))
    return slope_tracks.unionByName(lift_tracks), slope_pieces.unionByName(lift_pieces)


_R0 = "printf('%.0f', round_even({0},0)+0.0)"
_GPX = S.with_(
    "seg", "slope", "slope_seg", "seg_pts", "lift", recursive=True,
    sst=f"SELECT slope_id, sum(length_m) AS l, sum(drop_m) AS z, {S.cls('greatest(max(max_slope_pct),0.0)')} AS d, sum(n_pts)-count(*)+1 AS np FROM slope_seg ss JOIN seg s ON s.segment_id=ss.segment_id GROUP BY 1",
    **TERRAIN, **pylon_ctes(_OWN), **cable_ctes(_OWN), nc="SELECT lift_no, count(*) AS np FROM cab GROUP BY 1",
)


@query(
    "snk1_gpx_tracks",
    _GPX
    + f"""SELECT p.resort_id, 'slope' AS kind, p.path_id+1 AS item, p.name, upper(d[1])||d[2:]||' - Drop '||{_R0.format('z')}||'m - Length '||{_R0.format('l')}||'m' AS descr, 'slope_'||d AS type, np AS n_points FROM slope p JOIN sst ON sst.slope_id=p.slope_id
    UNION ALL SELECT resort_id, 'lift', num, {_NAME_L}||' - '||t, 'Rise '||{_R0.format('rise')}||'m - Length '||{_R0.format('len')}||'m', 'lift_'||t, np FROM (SELECT resort_id, lift_no, lift_no+1 AS num, lift_type AS t, d AS len, end_elevation-start_elevation AS rise, {S.brg('end_lon','end_lat','start_lon','start_lat')} AS b FROM l2) x JOIN nc ON nc.lift_no=x.lift_no""",
)
def snk1(spark, sf):
    tracks, pieces = gpx_parts(spark, sf)
    key = ["resort_id", "kind", "item"]
    n = pieces.groupBy(*key).agg(F.sum(F.size("points")).alias("n_points"))
    return tracks.join(n, key).select("resort_id", "kind", "item", "name", c("desc").alias("descr"), "type", "n_points")


@query("snk1_gpx_fragments")
def snk1_text(spark, sf):
    """GPX text fragments (doubles print engine-specific, so no SQL twin; parsed back in the tests)."""
    return J.gpx_fragments(*gpx_parts(spark, sf), "2026-01-01T00:00:00")


@query(
    "set1_track_union",
    S.with_("slope", "lift") + "SELECT resort_id, kind, count(*) AS n FROM (SELECT resort_id, 'slope' AS kind FROM slope UNION ALL SELECT resort_id, 'lift' FROM lift) GROUP BY ALL",
)
def set1(spark, sf):
    a = X.slopes(spark, sf).select("resort_id", F.lit("slope").alias("kind"))
    b = X.table(spark, sf, "customer").select(X.resort_of(c("c_custkey")).alias("resort_id"), F.lit("lift").alias("kind"))
    return a.unionByName(b).groupBy("resort_id", "kind").agg(F.count(F.lit(1)).alias("n"))


