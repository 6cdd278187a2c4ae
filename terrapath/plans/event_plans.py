"""Click, transition and edit-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions import clicks as K
from terrapath.operators import history as H
from terrapath.operators.scan import number_rows, with_previous
from terrapath.plans import sqlkit as S
from terrapath.plans.registry import query, r4
from terrapath.sources import dem as D
from terrapath.sources import fixtures as X

c = F.col


def raw_clicks(spark, sf):
    """Clicks built from events: k is the number in the event's props, ids are missing for every tenth k."""
    k, s = X.prop_k(), F.lit
    e = X.table(spark, sf, "events").select("*", k.alias("k"))
    kk, ok = c("k").cast("string"), c("k") % 10 != 0
    opt = lambda v: F.when(ok, v)
    obj = (
        F.when(c("event_type") == "view", F.create_map(s("type"), s("node"), s("id"), opt(F.concat(s("N"), kk))))
        .when(c("event_type") == "purchase", F.create_map(s("type"), s("proposal_endpoint"), s("proposal_index"), opt((c("k") % 16).cast("string"))))
        .when(c("event_type") == "signup", F.create_map(s("type"), s("Feature"), s("id"), F.lit(None).cast("string")))
        .when(c("event_type") == "error", F.create_map(s("type"), s("pylon"), s("lift_id"), opt(F.concat(s("L"), kk)), s("pylon_index"), (c("k") % 5).cast("string")))
    )
    props = F.when(c("event_type") == "signup", F.create_map(s("type"), s("segment"), s("id"), opt(F.concat(s("S"), kk))))
    return e.select(
        "event_id",
        c("user_id").alias("session_id"),
        c("event_id").alias("ms"),
        F.array(10.002 + 0.0005 * c("k"), 46.99 - 0.002 * c("k")).alias("coord"),
        obj.alias("object"),
        props.alias("properties"),
        "k",
    )


S.cte(
    "clk",
    """SELECT *, CASE event_type WHEN 'view' THEN 'node' WHEN 'purchase' THEN 'proposal_endpoint' WHEN 'signup' THEN 'Feature' WHEN 'error' THEN 'pylon' END AS otype,
    CASE WHEN event_type='click' OR k%10<>0 THEN 1 ELSE 0 END AS usable, 10.002::double+0.0005::double*k AS lon, 46.99::double-0.002::double*k AS lat
    FROM (SELECT event_id, user_id AS session_id, event_id AS ms, event_type, cast(regexp_extract(props,'[0-9]+') AS int) AS k FROM events)""",
)
_OBJID = "CASE otype WHEN 'node' THEN CASE WHEN usable=1 THEN 'node_N'||k ELSE 'node' END WHEN 'proposal_endpoint' THEN 'proposal_endpoint_'||CASE WHEN usable=1 THEN k%16 ELSE 0 END||'_v'||(k%3) WHEN 'Feature' THEN 'Feature' WHEN 'pylon' THEN 'pylon_'||CASE WHEN usable=1 THEN 'L'||k ELSE '' END||'_'||(k%5) END"
_KEY = "CASE WHEN event_type='click' THEN 'terrain_'||printf('%.6f',lat)||'_'||printf('%.6f',lon) WHEN usable=0 THEN NULL WHEN otype='node' THEN 'marker_node_N'||k WHEN otype='Feature' THEN 'marker_segment_S'||k WHEN otype='pylon' THEN 'marker_pylon_'||(k%5)||'_L'||k ELSE 'marker_proposal_end_'||(k%16) END"


def parsed(spark, sf):
    return raw_clicks(spark, sf).withColumn("click", K.parse(c("coord"), c("object"), c("properties")))


@query("str1_event_split", S.with_("clk") + "SELECT event_id, true AS has_coord, otype IS NOT NULL AS has_object FROM clk")
def str1(spark, sf):
    s = raw_clicks(spark, sf).select("event_id", *K.split_event(c("coord"), F.coalesce(c("object"), F.create_map(F.lit("type"), F.lit("click")))))
    return s.select("event_id", c("coord").isNotNull().alias("has_coord"), c("object").isNotNull().alias("has_object"))


@query(
    "str2_click_parse",
    S.with_("clk")
    + "SELECT event_id, CASE WHEN event_type='click' THEN 'terrain' ELSE 'marker' END AS click_type, CASE event_type WHEN 'view' THEN 'node' WHEN 'purchase' THEN 'proposal_endpoint' WHEN 'signup' THEN 'segment' WHEN 'error' THEN 'pylon' END AS marker_type, CASE event_type WHEN 'view' THEN 'N'||k WHEN 'signup' THEN 'S'||k WHEN 'error' THEN 'L'||k END AS entity FROM clk WHERE usable=1",
)
def str2(spark, sf):
    p = parsed(spark, sf).where(c("click").isNotNull())
    return p.select(
        "event_id",
        "click.click_type",
        "click.marker_type",
        F.coalesce("click.node_id", "click.slope_id", "click.segment_id", "click.lift_id").alias("entity"),
    )


@query("str3_object_id", S.with_("clk") + f"SELECT event_id, {_OBJID} AS object_id FROM clk")
def str3(spark, sf):
    return raw_clicks(spark, sf).select("event_id", K.object_id(c("object"), (c("k") % 3).cast("string")).alias("object_id"))


@query(
    "str4_dedup_key",
    S.with_("clk")
    + f"SELECT event_id, {_KEY} AS key, CASE WHEN otype='node' AND usable=1 THEN 'node_N'||k||'_' ELSE '' END||printf('coord_%.5f_%.5f', lon, lat) AS first_id FROM clk",
)
def str4(spark, sf):
    return parsed(spark, sf).select(
        "event_id", K.dedup_key(c("click")).alias("key"), K.first_level_id(c("coord"), c("object")).alias("first_id")
    )


def click_events(spark, sf):
    return raw_clicks(spark, sf).select(
        "session_id", "event_id", "ms", c("coord")[0].alias("x"), c("coord")[1].alias("y"), K.object_id(c("object"), (c("k") % 3).cast("string")).alias("obj")
    )


_STR5 = S.with_(
    "clk", recursive=True,
    ev=f"SELECT session_id, event_id, ms, lon AS x, lat AS y, {_OBJID} AS obj, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS i FROM clk",
    st="""SELECT session_id, 0::bigint AS i, NULL::bigint AS event_id, NULL::double AS lx, NULL::double AS ly, NULL::varchar AS lo, NULL::bigint AS lm, false AS ok FROM (SELECT DISTINCT session_id FROM ev)
      UNION ALL SELECT session_id, i, event_id, CASE WHEN ok THEN x ELSE lx END, CASE WHEN ok THEN y ELSE ly END, CASE WHEN ok THEN coalesce(obj,lo) ELSE lo END, CASE WHEN ok THEN ms ELSE lm END, ok FROM (
        SELECT e.*, s.lx, s.ly, s.lo, s.lm, (s.lm IS NULL OR e.ms-s.lm>=150) AND CASE WHEN e.obj IS NOT NULL THEN e.obj IS DISTINCT FROM s.lo ELSE (e.x IS DISTINCT FROM s.lx OR e.y IS DISTINCT FROM s.ly) END AS ok
        FROM st s JOIN ev e ON e.session_id=s.session_id AND e.i=s.i+1)""",
)


@query("str5_debounce", _STR5 + "SELECT session_id, event_id, ok AS accepted FROM st WHERE i>0")
def str5(spark, sf):
    return H.debounce(click_events(spark, sf), "session_id", "event_id")


@query("val8_click_records", "SELECT event_id, CASE WHEN event_id%6=0 THEN 'terrain needs lat/lon' WHEN event_id%6=1 THEN 'terrain has a marker' WHEN event_id%6=2 THEN 'marker needs a type' WHEN event_id%6=3 THEN 'marker has lat/lon' WHEN event_id%6=4 THEN 'pylon needs lift_id and pylon_index' END AS error FROM events")
def val8(spark, sf):
    m = c("event_id") % 6
    is_terrain = m < 2
    text = lambda v: F.lit(v).cast("string")
    click = F.struct(
        F.when(is_terrain, "terrain").otherwise("marker").alias("click_type"),
        F.when((m == 1) | (m == 3), text("node")).when(m == 4, text("pylon")).when(m == 5, text("node")).alias("marker_type"),
        F.when((m == 1) | (m == 3), F.lit(46.9)).alias("lat"),
        F.when((m == 1) | (m == 3), F.lit(10.1)).alias("lon"),
        F.when(m == 5, text("N1")).alias("node_id"),
        *[text(None).alias(n) for n in ("slope_id", "segment_id")],
        F.when(m == 4, text("L1")).alias("lift_id"),
        *[F.lit(None).cast("int").alias(n) for n in ("pylon_index", "proposal_index")],
    )
    return X.table(spark, sf, "events").select("event_id", K.record_error(click).alias("error"))


@query(
    "join13_click_entity",
    S.with_("clk", "seg", "slope_seg", "pnode")
    + "SELECT event_id, CASE event_type WHEN 'view' THEN n.node_id WHEN 'signup' THEN o.slope_id END AS target, CASE event_type WHEN 'view' THEN CASE WHEN n.node_id IS NULL THEN 'missing' ELSE 'ok' END WHEN 'signup' THEN CASE WHEN o.slope_id IS NULL THEN 'orphan' ELSE 'ok' END END AS status FROM clk LEFT JOIN pnode n ON event_type='view' AND n.node_id='N'||k LEFT JOIN slope_seg o ON event_type='signup' AND o.segment_id='S'||k WHERE event_type IN ('view','signup') AND usable=1",
)
def join13(spark, sf):
    """Node clicks resolve to nodes, segment clicks to the parent slope; orphans are ignored, missing ones reported."""
    from terrapath.operators import graph as G

    p = parsed(spark, sf).select("event_id", "click.marker_type", "click.node_id", "click.segment_id").where(c("marker_type").isin("node", "segment"))
    nodes = X.path_nodes(spark, sf).select("node_id", F.lit(True).alias("_n"))
    # the clicks of the fixture carry no resort; its ids are unique
    owner = G.segment_parent(X.segments(spark, sf).select("resort_id", "segment_id"), X.slopes(spark, sf)).select("segment_id", "slope_id")
    j = p.join(nodes, "node_id", "left").join(owner, "segment_id", "left")
    node = c("marker_type") == "node"
    return j.select(
        "event_id",
        F.when(node, F.when(c("_n"), c("node_id"))).otherwise(c("slope_id")).alias("target"),
        F.when(node, F.when(c("_n"), "ok").otherwise("missing")).otherwise(F.when(c("slope_id").isNotNull(), "ok").otherwise("orphan")).alias("status"),
    )


@query(
    "join14_click_elevation",
    S.with_("clk", "dem") + f"SELECT event_id, round(d.elevation,4) AS elevation FROM clk k LEFT JOIN dem d ON d.row={S.row_of('k.lat')} AND d.col={S.col_of('k.lon')} WHERE event_type='click'",
)
def join14(spark, sf):
    t = parsed(spark, sf).where(c("click.click_type") == "terrain").select("event_id", "click.lon", "click.lat")
    return D.lookup_elevation(t, X.dem_cells(spark, sf), X.dem_meta(spark, sf)).select("event_id", r4("elevation").alias("elevation"))


def rule_rows():
    return ",".join("(" + ",".join("'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in C.CLICK_RULES)


@query(
    "join15_refused_clicks",
    S.with_("clk", rule=f"SELECT * FROM (VALUES {rule_rows()}) t(state,target,action,reason)")
    + "SELECT event_id, k.state, 'Cannot '||action||' — '||reason AS message FROM (SELECT event_id, (['SlopeBuilding','LiftPlacing','IdleReady'])[k%3+1] AS state, CASE event_type WHEN 'click' THEN 'terrain' WHEN 'view' THEN 'node' WHEN 'purchase' THEN 'proposal_endpoint' WHEN 'signup' THEN 'segment' ELSE 'pylon' END AS target FROM clk WHERE usable=1) k LEFT JOIN rule r ON r.state=k.state AND r.target=k.target",
)
def join15(spark, sf):
    r = spark.createDataFrame(C.CLICK_RULES, "state string, target string, action string, reason string")
    state = F.element_at(F.array(*map(F.lit, ("SlopeBuilding", "LiftPlacing", "IdleReady"))), c("k") % 3 + 1)
    p = parsed(spark, sf).where(c("click").isNotNull()).select("event_id", state.alias("state"), F.coalesce("click.marker_type", F.lit("terrain")).alias("target"))
    text = F.format_string("Cannot %s — %s", "action", "reason")
    return p.join(F.broadcast(r), ["state", "target"], "left").select(
        "event_id", "state", F.when(c("action").isNotNull(), text).alias("message")
    )


EVENTS = sorted({e for _, e, _, _ in C.TRANSITIONS})
STATES = sorted({s for s, *_ in C.TRANSITIONS})
S.cte(
    "tlog",
    f"SELECT session_id, event_id, {S.words(EVENTS)}[cast((event_id+k)%{len(EVENTS)} as int)+1] AS event, {S.words(STATES)}[cast((event_id//3+k)%{len(STATES)} as int)+1] AS to_state, k%3 AS n_segments FROM clk",
    "clk",
)


def transition_log(spark, sf):
    pick = lambda ws, n: F.element_at(F.array(*map(F.lit, ws)), (n % len(ws) + 1).cast("int"))
    return X.table(spark, sf, "events").select("*", X.prop_k().alias("k")).select(
        c("user_id").alias("session_id"),
        "event_id",
        pick(EVENTS, c("event_id") + c("k")).alias("event"),
        pick(STATES, F.floor(c("event_id") / 3) + c("k")).alias("to_state"),
        (c("k") % 3).alias("n_segments"),
    )


_BEFORE = "SELECT *, coalesce(lag(to_state) OVER (PARTITION BY session_id ORDER BY event_id),'IdleReady') AS from_state FROM tlog"
_ALLOW = ",".join("('" + "','".join(t) + "')" for t in C.TRANSITIONS)
_ILLEGAL = S.with_("tlog", bf=_BEFORE, al=f"SELECT * FROM (VALUES {_ALLOW}) t(from_state,event,guard,to_state)") + "SELECT {cols} FROM bf b WHERE NOT EXISTS (SELECT 1 FROM al a WHERE a.from_state=b.from_state AND a.event=b.event AND a.to_state=b.to_state AND (a.guard='any' OR (a.guard='some')=(b.n_segments>0))){tail}"


@query("join16_transition_check", _ILLEGAL.format(cols="session_id, event_id", tail=""))
def join16(spark, sf):
    return H.illegal_transitions(H.with_state_before(transition_log(spark, sf), "session_id", "event_id")).select("session_id", "event_id")


@query("str8_transition_audit", _ILLEGAL.format(cols="from_state, event, to_state, count(*) AS n", tail=" GROUP BY ALL"))
def str8(spark, sf):
    bad = H.illegal_transitions(H.with_state_before(transition_log(spark, sf), "session_id", "event_id"))
    return bad.groupBy("from_state", "event", "to_state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "str9_click_routing",
    S.with_("clk", "dem")
    + f"SELECT event_id, CASE WHEN usable=0 THEN 'ignored' WHEN event_type<>'click' THEN 'marker' WHEN d.elevation IS NULL THEN 'outside' ELSE 'terrain' END AS route FROM clk k LEFT JOIN dem d ON event_type='click' AND d.row={S.row_of('k.lat')} AND d.col={S.col_of('k.lon')}",
)
def str9(spark, sf):
    from terrapath.streaming.clicks import route_clicks

    return route_clicks(raw_clicks(spark, sf), X.dem_cells(spark, sf), X.dem_meta(spark, sf)).select("event_id", "route")


_STR7 = S.with_(
    "edits", recursive=True,
    ed="SELECT *, row_number() OVER (PARTITION BY resort_id ORDER BY op_seq) AS i FROM edits",
    rp="""SELECT resort_id, 0::bigint AS i, NULL::bigint AS op_seq, NULL::varchar AS op, []::bigint[] AS st, NULL::bigint AS undoes FROM (SELECT DISTINCT resort_id FROM ed)
      UNION ALL SELECT r.resort_id, e.i, e.op_seq, e.op, CASE WHEN e.op='UNDO' THEN r.st[1:len(r.st)-1] WHEN len(r.st)>=50 THEN r.st[2:50] || [e.op_seq] ELSE r.st || [e.op_seq] END,
        CASE WHEN e.op='UNDO' AND len(r.st)>0 THEN r.st[-1] END FROM rp r JOIN ed e ON e.resort_id=r.resort_id AND e.i=r.i+1""",
)


@query("str7_edit_replay", _STR7 + "SELECT resort_id, op_seq, undoes, op='UNDO' AND undoes IS NULL AS is_error FROM rp WHERE i>0")
def str7(spark, sf):
    log = X.edit_log(spark, sf)
    events, _ = H.replay_edits(log)
    return events.join(log.select("resort_id", "op_seq", "op"), ["resort_id", "op_seq"]).select(
        "resort_id", "op_seq", "undoes", ((c("op") == "UNDO") & c("undoes").isNull()).alias("is_error")
    )


@query(
    "grf7_surviving_edits",
    _STR7 + "SELECT resort_id, op, count(*) AS n FROM rp p WHERE i>0 AND op<>'UNDO' AND NOT EXISTS (SELECT 1 FROM rp u WHERE u.resort_id=p.resort_id AND u.undoes=p.op_seq) GROUP BY ALL",
)
def grf7(spark, sf):
    return H.surviving_edits(X.edit_log(spark, sf)).groupBy("resort_id", "op").agg(F.count(F.lit(1)).alias("n"))


_CURRENT = (
    _STR7.rstrip()
    + """,
  lg AS (SELECT *, lag(op_seq) OVER (PARTITION BY resort_id ORDER BY op_seq) AS p FROM edits),
  al AS (SELECT * FROM lg l WHERE op<>'UNDO' AND NOT EXISTS (SELECT 1 FROM rp u WHERE u.resort_id=l.resort_id AND u.undoes=l.op_seq)),
  dl AS (SELECT resort_id, p FROM al WHERE op='DELETE_SLOPE'),
  sl AS (SELECT * FROM al f WHERE op='FINISH_SLOPE' AND NOT EXISTS (SELECT 1 FROM dl WHERE dl.resort_id=f.resort_id AND dl.p=f.op_seq)),
  rm AS (SELECT f.resort_id, f.p FROM al f JOIN dl ON dl.resort_id=f.resort_id AND dl.p=f.op_seq WHERE f.op='FINISH_SLOPE')
  SELECT a.resort_id, 'segment' AS kind, 'S'||(2*a.op_seq+k) AS id, coalesce('Slope '||s.op_seq, 'Segment '||(2*a.op_seq+k)) AS name
   FROM al a JOIN (VALUES (1),(2)) v(k) ON true LEFT JOIN sl s ON s.resort_id=a.resort_id AND s.p=a.op_seq
   WHERE a.op='ADD_SEGMENTS' AND NOT EXISTS (SELECT 1 FROM rm WHERE rm.resort_id=a.resort_id AND rm.p=a.op_seq)
  UNION ALL SELECT resort_id, 'slope', 'SL'||op_seq, 'Slope '||op_seq FROM sl
  UNION ALL SELECT resort_id, 'lift', 'L'||op_seq, 'Lift '||op_seq FROM al WHERE op='ADD_LIFT'"""
)


def full_log(spark, sf):
    """The edit log with what each operation works on: a finish and a removal refer to the entry before them."""
    log = X.edit_log(spark, sf).select("resort_id", "op_seq", "op")
    log = with_previous(number_rows(log, ["resort_id"], ["op_seq"], "_pos"), ["resort_id"], "_pos", {"op_seq": "_p"})
    pair = lambda n: F.array(*[F.concat(F.lit("S"), 2 * n + k) for k in (1, 2)])
    named = lambda prefix, n: F.concat(F.lit(prefix), n)
    op, seq, before = c("op"), c("op_seq"), c("_p")
    entity = (
        F.when(op == "FINISH_SLOPE", named("SL", seq)).when(op == "ADD_LIFT", named("L", seq)).when(op == "DELETE_SLOPE", named("SL", before))
    )
    name = F.when(op == "FINISH_SLOPE", named("Slope ", seq)).when(op == "ADD_LIFT", named("Lift ", seq))
    listed = F.when(op == "ADD_SEGMENTS", pair(seq)).when((op == "FINISH_SLOPE") & before.isNotNull(), pair(before))
    return log.select("resort_id", "op_seq", "op", entity.alias("entity_id"), name.alias("name"), listed.alias("segment_ids"))


@query("str7_current_tables", _CURRENT)
def str7_tables(spark, sf):
    """Segments, slopes and lifts of every resort after all edits and undos."""
    segments, slopes, lifts = H.current_tables(full_log(spark, sf))
    row = lambda df, kind, key: df.select("resort_id", F.lit(kind).alias("kind"), c(key).alias("id"), "name")
    return row(segments, "segment", "segment_id").unionByName(row(slopes, "slope", "entity_id")).unionByName(row(lifts, "lift", "entity_id"))


@query(
    "win10_undo_stack",
    _STR7 + "SELECT resort_id, len(arg_max(st,i)) AS depth, array_to_string(arg_max(st,i),',') AS stack FROM rp GROUP BY 1",
)
def win10(spark, sf):
    _, stacks = H.replay_edits(X.edit_log(spark, sf))
    return stacks.select("resort_id", F.size("stack").alias("depth"), F.array_join(c("stack").cast("array<string>"), ",").alias("stack"))


