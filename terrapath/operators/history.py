"""Order-dependent event processing: click de-duplication, undo history, transition audit.

A session or resort may hold any share of all events.  Each ordered group is cut into
short chunks, a chunk is folded inside one array, and chunk states are combined between
chunks by equi-joins, so no task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.operators.scan import cut_lineage, number_rows, with_previous


def _chunks(events: DataFrame, key: str, order: str, item: list[str], chunk: int) -> DataFrame:
    """(key, chunk, items): ordered arrays of at most ``chunk`` events."""
    numbered = number_rows(events, [key], [order], "_pos")
    return cut_lineage(
        numbered.withColumn("chunk", F.floor(F.col("_pos") / chunk))
        .groupBy(key, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", *item))).alias("items"))
    )


# ---------------------------------------------------------------- click debounce

LAST = "struct<x:double,y:double,obj:string,ms:bigint>"


def _accept(s: Column, e: Column, wait_ms: int) -> Column:
    """Whether event ``e`` counts as a new click after state ``s``."""
    empty = e["obj"].isNull() & e["x"].isNull()
    soon = s["ms"].isNotNull() & (e["ms"] - s["ms"] < wait_ms)
    same_obj = F.coalesce(e["obj"] == s["obj"], F.lit(False))
    same_spot = F.coalesce((e["x"] == s["x"]) & (e["y"] == s["y"]), F.lit(False))
    return ~empty & ~soon & F.when(e["obj"].isNotNull(), ~same_obj).otherwise(~same_spot)


def _after(s: Column, e: Column) -> Column:
    """State once ``e`` was accepted; terrain clicks keep the last object."""
    return F.struct(
        F.coalesce(e["x"], s["x"]).alias("x"),
        F.coalesce(e["y"], s["y"]).alias("y"),
        F.coalesce(e["obj"], s["obj"]).alias("obj"),
        e["ms"].alias("ms"),
    )


def _fold_clicks(items: Column, start: Column, wait_ms: int) -> Column:
    init = F.struct(start.cast(LAST).alias("s"), F.array().cast("array<boolean>").alias("ok"))

    def step(acc: Column, e: Column) -> Column:
        ok = _accept(acc["s"], e, wait_ms)
        return F.struct(
            F.when(ok, _after(acc["s"], e)).otherwise(acc["s"]).alias("s"), F.concat(acc["ok"], F.array(ok)).alias("ok")
        )

    return F.aggregate(items, init, step)


def debounce(clicks: DataFrame, session: str, order: str, wait_ms: int = C.DEBOUNCE_MS, chunk: int = C.FOLD_ROWS) -> DataFrame:
    """Flag accepted clicks (``session``, ``order``, ms, x, y, obj) against the last accepted one.

    Chunks are folded from a guessed start state, then again from the end state of the
    chunk before until no start state changes.  The first chunk is right at once and each
    round makes at least the next one right; a session forgets its past after a few
    accepted clicks, so two or three rounds are usual and one is enough for short sessions.
    Clicks of a session are in time order, so a wait that is over at a chunk's first click is over for all
    of it: such a start state carries no time, and a session that only repeats its last click settles
    as fast as any other.
    """
    items = _chunks(clicks, session, order, [order, "ms", "x", "y", "obj"], chunk)
    blank = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("x", "double"), ("y", "double"), ("obj", "string"), ("ms", "bigint"))])
    state = cut_lineage(items.select(session, "chunk", blank.alias("start"), _fold_clicks(F.col("items"), blank, wait_ms).alias("r")))
    opens = items.select(session, "chunk", F.element_at("items", 1)["ms"].alias("_first_ms"))
    if not items.where(F.col("chunk") > 0).isEmpty():
        while True:
            feed = state.select(session, (F.col("chunk") + 1).alias("chunk"), F.col("r.s").alias("_in"))
            over = F.col("_first_ms") - F.col("_in.ms") >= wait_ms
            timeless = F.struct("_in.x", "_in.y", "_in.obj", F.when(~over, F.col("_in.ms")).alias("ms"))
            joined = state.join(feed, [session, "chunk"], "left").join(opens, [session, "chunk"])
            joined = joined.withColumn("_in", F.coalesce(F.when(F.col("_in").isNotNull(), timeless), blank))
            stale = joined.where(~F.col("_in").eqNullSafe(F.col("start")))
            if stale.isEmpty():
                break
            again = (
                stale.select(session, "chunk", F.col("_in").alias("start"))
                .join(items, [session, "chunk"])
                .select(session, "chunk", "start", _fold_clicks(F.col("items"), F.col("start"), wait_ms).alias("r"))
            )
            state = cut_lineage(state.join(again.select(session, "chunk"), [session, "chunk"], "left_anti").unionByName(again))
    flags = items.join(state.select(session, "chunk", F.col("r.ok").alias("ok")), [session, "chunk"])
    return flags.select(session, F.explode(F.arrays_zip("items", "ok")).alias("z")).select(
        session, F.col(f"z.items.{order}").alias(order), F.col("z.ok").alias("accepted")
    )


# ---------------------------------------------------------------- undo history

STACK = "array<bigint>"


def _effect(items: Column, depth: int) -> Column:
    """Effect of a chunk on an unknown stack: pops below it, cap on what remains, own entries."""
    init = F.struct(F.lit(0).alias("p"), F.lit(depth).alias("c"), F.array().cast(STACK).alias("own"))

    def step(acc: Column, e: Column) -> Column:
        grown = F.concat(acc["own"], F.array(e["op_seq"]))
        kept = F.when(F.size(grown) > depth, F.slice(grown, 2, depth)).otherwise(grown)
        push = F.struct(acc["p"].alias("p"), F.least(acc["c"], depth - F.size(kept)).alias("c"), kept.alias("own"))
        n = F.size(acc["own"])
        pop_own = F.struct(acc["p"].alias("p"), acc["c"].alias("c"), F.slice(acc["own"], 1, F.greatest(n - 1, F.lit(0))).alias("own"))
        pop_below = F.struct((acc["p"] + 1).alias("p"), (acc["c"] - 1).alias("c"), acc["own"].alias("own"))
        return F.when(e["op"] != "UNDO", push).when(n > 0, pop_own).otherwise(pop_below)

    return F.aggregate(items, init, step)


def _compose(a: Column, b: Column) -> Column:
    """Effect of chunk run ``a`` followed by ``b`` (associative)."""
    n = F.size(a["own"])
    left = F.greatest(n - b["p"], F.lit(0))  # own entries of a that survive the pops of b
    keep = F.greatest(F.least(left, b["c"]), F.lit(0))
    below = F.greatest(b["p"] - n, F.lit(0))
    return F.struct(
        (a["p"] + below).alias("p"),
        F.least(a["c"] - below, b["c"] - left).alias("c"),
        F.concat(F.slice(a["own"], left - keep + 1, keep), b["own"]).alias("own"),
    )


def _replay(items: Column, stack: Column, depth: int) -> Column:
    """Per event the operation it undoes (NULL otherwise), and the stack at the end."""
    out = "array<struct<op_seq:bigint,undoes:bigint>>"
    init = F.struct(stack.cast(STACK).alias("stack"), F.array().cast(out).alias("out"))

    def step(acc: Column, e: Column) -> Column:
        n = F.size(acc["stack"])
        undo = e["op"] == "UNDO"
        grown = F.concat(acc["stack"], F.array(e["op_seq"]))
        kept = F.when(F.size(grown) > depth, F.slice(grown, 2, depth)).otherwise(grown)
        popped = F.slice(acc["stack"], 1, F.greatest(n - 1, F.lit(0)))
        row = F.struct(e["op_seq"].alias("op_seq"), F.when(undo & (n > 0), F.try_element_at(acc["stack"], F.lit(-1))).alias("undoes"))
        return F.struct(
            F.when(undo, popped).otherwise(kept).alias("stack"), F.concat(acc["out"], F.array(row)).alias("out")
        )

    return F.aggregate(items, init, step)


def replay_edits(log: DataFrame, resort: str = "resort_id", depth: int = C.UNDO_DEPTH, chunk: int = C.FOLD_ROWS):
    """Replay an edit log (resort, op_seq, op) with a bounded undo stack.

    Returns (events, stacks): per event the operation it undoes and whether an UNDO found
    an empty stack; per resort chunk the final stack, of which the last chunk counts.

    The effect of a chunk on any stack is a small record, and two records combine into
    one.  A doubling scan over chunk numbers (equi-joins on resort and chunk) gives every
    chunk its true start stack in log2(chunks) rounds.
    """
    items = _chunks(log, resort, "op_seq", ["op_seq", "op"], chunk)
    scan = items.select(resort, "chunk", _effect(F.col("items"), depth).alias("f"))
    last = items.agg(F.max("chunk")).first()[0] or 0
    hop = 1
    if last > 0:
        scan = cut_lineage(scan)
    while hop <= last:
        earlier = scan.select(resort, (F.col("chunk") + hop).alias("chunk"), F.col("f").alias("_g"))
        scan = cut_lineage(
            scan.join(earlier, [resort, "chunk"], "left").select(
                resort, "chunk", F.when(F.col("_g").isNotNull(), _compose(F.col("_g"), F.col("f"))).otherwise(F.col("f")).alias("f")
            )
        )
        hop *= 2
    starts = scan.select(resort, (F.col("chunk") + 1).alias("chunk"), F.col("f.own").alias("_stack"))
    ran = items.join(starts, [resort, "chunk"], "left").select(
        resort,
        "chunk",
        _replay(F.col("items"), F.coalesce("_stack", F.array().cast(STACK)), depth).alias("r"),
    )
    events = ran.select(resort, F.explode_outer("r.out").alias("e")).select(resort, "e.op_seq", "e.undoes")
    stacks = ran.groupBy(resort).agg(F.max_by("r.stack", "chunk").alias("stack"))
    return events, stacks


def surviving_edits(log: DataFrame, resort: str = "resort_id", chunk: int = C.FOLD_ROWS) -> DataFrame:
    """Operations in force: everything but UNDO rows and what they took back."""
    events, _ = replay_edits(log, resort, chunk=chunk)
    taken = events.where(F.col("undoes").isNotNull()).select(resort, F.col("undoes").alias("op_seq"))
    return log.where(F.col("op") != "UNDO").join(taken, [resort, "op_seq"], "left_anti")


def current_tables(log: DataFrame, resort: str = "resort_id", chunk: int = C.FOLD_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, slopes and lifts in force after an edit log with undo.

    ``log``: resort, op_seq, op, entity_id, name, segment_ids.  ADD_SEGMENTS and FINISH_SLOPE list
    segments; FINISH_SLOPE and ADD_LIFT make an entity, DELETE_SLOPE (with its segments) and DELETE_LIFT remove it.
    Undo takes the latest operation in force, so the tables after it are those of the operations that remain: a
    restored slope has its segments again, and the segments of a taken back slope their own names.
    """
    alive = cut_lineage(surviving_edits(log, resort, chunk))
    of = lambda op: alive.where(F.col("op") == op)
    made = lambda op, gone: of(op).select(resort, "op_seq", "entity_id", "name", "segment_ids").join(
        of(gone).select(resort, "entity_id"), [resort, "entity_id"], "left_anti"
    )
    slopes, lifts = made("FINISH_SLOPE", "DELETE_SLOPE"), made("ADD_LIFT", "DELETE_LIFT").drop("segment_ids")
    dropped = (
        of("FINISH_SLOPE")
        .join(of("DELETE_SLOPE").select(resort, "entity_id"), [resort, "entity_id"], "left_semi")
        .select(resort, F.explode("segment_ids").alias("segment_id"))
    )
    owner = slopes.select(resort, F.explode("segment_ids").alias("segment_id"), "op_seq", F.col("name").alias("_name"))
    owner = owner.groupBy(resort, "segment_id").agg(F.min_by("_name", "op_seq").alias("_name"))
    segments = (
        of("ADD_SEGMENTS")
        .select(resort, "op_seq", F.explode("segment_ids").alias("segment_id"))
        .join(dropped, [resort, "segment_id"], "left_anti")
        .join(owner, [resort, "segment_id"], "left")
    )
    own = F.concat(F.lit("Segment "), F.substring("segment_id", len(C.ID_PREFIX["segment"]) + 1, 20))
    return segments.select(resort, "op_seq", "segment_id", F.coalesce("_name", own).alias("name")), slopes, lifts


# ---------------------------------------------------------------- transitions


def with_state_before(log: DataFrame, session: str, order: str, first: str = "IdleReady", chunk: int = C.CHUNK_ROWS) -> DataFrame:
    """State before each event: the state the preceding event led to."""
    numbered = number_rows(log, [session], [order], "_pos")
    return with_previous(numbered, [session], "_pos", {"to_state": "from_state"}, chunk).withColumn(
        "from_state", F.coalesce("from_state", F.lit(first))
    ).drop("_pos")


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Logged steps (from_state, event, n_segments, to_state) that the workflow does not allow."""
    spark = log.sparkSession
    allowed = spark.createDataFrame(C.TRANSITIONS, "from_state string, event string, guard string, to_state string")
    guards = F.when(F.col("guard") == "any", F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.col("guard") == "some"))
    allowed = allowed.select("from_state", "event", "to_state", F.explode(guards).alias("_some"))
    return log.withColumn("_some", F.col("n_segments") > 0).join(
        F.broadcast(allowed), ["from_state", "event", "to_state", "_some"], "left_anti"
    ).drop("_some")
