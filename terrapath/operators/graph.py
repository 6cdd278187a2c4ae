"""Resort graph as tables: joins, integrity, removal of parts, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions.geo import haversine_m
from terrapath.functions.paths import avg_slope_pct, belt_width_m, warnings, with_path_metrics
from terrapath.functions.terrain import classify
from terrapath.operators.scan import running_total


def slope_members(slopes: DataFrame) -> DataFrame:
    """Bridge slope -> segment with 0-based position."""
    return slopes.select("resort_id", "slope_id", F.posexplode("segment_ids").alias("pos", "segment_id"))


def segment_facts(segments: DataFrame) -> DataFrame:
    """Segments with length, drop, slopes, difficulty, width, warnings and end points."""
    s = with_path_metrics(segments)
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    return (
        s.withColumn("width_m", belt_width_m(F.col("side_slope_pct"), F.col("difficulty")))
        .withColumn(
            "warnings",
            warnings(F.col("avg_slope_pct"), F.col("side_slope_pct"), F.col("side_slope_dir"), F.col("difficulty")),
        )
        .withColumn("first_pt", first)
        .withColumn("last_pt", last)
    )


def segment_parent(segments: DataFrame, slopes: DataFrame) -> DataFrame:
    """Parent slope of every segment (first slope wins), NULL for unfinished ones."""
    number = F.substring("slope_id", len(C.ID_PREFIX["slope"]) + 1, 20).cast("long")
    owner = slope_members(slopes).groupBy("resort_id", "segment_id").agg(F.min_by("slope_id", number).alias("slope_id"))
    return segments.join(owner, ["resort_id", "segment_id"], "left")


def slope_stats(slopes: DataFrame, facts: DataFrame) -> DataFrame:
    """Totals, steepest section, difficulty and warnings per slope over the segments present."""
    parts = slope_members(slopes).join(
        facts.select("resort_id", "segment_id", "length_m", "drop_m", "max_slope_pct", F.size("warnings").alias("_w"), "first_pt", "last_pt"),
        ["resort_id", "segment_id"],
    )
    return (
        parts.groupBy("resort_id", "slope_id")
        .agg(
            F.sum("length_m").alias("length_m"),
            F.sum("drop_m").alias("drop_m"),
            F.greatest(F.max("max_slope_pct"), F.lit(0.0)).alias("steepest_pct"),
            F.bool_or(F.col("_w") > 0).alias("has_warnings"),
            F.count(F.lit(1)).alias("n_segments"),
        )
        .withColumn("difficulty", classify(F.col("steepest_pct")))
    )


def group_stats(groups: DataFrame, facts: DataFrame, key: str, ids: str) -> DataFrame:
    """Running statistics of listed segments; all defaults when the list is empty or its first or last is unknown."""
    keys = ["resort_id", key]
    listed = groups.select(*keys, F.posexplode_outer(ids).alias("pos", "segment_id"), (F.size(ids) - 1).alias("_last"))
    known = listed.join(
        facts.select("resort_id", "segment_id", "length_m", "max_slope_pct", "first_pt", "last_pt"), ["resort_id", "segment_id"], "left"
    )
    agg = known.groupBy(*keys).agg(
        F.max(F.when(F.col("pos") == 0, F.col("first_pt.elevation"))).alias("start_elev"),
        F.max(F.when(F.col("pos") == F.col("_last"), F.col("last_pt.elevation"))).alias("current_elev"),
        F.sum("length_m").alias("total_length"),
        F.max("max_slope_pct").alias("max_gradient"),
    )
    ok = F.col("start_elev").isNotNull() & F.col("current_elev").isNotNull()
    pick = lambda n: F.when(ok, F.col(n)).otherwise(F.lit(0.0))
    out = agg.select(*keys, *[pick(n).alias(n) for n in ("start_elev", "current_elev", "total_length", "max_gradient")])
    drop = F.col("start_elev") - F.col("current_elev")
    return (
        out.withColumn("total_drop", drop)
        .withColumn("avg_gradient", avg_slope_pct(F.col("total_drop"), F.col("total_length")))
        .withColumn("difficulty", classify(F.col("max_gradient")))
    )


def edges(segments: DataFrame, lifts: DataFrame) -> DataFrame:
    """Segments and lifts as edges of the resort graph."""
    seg = segments.select(
        "resort_id", F.lit("segment").alias("kind"), F.col("segment_id").alias("edge_id"), "start_node_id", "end_node_id"
    )
    lift = lifts.select(
        "resort_id", F.lit("lift").alias("kind"), F.col("lift_id").alias("edge_id"), "start_node_id", "end_node_id"
    )
    return seg.unionByName(lift)


def degrees(nodes: DataFrame, all_edges: DataFrame) -> DataFrame:
    """Edges touching every node; a loop counts once."""
    ends = all_edges.select("resort_id", F.explode(F.array_distinct(F.array("start_node_id", "end_node_id"))).alias("node_id"))
    counts = ends.groupBy("resort_id", "node_id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(counts, ["resort_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def connected_nodes(nodes: DataFrame, all_edges: DataFrame, keep: bool = True) -> DataFrame:
    """Nodes with (or without) an edge."""
    ends = all_edges.select("resort_id", F.explode(F.array("start_node_id", "end_node_id")).alias("node_id"))
    return nodes.join(ends, ["resort_id", "node_id"], "left_semi" if keep else "left_anti")


def delete_slopes(slopes: DataFrame, segments: DataFrame, lifts: DataFrame, nodes: DataFrame, gone: DataFrame):
    """Remove slopes (resort_id, slope_id) with their segments and the nodes left alone."""
    gone_segments = slope_members(slopes.join(gone, ["resort_id", "slope_id"], "left_semi")).select("resort_id", "segment_id")
    slopes = slopes.join(gone, ["resort_id", "slope_id"], "left_anti")
    segments = segments.join(gone_segments, ["resort_id", "segment_id"], "left_anti")
    return slopes, segments, connected_nodes(nodes, edges(segments, lifts))


def delete_lifts(segments: DataFrame, lifts: DataFrame, nodes: DataFrame, gone: DataFrame):
    lifts = lifts.join(gone, ["resort_id", "lift_id"], "left_anti")
    return lifts, connected_nodes(nodes, edges(segments, lifts))


def cancel_building(segments: DataFrame, slopes: DataFrame, log: DataFrame, lifts: DataFrame, nodes: DataFrame):
    """Drop unfinished segments, undo entries that touch them and the nodes left alone.

    ``log``: resort_id, op_seq, op, segment_ids.
    """
    finished = slope_members(slopes).select("resort_id", "segment_id").distinct()
    open_segments = segments.join(finished, ["resort_id", "segment_id"], "left_anti").select("resort_id", "segment_id")
    touched = (
        log.where(F.col("op") == "ADD_SEGMENTS")
        .select("resort_id", "op_seq", F.explode("segment_ids").alias("segment_id"))
        .join(open_segments, ["resort_id", "segment_id"], "left_semi")
        .select("resort_id", "op_seq")
        .distinct()
    )
    kept = segments.join(finished, ["resort_id", "segment_id"], "left_semi")
    return kept, log.join(touched, ["resort_id", "op_seq"], "left_anti"), connected_nodes(nodes, edges(kept, lifts))


def joined_points(groups: DataFrame, segments: DataFrame, key: str, skip_junctions: bool = True) -> DataFrame:
    """Points of listed segments in order, one row per point with a dense position.

    ``groups``: resort_id, key, pos, segment_id.  Segment offsets are a running total, so a slope
    of any number of segments is never collected into one row.
    """
    keys = ["resort_id", key]
    parts = groups.join(segments.select("resort_id", "segment_id", "points"), ["resort_id", "segment_id"]).withColumn("_n", F.size("points"))
    ran = running_total(parts, keys, "pos", {"_sum": F.col("_n"), "_cnt": (F.col("_n") > 0).cast("int")})
    before, cut = F.col("_sum") - F.col("_n"), F.col("_cnt") - (F.col("_n") > 0).cast("int")
    if skip_junctions:
        first = F.when(before > 0, F.lit(1)).otherwise(F.lit(0))
        base = before - F.greatest(cut - 1, F.lit(0)) - first
    else:
        first, base = F.lit(0), before
    return (
        ran.select(*keys, "segment_id", base.alias("_base"), first.alias("_first"), F.posexplode("points").alias("_j", "p"))
        .where(F.col("_j") >= F.col("_first"))
        .select(*keys, "segment_id", (F.col("_base") + F.col("_j")).alias("i"), "p.lon", "p.lat", "p.elevation")
    )


def with_end_nodes(edge: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """Attach start and end node positions (columns a_*, b_*)."""
    at = lambda p, k: nodes.select(
        "resort_id", F.col("node_id").alias(k), *[F.col(n).alias(f"{p}_{n}") for n in ("lon", "lat", "elevation")]
    )
    return edge.join(at("a", "start_node_id"), ["resort_id", "start_node_id"], how).join(
        at("b", "end_node_id"), ["resort_id", "end_node_id"], how
    )


def lift_rise(joined: DataFrame) -> Column:
    return F.coalesce(F.col("b_elevation") - F.col("a_elevation"), F.lit(0.0))


def lift_length() -> Column:
    return haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))


def resort_stats(slopes: DataFrame, facts: DataFrame, lifts: DataFrame, stats: DataFrame) -> DataFrame:
    """Counts, totals and longest run per resort; run figures are zero without segments."""
    seg = facts.groupBy("resort_id").agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.sum("drop_m").alias("total_vertical_m"),
        F.sum("length_m").alias("total_length_m"),
        F.max("length_m").alias("_long_seg"),
    )
    longest = stats.groupBy("resort_id").agg(F.max("length_m").alias("_long_slope"))
    n_slopes = slopes.groupBy("resort_id").agg(F.count(F.lit(1)).alias("total_slopes"))
    n_lifts = lifts.groupBy("resort_id").agg(F.count(F.lit(1)).alias("total_lifts"))
    full = seg.join(longest, "resort_id", "full").join(n_slopes, "resort_id", "full").join(n_lifts, "resort_id", "full")
    some = F.col("total_segments") > 0
    zero = lambda n: F.when(some, F.coalesce(n, F.lit(0))).otherwise(F.lit(0)).alias(n)
    return full.withColumn("longest_run_m", F.greatest("_long_seg", "_long_slope")).select(
        "resort_id",
        zero("total_slopes"),
        zero("total_segments"),
        zero("total_vertical_m"),
        zero("total_length_m"),
        zero("longest_run_m"),
        F.coalesce("total_lifts", F.lit(0)).alias("total_lifts"),
    )
