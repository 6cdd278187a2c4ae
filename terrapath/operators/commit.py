"""Graph growth: committing proposals and finishing slopes in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapath.functions.geo import bearing_deg
from terrapath.functions.paths import id_number, slope_name
from terrapath.functions.terrain import side_slope
from terrapath.operators.graph import slope_members
from terrapath.operators.scan import running_total
from terrapath.operators.snapping import snap_sequence
from terrapath.sources import dem as D


def commit_paths(
    proposals: DataFrame,
    cells: DataFrame,
    meta: D.DemMeta,
    existing: DataFrame | None = None,
    counters: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Commit proposals (resort_id, ord, points, target_node_id) in order.

    Returns the segments, and the rejected proposals with a reason: a proposal needs two points.
    Empty proposals are skipped.  Ends snap to nodes within 30 m in arrival order.  A connector to an
    existing node takes that node and ends exactly on it.  ``counters``: resort_id, node,
    segment, the highest numbers each resort has used (none: 0).
    """
    p = proposals.where(F.size("points") >= 2)
    rejected = proposals.where(F.size("points") == 1).select("resort_id", "ord", F.lit("a path needs at least two points").alias("reason"))
    if existing is not None:
        target = existing.select("resort_id", F.col("node_id").alias("target_node_id"), F.struct("lon", "lat", "elevation").alias("_to"))
        p = p.join(target, ["resort_id", "target_node_id"], "left")
        last = F.concat(F.slice("points", 1, F.size("points") - 1), F.array("_to"))
        p = p.withColumn("points", F.when(F.col("_to").isNotNull(), last).otherwise(F.col("points")))
    else:
        p = p.withColumn("_to", F.lit(None).cast("struct<lon:double,lat:double,elevation:double>"))
    ends = F.array(
        F.struct((F.col("ord") * 2).alias("end_ord"), F.element_at("points", 1).alias("p")),
        F.struct(F.when(F.col("_to").isNull(), F.col("ord") * 2 + 1).alias("end_ord"), F.element_at("points", -1).alias("p")),
    )
    loose = p.select("resort_id", F.inline(ends)).where(F.col("end_ord").isNotNull()).select("resort_id", "end_ord", "p.*")
    used = None if counters is None else counters.select("resort_id", F.col("node").alias("used"))
    snapped = snap_sequence(loose, "resort_id", "end_ord", existing, used)
    at = lambda name, off: snapped.select(
        "resort_id", ((F.col("end_ord") - off) / 2).cast("long").alias("ord"), F.col("node_id").alias(name)
    ).where((F.col("end_ord") % 2) == off)
    snapped = snapped.select("resort_id", "end_ord", "node_id")
    p = p.join(at("start_node_id", 0), ["resort_id", "ord"]).join(at("_end", 1), ["resort_id", "ord"], "left")
    p = p.withColumn("end_node_id", F.coalesce("_end", "target_node_id")).drop("_end", "_to")
    numbered = running_total(p, ["resort_id"], "ord", {"_n": F.lit(1)})
    if counters is not None:
        numbered = numbered.join(counters.select("resort_id", "segment"), "resort_id", "left")
        numbered = numbered.withColumn("_n", F.col("_n") + F.coalesce("segment", F.lit(0))).drop("segment")
    key = F.concat_ws("/", "resort_id", "ord")
    a, b = F.element_at("points", 1), F.element_at("points", 2)
    heads = numbered.select(key.alias("_key"), a["lon"].alias("lon"), a["lat"].alias("lat"))
    slope = D.gradient(heads, cells, meta, "_key").select("_key", "slope_pct", "bearing_deg")
    side = side_slope(F.col("slope_pct"), F.col("bearing_deg"), a["lon"], a["lat"], b["lon"], b["lat"])
    segments = (
        numbered.withColumn("_key", key)
        .join(slope, "_key")
        .withColumn("_side", side)
        .select(
            "resort_id",
            "ord",
            F.concat(F.lit("S"), "_n").alias("segment_id"),
            F.concat(F.lit("Segment "), "_n").alias("name"),
            "points",
            "start_node_id",
            "end_node_id",
            F.col("_side.slope_pct").alias("side_slope_pct"),
            F.col("_side.direction").alias("side_slope_dir"),
        )
    )
    return segments, rejected


def finish_slopes(groups: DataFrame, facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Name listed segment groups (resort_id, slope_id, segment_ids).

    Groups whose first or last segment, or whose end node, is unknown give no slope.
    """
    listed = slope_members(groups).join(groups.select("resort_id", "slope_id", (F.size("segment_ids") - 1).alias("_last")), ["resort_id", "slope_id"])
    known = listed.join(facts.select("resort_id", "segment_id", "start_node_id", "end_node_id", "max_slope_pct", "difficulty"), ["resort_id", "segment_id"])
    heads = known.groupBy("resort_id", "slope_id").agg(
        F.max(F.when(F.col("pos") == 0, F.col("start_node_id"))).alias("start_node_id"),
        F.max(F.when(F.col("pos") == F.col("_last"), F.col("end_node_id"))).alias("end_node_id"),
        F.max_by("difficulty", "max_slope_pct").alias("difficulty"),
    )
    at = lambda p, k: nodes.select("resort_id", F.col("node_id").alias(k), *[F.col(n).alias(f"{p}_{n}") for n in ("lon", "lat", "elevation")])
    full = heads.join(at("a", "start_node_id"), ["resort_id", "start_node_id"]).join(at("b", "end_node_id"), ["resort_id", "end_node_id"])
    heading = bearing_deg(F.col("a_lon"), F.col("a_lat"), F.col("b_lon"), F.col("b_lat"))
    name = slope_name(F.col("difficulty"), id_number(F.col("slope_id"), "slope"), F.col("a_elevation"), F.col("b_elevation"), heading)
    return full.select("resort_id", "slope_id", name.alias("name"), "difficulty", "start_node_id", "end_node_id")


def rename_segments(segments: DataFrame, finished: DataFrame, slopes: DataFrame) -> DataFrame:
    """Segments take the name of the slope that was finished with them."""
    names = slope_members(slopes).join(finished.select("resort_id", "slope_id", F.col("name").alias("_new")), ["resort_id", "slope_id"])
    first = names.groupBy("resort_id", "segment_id").agg(F.min("_new").alias("_new"))
    return segments.join(first, ["resort_id", "segment_id"], "left").withColumn("name", F.coalesce("_new", "name")).drop("_new")
