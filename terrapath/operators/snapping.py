"""Nearest-node joins and sequential node snapping on a metric grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions.geo import haversine_m
from terrapath.operators.scan import cut_lineage, running_total

BUSY_PARTS = 8  # parts of a bucket of nodes that points are spread over
M_PER_DEG = C.EARTH_RADIUS_M * math.pi / 180.0


def _band(lat: Column, size_m: float) -> Column:
    return F.floor(lat * (M_PER_DEG / size_m))


def _lon_width(band: Column, size_m: float, largest: bool) -> Column:
    """Degrees of longitude per bucket in a latitude band.

    ``largest``: every bucket is at least ``size_m`` wide; otherwise at most.
    """
    step = size_m / M_PER_DEG
    low, high = F.abs(band * step), F.abs((band + 1) * step)
    edge = F.greatest(low, high) if largest else F.least(low, high)
    return F.lit(step) / F.greatest(F.cos(F.radians(edge)), F.lit(0.001))


def bucket(lon: Column, lat: Column, size_m: float, largest: bool = True) -> Column:
    band = _band(lat, size_m)
    return F.struct(band.alias("b"), F.floor(lon / _lon_width(band, size_m, largest)).alias("c"))


def buckets_within(lon: Column, lat: Column, reach_m: float, size_m: float, largest: bool = True) -> Column:
    """All buckets that can hold a point within ``reach_m``."""
    ring = math.ceil(reach_m / size_m)
    step = reach_m * 1.0001 / M_PER_DEG
    dlon = F.lit(step) / F.greatest(F.cos(F.radians(F.abs(lat) + step)), F.lit(0.001))
    bands = F.sequence(_band(lat, size_m) - ring, _band(lat, size_m) + ring)

    def columns(b: Column) -> Column:
        w = _lon_width(b, size_m, largest)
        return F.transform(
            F.sequence(F.floor((lon - dlon) / w), F.floor((lon + dlon) / w)),
            lambda k: F.struct(b.alias("b"), k.alias("c")),
        )

    return F.flatten(F.transform(bands, columns))


def nearest_node(
    points: DataFrame, nodes: DataFrame, point_key: str, threshold_m: float = C.NODE_SNAP_M, scope: list[str] | None = None
) -> DataFrame:
    """Nearest node strictly within the threshold; the earliest node wins a tie.

    ``nodes``: node_id, node_ord, lon, lat (+ scope columns).  Nodes sit in one bucket
    of threshold size, every point looks into the buckets around it (at most 9), and
    the winner is a partial aggregate per point.  Nodes on the same spot are reduced
    to the first one beforehand, so stacked nodes cannot blow up a bucket.  Points on the
    same spot are looked up once, and the points of a busy bucket are spread over several parts.
    """
    scope = scope or []
    firsts = nodes.groupBy(*scope, "lon", "lat").agg(F.min_by(F.struct("node_id", "node_ord"), "node_ord").alias("n"))
    grid = firsts.select(
        *scope,
        F.col("n.node_id").alias("_node_id"),
        F.col("n.node_ord").alias("_ord"),
        F.col("lon").alias("_lon"),
        F.col("lat").alias("_lat"),
        bucket(F.col("lon"), F.col("lat"), threshold_m).alias("_bucket"),
        F.explode(F.sequence(F.lit(0), F.lit(BUSY_PARTS - 1))).alias("_part"),
    )
    spot = [*scope, "lon", "lat"]
    look = points.select(*spot).distinct().select(
        *spot,
        F.explode(buckets_within(F.col("lon"), F.col("lat"), threshold_m, threshold_m)).alias("_bucket"),
        F.pmod(F.xxhash64("lon", "lat"), F.lit(BUSY_PARTS)).cast("int").alias("_part"),
    )
    d = haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    near = look.join(grid, [*scope, "_bucket", "_part"]).withColumn("_d", d).where(F.col("_d") < threshold_m)
    best = near.groupBy(*spot).agg(
        F.min_by(F.struct("_node_id", "_d"), F.struct("_d", "_ord")).alias("_best")
    )
    return (
        points.join(best, spot, "left")
        .withColumn("node_id", F.col("_best._node_id"))
        .withColumn("distance_m", F.col("_best._d"))
        .drop("_best")
    )


def snap_sequence(
    points: DataFrame,
    scope: str,
    order: str,
    existing: DataFrame | None = None,
    counters: DataFrame | None = None,
    reach_m: float = C.NODE_SNAP_M,
) -> DataFrame:
    """Sequential get-or-create of nodes, computed in rounds over all points at once.

    In arrival order a point joins the nearest node within reach, else becomes a node.
    The grid cell is small enough that two points of one cell are always in reach, so
    a cell holds at most one node and only the earliest undecided point of a cell can
    become one.  Per round, the earliest point of a cell becomes a node when no cell
    within reach holds an earlier undecided point; then every point with an earlier
    node in reach is settled.  The outcome is the sequential one.

    ``counters``: scope and ``used``, the number of nodes already numbered there.

    Busy cells cost nothing extra: cell minima are partial aggregates and each point
    meets at most one node per cell.
    """
    size = reach_m / math.sqrt(2.0) * 0.99
    here = bucket(F.col("lon"), F.col("lat"), size, largest=False)
    around = buckets_within(F.col("lon"), F.col("lat"), reach_m, size, largest=False)

    base = cut_lineage(points.select(scope, order, "lon", "lat", "elevation").withColumn("_cell", here))
    spot = ["lon", "lat"]
    seeds = None
    if existing is not None:
        seeds = existing.select(scope, F.lit(None).cast("long").alias(order), *spot, "elevation", "node_id", "node_ord")
    created: DataFrame | None = None
    open_points = base

    def settle(pts: DataFrame, nodes: DataFrame) -> DataFrame:
        """Points of ``pts`` without an earlier node in reach."""
        reach = nodes.select(
            scope, F.col(order).alias("_o"), F.col("lon").alias("_x"), F.col("lat").alias("_y"), F.explode(around).alias("_cell")
        )
        d = haversine_m(F.col("_y"), F.col("_x"), F.col("lat"), F.col("lon"))
        hit = pts.join(reach, [scope, "_cell"]).where(
            (d < reach_m) & (F.col("_o").isNull() | (F.col("_o") <= F.col(order)))
        )
        return pts.join(hit.select(scope, order).distinct(), [scope, order], "left_anti")

    if seeds is not None:
        open_points = cut_lineage(settle(open_points, seeds))
    while not open_points.isEmpty():
        firsts = open_points.groupBy(scope, "_cell").agg(
            F.min(F.struct(order, "lon", "lat", "elevation")).alias("p")
        )
        claims = firsts.select(
            scope, F.explode(buckets_within(F.col("p.lon"), F.col("p.lat"), reach_m, size, largest=False)).alias("_cell"), "p"
        )
        # a cell minimum is free when it is the earliest in every cell it can reach
        seen = claims.join(
            firsts.select(scope, "_cell", F.col(f"p.{order}").alias("_other")), [scope, "_cell"]
        )
        free = seen.groupBy(scope, F.col(f"p.{order}").alias(order)).agg(
            F.min("_other").alias("_earliest"), F.first("p").alias("p")
        )
        new = cut_lineage(
            free.where(F.col("_earliest") >= F.col(order)).select(scope, order, "p.lon", "p.lat", "p.elevation")
        )
        created = new if created is None else created.unionByName(new)
        open_points = cut_lineage(settle(open_points, new))

    nodes = None
    if created is not None:
        numbered = running_total(created, [scope], order, {"_n": F.lit(1)})
        if counters is not None:
            numbered = numbered.join(counters, scope, "left").withColumn("_n", F.col("_n") + F.coalesce("used", F.lit(0)))
        nodes = numbered.select(scope, order, *spot, "elevation", F.concat(F.lit("N"), "_n").alias("node_id"), F.col("_n").alias("node_ord"))
    if seeds is not None:
        nodes = seeds if nodes is None else nodes.unionByName(seeds)
    nodes = cut_lineage(nodes)
    reach = nodes.select(
        scope,
        F.col(order).alias("_o"),
        F.col("lon").alias("_x"),
        F.col("lat").alias("_y"),
        "node_id",
        "node_ord",
        F.explode(around).alias("_cell"),
    )
    d = haversine_m(F.col("_y"), F.col("_x"), F.col("lat"), F.col("lon"))
    pairs = (
        base.join(reach, [scope, "_cell"])
        .withColumn("_d", d)
        .where((F.col("_d") < reach_m) & (F.col("_o").isNull() | (F.col("_o") <= F.col(order))))
    )
    # a point that became a node is its own node even if an equal distance appears
    rank = F.struct(F.when(F.col("_o") == F.col(order), 0).otherwise(1), "_d", "node_ord")
    return pairs.groupBy(scope, order).agg(
        F.min_by("node_id", rank).alias("node_id"),
        F.max(F.coalesce(F.col("_o") == F.col(order), F.lit(False))).alias("created"),
    )
