"""Terrain, path, resort, lift and click tables derived row by row from the driver tables.

Pure projections (plus bounded grouping of 64-point tracks), so the derived data
grows with its source and needs no generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.sources import dem as D

TRACK_POINTS = 64
SEG_STEPS = 10


def table(spark: SparkSession, sf: str, name: str, wide: bool = False) -> DataFrame:
    """A driver table; ``wide`` spreads a scan with fewer partitions than cores (tiny files, heavy rows)."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if wide and df.rdd.getNumPartitions() < cores else df


_META: dict[str, D.DemMeta] = {}


def dem_meta(spark: SparkSession, sf: str) -> D.DemMeta:
    """Raster header: one aggregated row read from Parquet statistics."""
    if sf not in _META:
        top = table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]
        _META[sf] = D.DemMeta(10.0, 47.0, 0.0008, 0.00054, int(top) + 1, 64)
    return _META[sf]


def dem_raw(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    """Cells with the nodata marker still in place."""
    cells = D.explode_rows(table(spark, sf, "embeddings", wide), "vec_id", "embedding")
    height = (
        2000.0
        + 45.0 * F.abs(F.col("row") % 100 - 50).cast("double")
        + 15.0 * F.col("col").cast("double")
        + 20.0 * F.col("raw").cast("double")
    )
    hole = (F.col("row") * 64 + F.col("col")) % 997 == 0
    return cells.select("row", "col", F.when(hole, F.lit(-9999.0)).otherwise(height).alias("elevation"))


def dem_cells(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    return D.clean_nodata(dem_raw(spark, sf, wide), -9999.0)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("request_id"),
        (10.002 + 0.00003 * ((7 * k) % 1700).cast("double")).alias("lon"),
        (46.99 - 0.00011 * ((13 * k) % 2200).cast("double")).alias("lat"),
        (105.0 + 50.0 * (k % 19).cast("double")).alias("length_m"),
    )


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """Start and target of connection requests: valid, too far and uphill ones mixed."""
    r = F.col("request_id")
    return requests(spark, sf).select(
        "request_id",
        "lon",
        "lat",
        (F.col("lon") + 0.0004 * (r % 5 - 2).cast("double")).alias("target_lon"),
        (F.col("lat") - 0.00031 * (1 + r % 8 + F.when(r % 50 == 0, 26).otherwise(0)).cast("double")).alias("target_lat"),
    )


def resort_of(path: Column) -> Column:
    """Resort 0 holds a third of all paths, so grouped work always meets a hot key."""
    return F.when(path % 3 == 0, F.lit(0).cast("long")).otherwise(1 + F.floor(path / 8))


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.floor(F.col("event_id") / TRACK_POINTS).alias("path_id"), (F.col("event_id") % TRACK_POINTS).alias("seq"), "value"
    )
    p, s = F.col("path_id"), F.col("seq")
    return e.select(
        resort_of(p).alias("resort_id"),
        p.alias("path_id"),
        s.alias("seq"),
        (10.02 + 0.0003 * (p % 11).cast("double") + 0.00002 * (s % 3).cast("double")).alias("lon"),
        (46.95 - 0.00035 * s.cast("double") - 0.0002 * (p % 5).cast("double")).alias("lat"),
        (
            2600.0
            + 20.0 * (p % 5).cast("double")
            - 1.5 * (1 + p % 13).cast("double") * s.cast("double")
            + 4.0 * F.abs(s % 12 - 6).cast("double")
            + F.least(F.col("value"), F.lit(100.0)) / 50.0
        ).alias("elevation"),
    )


def point(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("lon", "lat", "elevation")])


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks cut every 10 steps; a junction point ends one segment and starts the next."""
    s = F.col("seq")
    seg = F.floor(s / SEG_STEPS)
    parts = F.when((s % SEG_STEPS == 0) & (s > 0), F.array(seg - 1, seg)).otherwise(F.array(seg))
    # groups hold at most 11 points, whatever the size of the source
    cut = (
        tracks(spark, sf)
        .select("*", F.explode(parts).alias("seg_no"))
        .groupBy("resort_id", "path_id", "seg_no")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "lon", "lat", "elevation"))).alias("pts"))
        .where(F.size("pts") >= 2)
    )
    n = F.col("path_id") * 8 + F.col("seg_no") + 1
    side = ((F.col("path_id") * 7 + F.col("seg_no") * 5) % 61 - 30).cast("double")
    return cut.select(
        "resort_id",
        "path_id",
        "seg_no",
        F.concat(F.lit("S"), n).alias("segment_id"),
        F.concat(F.lit("Segment "), n).alias("name"),
        F.transform("pts", lambda p: F.struct(p["lon"], p["lat"], p["elevation"])).alias("points"),
        F.concat(F.lit("N"), n).alias("start_node_id"),
        F.concat(F.lit("N"), n + 1).alias("end_node_id"),
        side.alias("side_slope_pct"),
        F.when(F.abs(side) < 2, "flat").when(side > 0, "right").otherwise("left").alias("side_slope_dir"),
    )


def slopes(spark: SparkSession, sf: str) -> DataFrame:
    """One slope per track (3 of 4 tracks); every seventh track lists one unknown segment last."""
    head = table(spark, sf, "events").select(F.floor(F.col("event_id") / 64).alias("path_id"), (F.col("event_id") % 64).alias("seq"))
    p = F.col("path_id")
    last = head.groupBy("path_id").agg(F.max("seq").alias("last_seq")).where((p % 4 != 0) & (F.col("last_seq") >= 1))
    n_seg = F.floor((F.col("last_seq") - 1) / SEG_STEPS)
    ids = F.transform(F.sequence(F.lit(0), n_seg.cast("int")), lambda i: F.concat(F.lit("S"), p * 8 + i + 1))
    dangling = F.array(F.concat(F.lit("S99000000000"), p))
    return last.select(
        resort_of(p).alias("resort_id"),
        p.alias("path_id"),
        F.concat(F.lit("SL"), p + 1).alias("slope_id"),
        F.concat(F.lit("Slope "), p + 1).alias("name"),
        F.when(p % 7 == 0, F.concat(ids, dangling)).otherwise(ids).alias("segment_ids"),
        F.concat(F.lit("N"), p * 8 + 1).alias("start_node_id"),
        F.concat(F.lit("N"), p * 8 + n_seg + 2).alias("end_node_id"),
    )


def path_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Junction nodes of the tracks."""
    s = F.col("seq")
    n = F.col("path_id") * 8 + F.when(s == TRACK_POINTS - 1, 7).otherwise(F.floor(s / SEG_STEPS)) + 1
    return (
        tracks(spark, sf)
        .where((s % SEG_STEPS == 0) | (s == TRACK_POINTS - 1))
        .select("resort_id", F.concat(F.lit("N"), n).alias("node_id"), n.alias("node_ord"), "lon", "lat", "elevation")
    )


LIFT_NODE_BASE = 100_000_000


def lift_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Bottom and top of every lift; stations stand on the raster, 2000 m outside it."""
    k = F.col("c_custkey")
    ends = table(spark, sf, "customer").select(
        resort_of(k).alias("resort_id"),
        k.alias("lift_no"),
        F.concat(F.lit("L"), k + 1).alias("lift_id"),
        F.element_at(F.array(*[F.lit(t) for t in C.LIFT_TYPES]), (k % 4 + 1).cast("int")).alias("lift_type"),
        F.concat(F.lit("N"), LIFT_NODE_BASE + 2 * k).alias("start_node_id"),
        F.concat(F.lit("N"), LIFT_NODE_BASE + 2 * k + 1).alias("end_node_id"),
        (10.002 + 0.00003 * ((7 * k) % 1700).cast("double")).alias("start_lon"),
        (46.99 - 0.00011 * ((13 * k) % 2200).cast("double")).alias("start_lat"),
    )
    ends = ends.withColumn("end_lon", F.col("start_lon") + 0.0004 * (F.col("lift_no") % 7 - 3).cast("double")).withColumn(
        "end_lat", F.col("start_lat") + 0.000103717 + 0.00120313 * (F.col("lift_no") % 13).cast("double")
    )
    cells, meta = dem_cells(spark, sf), dem_meta(spark, sf)
    for end in ("start", "end"):
        ends = D.lookup_elevation(ends, cells, meta, f"{end}_lon", f"{end}_lat", f"{end}_elevation")
        ends = ends.withColumn(f"{end}_elevation", F.coalesce(f"{end}_elevation", F.lit(2000.0)))
    return ends


def lift_nodes(spark: SparkSession, sf: str) -> DataFrame:
    ends = lift_ends(spark, sf)
    stack = F.array(
        *[
            F.struct(
                F.col(f"{e}_node_id").alias("node_id"),
                (LIFT_NODE_BASE + 2 * F.col("lift_no") + i).alias("node_ord"),
                F.col(f"{e}_lon").alias("lon"),
                F.col(f"{e}_lat").alias("lat"),
                F.col(f"{e}_elevation").alias("elevation"),
            )
            for i, e in enumerate(("start", "end"))
        ]
    )
    return ends.select("resort_id", F.inline(stack))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return path_nodes(spark, sf).unionByName(lift_nodes(spark, sf))


def stations(spark: SparkSession, sf: str) -> DataFrame:
    """A dense field of nodes, neighbours 22-23 m apart."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("node_ord"),
        F.concat(F.lit("N"), k + 1).alias("node_id"),
        (10.01 + 0.0003 * (k % 10).cast("double")).alias("lon"),
        (46.90 + 0.0002 * F.floor(k / 10).cast("double")).alias("lat"),
        (1500.0 + F.col("s_acctbal") / 20.0).alias("elevation"),
    )


def taps(spark: SparkSession, sf: str) -> DataFrame:
    """Map positions around the station field."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("tap_id"),
        (10.0099053 + 0.0003 * (k % 12).cast("double") + 0.00001 * (k % 37).cast("double")).alias("lon"),
        (46.8995037 + 0.0002 * (k % 17).cast("double") + 0.00001 * (k % 29).cast("double")).alias("lat"),
    )


def prop_k() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def edit_log(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered edit history per resort; an UNDO on an empty stack is an error row."""
    op = C_OPS
    return table(spark, sf, "events").select(
        F.col("user_id").alias("resort_id"),
        F.col("event_id").alias("op_seq"),
        F.create_map(*[F.lit(x) for kv in op.items() for x in kv])[F.col("event_type")].alias("op"),
        F.concat(F.lit("E"), "event_id").alias("entity_id"),
    )


C_OPS = {
    "view": "ADD_SEGMENTS",
    "purchase": "FINISH_SLOPE",
    "signup": "ADD_LIFT",
    "click": "DELETE_SLOPE",
    "error": "UNDO",
}
