"""Downhill tracing and proposal fans for many starts at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions.paths import avg_slope_pct, grade_name
from terrapath.functions.terrain import classify
from terrapath.functions.tracing import Patch, trace
from terrapath.operators.scan import cut_lineage, hot_key_salts, spread_groups
from terrapath.sources import dem as D

TRACED = "lons array<double>, lats array<double>, elevations array<double>, length_m double"


def halo_cells(meta: D.DemMeta, max_length_m: float) -> tuple[int, int]:
    """Rows and columns a trace (plus its sampling ring) can leave its start tile."""
    reach = (math.ceil(max_length_m / C.STEP_M) + 1) * C.STEP_M + C.RINGS[-1][0]
    _, south, _, north = meta.bounds
    shrink = max(0.05, math.cos(math.radians(max(abs(south), abs(north)))))
    metre = C.METERS_PER_DEGREE / meta.scale
    return math.ceil(reach / (meta.dy * metre)) + 1, math.ceil(reach / (meta.dx * metre * shrink)) + 1


def tile_strips(cells: DataFrame, meta: D.DemMeta, max_length_m: float, active: DataFrame, tile: int = C.TILE) -> DataFrame:
    """Raster patches (tile plus halo) of the ``active`` tiles, one row per raster row with bounded arrays of columns and elevations."""
    hr, hc = halo_cells(meta, max_length_m)

    def reached(axis: str, halo: int) -> Column:
        low, high = F.col(axis) * tile - halo, F.col(axis) * tile + (tile - 1 + halo)
        return F.explode(F.sequence(F.floor(low / tile), F.floor(high / tile)))

    # the few active tiles are widened, not the raster: a cell is copied only for active tiles it can reach
    sources = active.select(F.col("tile_r").alias("_tr"), F.col("tile_c").alias("_tc"), reached("tile_r", hr).alias("_r"))
    sources = sources.select("*", reached("_tc", hc).alias("_c"))
    home = cells.select(
        "row", "col", F.col("elevation").alias("z"), F.floor(F.col("row") / tile).alias("_r"), F.floor(F.col("col") / tile).alias("_c")
    )
    near = lambda axis, t, halo: F.col(axis).between(F.col(t) * tile - halo, F.col(t) * tile + (tile - 1 + halo))
    return (
        home.join(sources, ["_r", "_c"])
        .where(near("row", "_tr", hr) & near("col", "_tc", hc))
        .groupBy(F.col("_tr").alias("tile_r"), F.col("_tc").alias("tile_c"), "row")
        .agg(F.sort_array(F.collect_list(F.struct("col", "z"))).alias("_s"))
        .select("tile_r", "tile_c", "row", F.col("_s.col").alias("cols"), F.col("_s.z").alias("heights"))
    )


def gauss_array(key: Column, seed: int, n: int) -> Column:
    """Standard normal numbers of a trace, reproducible from its key."""
    unit = lambda i, salt: (
        F.pmod(F.xxhash64(key, i, F.lit(seed), F.lit(salt)), F.lit(2**31)).cast("double") + 0.5
    ) / float(2**31)
    return F.transform(
        F.sequence(F.lit(1), F.lit(n)),
        lambda i: F.sqrt(-2.0 * F.log(unit(i, 1))) * F.cos(F.lit(6.283185307179586) * unit(i, 2)),
    )


def trace_downhill(
    starts: DataFrame,
    cells: DataFrame,
    meta: D.DemMeta,
    key: str,
    max_length_m: float = C.LENGTH_MAX_M,
    seed: int | None = None,
    group_rows: int = C.GROUP_ROWS,
) -> DataFrame:
    """Trace one path per row of ``starts`` (key, lon, lat, target_slope_pct, side, length_m).

    A trace is a recurrence of up to 35 steps with 17 raster reads each, so it runs
    next to its raster patch instead of as 35 joins.  Starts meet the patch of their
    tile in one cogroup; a busy tile is split into groups of about ``group_rows``
    starts and only tiles with starts are read.  Rows without a valid path keep NULL points.
    """
    row, col = D.cell_index(meta, F.col("lon"), F.col("lat"))
    work = starts.select(key, "lon", "lat", "target_slope_pct", "side", F.col("length_m").alias("_want"))
    if seed is not None:
        work = work.withColumn("_gauss", gauss_array(F.col(key), seed, math.ceil(max_length_m / C.STEP_M) + 2))
    work = work.withColumn("tile_r", F.floor(row / C.TILE)).withColumn("tile_c", F.floor(col / C.TILE)).where(
        F.col("tile_r").isNotNull() & F.col("tile_c").isNotNull()
    )
    salts = hot_key_salts(work, ["tile_r", "tile_c"], group_rows)
    work = (
        work.join(salts, ["tile_r", "tile_c"])
        .withColumn("_salt", F.pmod(F.xxhash64(key), F.col("_salts")).cast("int"))
        .drop("_salts")
    )
    strips = (
        tile_strips(cells, meta, max_length_m, salts)
        .join(salts, ["tile_r", "tile_c"])
        .select("*", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
        .drop("_salts")
    )
    group = ["tile_r", "tile_c", "_salt"]
    key_type = dict(starts.dtypes)[key]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({key: [], "lons": [], "lats": [], "elevations": [], "length_m": []})
        patch = Patch.of(meta, right)
        sign = np.where(left["side"].to_numpy() == "left", -1.0, 1.0)
        gauss = np.stack(left["_gauss"].tolist()) if "_gauss" in left else None
        num = lambda n: left[n].to_numpy(dtype=float)
        out, dist = trace(patch, num("lon"), num("lat"), num("target_slope_pct"), sign, num("_want"), gauss)
        size = (~np.isnan(out[2])).sum(axis=1)
        take = lambda k: [out[k, i, : size[i]] for i in range(len(left))]
        done = pd.DataFrame({key: left[key], "lons": take(0), "lats": take(1), "elevations": take(2), "length_m": dist})
        return done[size >= C.MIN_PATH_POINTS]

    traced = (
        spread_groups(work, group).groupBy(*group).cogroup(strips.groupBy(*group)).applyInPandas(run, f"{key} {key_type}, {TRACED}")
    )
    points = F.transform(
        F.arrays_zip("lons", "lats", "elevations"),
        lambda p: F.struct(p["lons"].alias("lon"), p["lats"].alias("lat"), p["elevations"].alias("elevation")),
    )
    drop = F.element_at("elevations", 1) - F.element_at("elevations", -1)
    summary = traced.select(
        key,
        points.alias("points"),
        "length_m",
        drop.alias("drop_m"),
        avg_slope_pct(drop, F.col("length_m")).alias("avg_slope_pct"),
    ).withColumn("difficulty", classify(F.col("avg_slope_pct")))
    return starts.drop("length_m").join(summary, key, "left")


def expand_grades(starts: DataFrame, terrain_slope: str) -> DataFrame:
    """Grades x sides of every start: centre where the target needs at least the terrain slope."""
    grades = F.array(
        *[
            F.struct(F.lit(o).alias("grade_ord"), F.lit(d).alias("target_difficulty"), F.lit(g).alias("grade"), F.lit(t).alias("target_slope_pct"))
            for o, d, g, t in C.GRADE_TARGETS
        ]
    )
    sides = F.when(
        F.col("target_slope_pct") >= F.col(terrain_slope), F.array(F.lit("center"))
    ).otherwise(F.array(F.lit("left"), F.lit("right")))
    return (
        starts.select("*", F.inline(grades))
        .select("*", F.posexplode(sides).alias("_s", "side"))
        .withColumn("ord", F.col("grade_ord") * 2 + F.col("_s"))
        .withColumn("sector_name", grade_name(F.col("target_difficulty"), F.col("side"), F.col("grade")))
        .drop("_s")
    )


def center_stop(traces: DataFrame, request: str, traced: Column) -> DataFrame:
    """Drop the grades after the stop: more than 4 centre grades with green, blue and red traced before.

    At most 16 rows per request, so the windows stay tiny.
    """
    upto = W.partitionBy(request).orderBy("grade_ord").rangeBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(request).orderBy("grade_ord").rangeBetween(W.unboundedPreceding, -1)
    center = F.col("side") == "center"

    def had(d: str) -> Column:
        hit = F.when(traced & (F.col("target_difficulty") == d), 1).otherwise(0)
        return F.coalesce(F.sum(hit).over(before), F.lit(0)) > 0

    fired = (
        center & (F.sum(center.cast("int")).over(upto) > C.MAX_CENTER_PATHS) & had("green") & had("blue") & had("red")
    )
    marked = traces.withColumn("_fired", fired.cast("int"))
    stopped = F.coalesce(F.sum("_fired").over(before), F.lit(0)) > 0
    return marked.withColumn("_stopped", stopped).where(~F.col("_stopped")).drop("_fired", "_stopped")


def generate_fan(
    starts: DataFrame, cells: DataFrame, meta: D.DemMeta, request: str = "request_id", seed: int | None = None
) -> DataFrame:
    """Up to 16 proposals per start (request, lon, lat, length_m), in grade order."""
    place = ["lon", "lat", "length_m"]
    # equal starts give equal fans: each is traced once, and its slope is read once for all lengths
    first = starts.groupBy(*place).agg(F.min(request).alias("_first"))
    spots = first.groupBy("lon", "lat").agg(F.min("_first").alias("_spot"))
    slope = D.gradient(spots, cells, meta, "_spot").where(F.col("elevation").isNotNull())
    slope = spots.join(slope.select("_spot", F.col("slope_pct").alias("terrain_slope_pct")), "_spot").drop("_spot")
    known = cut_lineage(first.join(slope, ["lon", "lat"]))
    wanted = expand_grades(known, "terrain_slope_pct").withColumn("_trace", F.col("_first") * 16 + F.col("ord"))
    traced = trace_downhill(wanted, cells, meta, "_trace", seed=seed)
    # told by the length, so that the points need not travel where nobody asks for them
    has_path = F.col("length_m").isNotNull()
    kept = center_stop(traced, "_first", has_path).where(has_path).drop("_trace", "lon", "lat")
    members = starts.join(known.select("_first", *place), place).drop("length_m")
    return members.join(kept, "_first").drop("_first")
