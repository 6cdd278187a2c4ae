"""Elevation raster as a cell table: load, bounds, crop, point lookup, gradient."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions.geo import destination, let, raster_col, raster_row


class DemMeta(NamedTuple):
    """Affine transform and shape of one raster; a handful of scalars, so they become literals."""

    x0: float
    y0: float
    dx: float
    dy: float
    n_rows: int
    n_cols: int
    nodata: float = -9999.0
    scale: float = 1.0  # native units per degree

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """West, south, east, north in degrees."""
        return (
            self.x0 / self.scale,
            (self.y0 - self.n_rows * self.dy) / self.scale,
            (self.x0 + self.n_cols * self.dx) / self.scale,
            self.y0 / self.scale,
        )


def explode_rows(rows: DataFrame, row: str, values: str) -> DataFrame:
    """Raster rows stored as arrays -> one row per cell."""
    return rows.select(F.col(row).cast("long").alias("row"), F.posexplode(values).alias("col", "raw"))


def clean_nodata(cells: DataFrame, nodata: float, value: str = "elevation") -> DataFrame:
    v = F.col(value)
    return cells.withColumn(value, F.when((v != nodata) & ~F.isnan(v), v))


def with_tiles(cells: DataFrame, tile: int = C.TILE) -> DataFrame:
    return cells.withColumn("tile_r", F.floor(F.col("row") / tile)).withColumn("tile_c", F.floor(F.col("col") / tile))


def write_tiles(cells: DataFrame, path: str) -> None:
    """Tiled zstd Parquet; one output file per tile, readers prune on (tile_r, tile_c)."""
    (
        with_tiles(cells)
        .repartition("tile_r", "tile_c")
        .sortWithinPartitions("tile_r", "tile_c", "row", "col")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("tile_r", "tile_c")
        .parquet(path)
    )


def crop(cells: DataFrame, meta: DemMeta, box: tuple[float, float, float, float] = C.ALPS_BOX) -> DataFrame:
    """Cells of a west/south/east/north window; tile ranges are filtered too when the columns exist."""
    west, south, east, north = (v * meta.scale for v in box)
    col_lo, col_hi = max(0, int((west - meta.x0) / meta.dx)), min(meta.n_cols, int((east - meta.x0) / meta.dx) + 1)
    row_lo, row_hi = max(0, int((meta.y0 - north) / meta.dy)), min(meta.n_rows, int((meta.y0 - south) / meta.dy) + 1)
    keep = F.col("row").between(row_lo, row_hi - 1) & F.col("col").between(col_lo, col_hi - 1)
    if "tile_r" in cells.columns:
        keep &= F.col("tile_r").between(row_lo // C.TILE, (row_hi - 1) // C.TILE)
        keep &= F.col("tile_c").between(col_lo // C.TILE, (col_hi - 1) // C.TILE)
    return cells.where(keep)


def in_bounds(meta: DemMeta, lon: Column, lat: Column) -> Column:
    west, south, east, north = meta.bounds
    return lon.between(west, east) & lat.between(south, north)


def cell_index(meta: DemMeta, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Row and column of the cell under a point; NULL outside the raster."""
    r, c = raster_row(lat, meta.y0, meta.dy, meta.scale), raster_col(lon, meta.x0, meta.dx, meta.scale)
    inside = r.between(0, meta.n_rows - 1) & c.between(0, meta.n_cols - 1)
    return F.when(inside, r.cast("long")), F.when(inside, c)


def lookup_elevation(
    points: DataFrame, cells: DataFrame, meta: DemMeta, lon: str = "lon", lat: str = "lat", out: str = "elevation"
) -> DataFrame:
    """Nearest-cell elevation by a left equi-join on the cell key; NULL outside coverage."""
    row, col = cell_index(meta, F.col(lon), F.col(lat))
    grid = cells.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("elevation").alias(out))
    return (
        points.withColumn("_row", row).withColumn("_col", col).join(grid, ["_row", "_col"], "left").drop("_row", "_col")
    )


def ring_samples(meta: DemMeta, lon: Column, lat: Column) -> Column:
    """Centre plus 8 bearings on 2 rings: cell, x/y slope factor and weight per sample."""
    ring = [(0.0, 0.0, 0.0, 0.0, 0.0)]
    for r, w in C.RINGS:
        for b in C.RING_BEARINGS:
            k = w * 100.0 / r
            ring.append((b, r, w, k * math.sin(math.radians(b)), k * math.cos(math.radians(b))))
    names = ("b", "r", "w", "kx", "ky")
    samples = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, s, strict=True)]) for s in ring])

    def place(s: Column) -> Column:
        here = F.struct(lon.alias("lon"), lat.alias("lat"))
        spot = F.when(s["r"] > 0, destination(lon, lat, s["b"], s["r"])).otherwise(here)

        def cell(p: Column) -> Column:
            row, col = cell_index(meta, p["lon"], p["lat"])
            ok = (s["r"] == 0) | in_bounds(meta, p["lon"], p["lat"])
            return F.struct(
                F.when(ok, row).alias("row"), F.when(ok, col).alias("col"), s["kx"].alias("kx"), s["ky"].alias("ky"), s["w"].alias("w")
            )

        return let(spot, cell)

    return F.filter(F.transform(samples, place), lambda s: s["row"].isNotNull() & s["col"].isNotNull())


def gradient(
    points: DataFrame, cells: DataFrame, meta: DemMeta, key: str, lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Smoothed gradient per point: key, elevation, slope_pct, bearing_deg.

    Weighted mean of 16 directional slopes.  Samples outside the raster or without
    data drop out together with their weight; a missing centre gives (0, 0).  One
    left join on the cell key and one aggregation per point key; the samples of a
    point fall on a few cells, so they are summed per cell before the join.
    """
    spread = points.select(key, F.explode_outer(ring_samples(meta, F.col(lon), F.col(lat))).alias("s"))
    per_cell = spread.groupBy(key, F.col("s.row").alias("row"), F.col("s.col").alias("col")).agg(
        F.sum("s.kx").alias("kx"),
        F.sum("s.ky").alias("ky"),
        F.sum("s.w").alias("w"),
        F.max(F.col("s.w") == 0.0).alias("centre"),
    )
    grid = cells.select("row", "col", F.col("elevation").alias("z"))
    hit = per_cell.join(grid, ["row", "col"], "left")
    seen = F.col("z").isNotNull()
    sums = hit.groupBy(key).agg(
        F.max(F.when(F.col("centre"), F.col("z"))).alias("elevation"),
        F.sum(F.when(seen, F.col("kx"))).alias("sx"),
        F.sum(F.when(seen, F.col("ky"))).alias("sy"),
        F.sum(F.when(seen, F.col("kx") * F.col("z"))).alias("sxz"),
        F.sum(F.when(seen, F.col("ky") * F.col("z"))).alias("syz"),
        F.sum(F.when(seen, F.col("w"))).alias("sw"),
    )
    usable = F.col("elevation").isNotNull() & (F.col("sw") > 0)
    gx = (F.col("elevation") * F.col("sx") - F.col("sxz")) / F.col("sw")
    gy = (F.col("elevation") * F.col("sy") - F.col("syz")) / F.col("sw")
    return (
        sums.withColumn("gx", F.when(usable, gx))
        .withColumn("gy", F.when(usable, gy))
        .select(
            key,
            "elevation",
            F.coalesce(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), F.lit(0.0)).alias("slope_pct"),
            F.coalesce(
                F.pmod(F.degrees(F.atan2(F.col("gx"), F.col("gy"))) + 360.0, F.lit(360.0)), F.lit(0.0)
            ).alias("bearing_deg"),
        )
    )
