"""Lift engineering: terrain profile, pylons, cable, what-if types.

A lift is one row with bounded arrays (a terrain point every 30 m), so pylon search
and cable shape are array expressions on that row: no shuffle beyond the terrain lookup.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from terrapath import config as C
from terrapath.functions.geo import bearing_deg, num
from terrapath.functions.liftline import cable_points, line_m, line_points, pylon_search
from terrapath.functions.paths import id_number, lift_name
from terrapath.functions.rules import lift_nodes_differ, lift_uphill
from terrapath.functions.terrain import lookup
from terrapath.operators.snapping import snap_sequence
from terrapath.sources import dem as D

PYLON_KEYS = ["pylon_height", "station_height", "min_spacing", "max_spacing", "min_clearance", "sag"]


def spec(lift_type: Column, name: str, fallback: str | None = None) -> Column:
    value = lookup({t: v[PYLON_KEYS.index(name)] for t, v in C.PYLON_TABLE.items()}, lift_type)
    return F.coalesce(value, F.lit(C.PYLON_TABLE[fallback][PYLON_KEYS.index(name)])) if fallback else value


@F.arrow_udf(DoubleType())
def _lines_m(lat1: pa.Array, lon1: pa.Array, lat2: pa.Array, lon2: pa.Array) -> pa.Array:
    ends = zip(*(a.to_pylist() for a in (lat1, lon1, lat2, lon2)), strict=True)
    return pa.array([None if None in p else line_m(*p) for p in ends], pa.float64())


@F.arrow_udf(ArrayType(StructType().add("lon", DoubleType()).add("lat", DoubleType())))
def _lines(lon1: pa.Array, lat1: pa.Array, lon2: pa.Array, lat2: pa.Array) -> pa.Array:
    lons, lats, offsets = [], [], [0]
    for p in zip(*(a.to_pylist() for a in (lon1, lat1, lon2, lat2)), strict=True):
        x, y = line_points(*p)
        lons += x
        lats += y
        offsets.append(len(lons))
    points = pa.StructArray.from_arrays([pa.array(lons, pa.float64()), pa.array(lats, pa.float64())], ["lon", "lat"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), points)


def distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance to the last bit as the C library gives it; latitude first."""
    return _lines_m(*map(num, (lat1, lon1, lat2, lon2)))


def length_between() -> Column:
    """Station distance, to the last bit as the C library gives it.

    On even ground two samples as far from the middle of a span need the same clearance, and the last bits
    of the sample spacing tell which is found worse.  The JVM rounds its sines and arcs differently there.
    """
    return distance_m(*map(F.col, ("start_lat", "start_lon", "end_lat", "end_lon")))


def terrain_samples(lifts: DataFrame, cells: DataFrame, meta: D.DemMeta) -> DataFrame:
    """Points along the lift line, one row per point (resort_id, lift_id, i, n, lon, lat, elevation)."""
    spots = _lines(*map(F.col, ("start_lon", "start_lat", "end_lon", "end_lat")))
    line = (
        lifts.select("resort_id", "lift_id", "start_elevation", "end_elevation", spots.alias("_p"))
        .select("*", (F.size("_p") - 1).alias("n"), F.posexplode("_p").alias("i", "_q"))
        .select("*", "_q.lon", "_q.lat")
        .drop("_p", "_q")
    )
    found = D.lookup_elevation(line, cells, meta, out="_z")
    share = F.col("i") / F.col("n")
    z0, z1 = F.col("start_elevation"), F.col("end_elevation")
    z = F.when(F.col("i") == 0, z0).when(F.col("i") == F.col("n"), z1).otherwise(F.coalesce("_z", z0 + share * (z1 - z0)))
    return found.select("resort_id", "lift_id", "i", "n", "lon", "lat", z.alias("elevation"))


def with_terrain(lifts: DataFrame, cells: DataFrame, meta: D.DemMeta) -> DataFrame:
    """Lifts with their ordered ``terrain_points`` array (bounded by the lift length)."""
    points = (
        terrain_samples(lifts, cells, meta)
        .groupBy("resort_id", "lift_id")
        .agg(F.sort_array(F.collect_list(F.struct("i", "lon", "lat", "elevation"))).alias("_p"))
        .select("resort_id", "lift_id", F.transform("_p", lambda p: F.struct(p["lon"], p["lat"], p["elevation"])).alias("terrain_points"))
    )
    return lifts.join(points, ["resort_id", "lift_id"]).withColumn("length_m", length_between())


def cable_elevation(t, z0, z1, span_m, sag) -> Column:
    t = num(t)
    return (1 - t) * num(z0) + t * num(z1) - 4.0 * (num(sag) * num(span_m)) * t * (1 - t)


PYLON = "array<struct<index:int,distance_m:double,lat:double,lon:double,ground_elevation_m:double,height_m:double>>"


PHASES = StructType()
for _name in ("clear", "spaced", "kept"):
    PHASES.add(_name, ArrayType(IntegerType()))


def _doubles(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(float)


def _sizes(a: pa.Array) -> np.ndarray:
    return a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


@F.arrow_udf(PHASES)
def _phases(z: pa.Array, *par: pa.Array) -> pa.Array:
    sizes = _sizes(z)
    found = pylon_search(_doubles(z.flatten()), sizes, *map(_doubles, par))
    lists = []
    for lift, idx in found:
        offsets = np.searchsorted(lift, np.arange(len(sizes) + 1)).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(idx.astype(np.int32))))
    return pa.StructArray.from_arrays(lists, ["clear", "spaced", "kept"])


def _search(lift_type: Column) -> Column:
    """Pylon indices by phase: clearance, spacing, clearance again; none below three terrain points."""
    names = ("min_spacing", "max_spacing", "min_clearance", "pylon_height", "station_height", "sag")
    return _phases(F.col("terrain_points")["elevation"], F.col("length_m"), *[spec(lift_type, n) for n in names])


def with_pylons(lifts: DataFrame, lift_type: str = "lift_type") -> DataFrame:
    """Add ``pylons``: clearance, spacing, clearance again; none below three terrain points."""
    step = F.col("length_m") / (F.size("terrain_points") - 1)

    def record(i: Column) -> Column:
        point = F.element_at("terrain_points", i + 1)
        return F.struct(
            i.alias("index"),
            (i * step).alias("distance_m"),
            point["lat"].alias("lat"),
            point["lon"].alias("lon"),
            point["elevation"].alias("ground_elevation_m"),
            spec(F.col(lift_type), "pylon_height").alias("height_m"),
        )

    return (
        lifts.withColumn("_found", _search(F.col(lift_type)))
        .withColumn("pylons", F.transform("_found.kept", record).cast(PYLON))
        .drop("_found")
    )


def pylon_phases(lifts: DataFrame) -> DataFrame:
    """Pylon indices after the first clearance pass and after spacing (before the final pass)."""
    found = lifts.where(F.size("terrain_points") >= 3).select("lift_id", _search(F.col("lift_type")).alias("f"))
    return found.select("lift_id", "f.clear", "f.spaced")


XYZ = StructType()
for _name in ("lon", "lat", "elevation"):
    XYZ.add(_name, DoubleType())


@F.arrow_udf(ArrayType(XYZ))
def _cables(lon: pa.Array, lat: pa.Array, length_m: pa.Array, x: pa.Array, y: pa.Array, *rest: pa.Array) -> pa.Array:
    flat = lambda a: _doubles(a.flatten())
    lift, *values = cable_points(flat(lon), flat(lat), _sizes(lon), _doubles(length_m), flat(x), flat(y), _sizes(x), *map(_doubles, rest))
    offsets = np.searchsorted(lift, np.arange(len(lon) + 1)).astype(np.int32)
    points = pa.StructArray.from_arrays([pa.array(v, from_pandas=True) for v in values], XYZ.names)
    return pa.ListArray.from_arrays(pa.array(offsets), points)


def with_cable(lifts: DataFrame, lift_type: str = "lift_type") -> DataFrame:
    """Add ``cable_points``: parabolic sag between stations and pylon tops."""
    t = F.col(lift_type)
    station, sag = spec(t, "station_height", "chairlift"), spec(t, "sag", "chairlift")
    tops = F.transform("pylons", lambda p: p["ground_elevation_m"] + p["height_m"])
    points = F.col("terrain_points")
    return lifts.withColumn(
        "cable_points",
        _cables(
            points["lon"], points["lat"], F.col("length_m"), F.col("pylons")["distance_m"], tops,
            F.col("start_elevation") + station, F.col("end_elevation") + station, sag,
        ),
    )


def with_name(lifts: DataFrame, lift_type: str = "lift_type") -> DataFrame:
    down = bearing_deg(F.col("end_lon"), F.col("end_lat"), F.col("start_lon"), F.col("start_lat"))
    rise = F.col("end_elevation") - F.col("start_elevation")
    return lifts.withColumn(
        "name", lift_name(F.col(lift_type), id_number(F.col("lift_id"), "lift"), F.col("length_m"), rise, down)
    )


def build(lifts: DataFrame, lift_type: str = "lift_type") -> DataFrame:
    """Everything that depends on the lift type, from stored terrain points."""
    return with_name(with_cable(with_pylons(lifts, lift_type), lift_type), lift_type)


def create(ends: DataFrame, cells: DataFrame, meta: D.DemMeta) -> DataFrame:
    """Complete lifts from station pairs."""
    return build(with_terrain(ends, cells, meta))


def what_if_types(lifts: DataFrame) -> DataFrame:
    """Each lift rebuilt for every other type from its stored terrain (at most 3 rows per lift)."""
    others = F.filter(F.array(*[F.lit(t) for t in C.LIFT_TYPES]), lambda t: t != F.col("lift_type"))
    wide = lifts.drop("pylons", "cable_points", "name").select("*", F.explode(others).alias("new_type"))
    return build(wide, "new_type")


def add_lifts(ends: DataFrame, cells: DataFrame, meta: D.DemMeta) -> tuple[DataFrame, DataFrame]:
    """Validate first, then build: (lifts, rejected with reason)."""
    reason = F.coalesce(
        lift_uphill(F.col("start_elevation"), F.col("end_elevation")),
        lift_nodes_differ(F.col("start_node_id"), F.col("end_node_id")),
    )
    checked = ends.withColumn("reason", reason)
    return create(checked.where(F.col("reason").isNull()).drop("reason"), cells, meta), checked.where(F.col("reason").isNotNull())


def place_lifts(
    stations: DataFrame, cells: DataFrame, meta: D.DemMeta, nodes: DataFrame, counters: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Add lifts between map positions: (lifts, rejected with reason).

    ``stations``: as for ``create`` with resort_id and ord; an end with a node id stands on that node, another one
    joins the nearest node within 30 m (of ``nodes``: resort_id, node_id, node_ord, lon, lat, elevation, or made by
    an earlier lift) or becomes a node.  Rules are checked first: uphill, and not the same node where both are given.
    """
    given = F.col("start_node_id").isNotNull() & F.col("end_node_id").isNotNull()
    reason = F.coalesce(
        lift_uphill(F.col("start_elevation"), F.col("end_elevation")),
        F.when(given, lift_nodes_differ(F.col("start_node_id"), F.col("end_node_id"))),
    )
    checked = stations.withColumn("reason", reason)
    good = checked.where(F.col("reason").isNull()).drop("reason")
    end = lambda k, name: F.struct(
        (F.col("ord") * 2 + k).alias("end_ord"), F.col(f"{name}_node_id").alias("given"),
        *[F.col(f"{name}_{n}").alias(n) for n in ("lon", "lat", "elevation")],
    )
    loose = good.select("resort_id", F.inline(F.array(end(0, "start"), end(1, "end")))).where("given IS NULL").drop("given")
    snapped = snap_sequence(loose, "resort_id", "end_ord", nodes, counters).select("resort_id", "end_ord", "node_id")
    for k, name in ((0, "start"), (1, "end")):
        found = snapped.where(F.col("end_ord") % 2 == k).select(
            "resort_id", ((F.col("end_ord") - k) / 2).cast("long").alias("ord"), F.col("node_id").alias("_found")
        )
        good = good.join(found, ["resort_id", "ord"], "left").withColumn(f"{name}_node_id", F.coalesce(f"{name}_node_id", "_found")).drop("_found")
    return create(good, cells, meta), checked.where(F.col("reason").isNotNull())


def steepest_between_pylons() -> Column:
    rest = F.greatest(F.size("pylons") - 1, F.lit(0))
    top = lambda p: p["ground_elevation_m"] + p["height_m"]
    grades = F.zip_with(
        F.slice("pylons", 1, rest),
        F.slice("pylons", 2, rest),
        lambda a, b: F.when(b["distance_m"] > a["distance_m"], F.abs((top(b) - top(a)) / (b["distance_m"] - a["distance_m"]) * 100.0)),
    )
    return F.when(F.size("pylons") >= 2, F.coalesce(F.array_max(grades), F.lit(0.0))).otherwise(F.lit(0.0))


def cable_profile(lifts: DataFrame) -> DataFrame:
    """Cable rows with distance from the bottom, ground below, height above ground and share of the length."""
    n = F.size("terrain_points")
    rows = lifts.select(
        "lift_id", "length_m", "start_lat", "start_lon", "terrain_points", F.posexplode_outer("cable_points").alias("i", "p")
    ).withColumn("x_m", distance_m(F.col("start_lat"), F.col("start_lon"), F.col("p.lat"), F.col("p.lon")))
    pos = F.when(F.col("length_m") > 0, F.col("x_m") / F.col("length_m")).otherwise(0.0) * (n - 1)
    rows = rows.withColumn("_pos", pos).withColumn("_low", F.least(F.col("_pos").cast("int"), n - 1))
    low = F.element_at("terrain_points", F.col("_low") + 1)["elevation"]
    high = F.element_at("terrain_points", F.least(F.col("_low") + 1, n - 1) + 1)["elevation"]
    f = F.col("_pos") - F.col("_low")
    return rows.withColumn("ground_m", low * (1 - f) + high * f).select(
        "lift_id",
        "i",
        "x_m",
        F.col("p.elevation").alias("cable_m"),
        "ground_m",
        (F.col("p.elevation") - F.col("ground_m")).alias("height_m"),
        F.when(F.col("length_m") > 0, F.col("x_m") / F.col("length_m") * 100.0).otherwise(0.0).alias("share_pct"),
    )
