"""Validation rules: NULL when the row is fine, a reason struct otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions.geo import haversine_m, num


def reason(code: str, text: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), text.alias("text"))


def whole(x) -> Column:
    """Half-even whole number for texts; a small negative stays "-0"."""
    x = num(x)
    return F.when((x < 0) & (x >= -0.5), F.lit(-0.0)).otherwise(F.bround(x, 0))


def lift_uphill(start_elev, end_elev) -> Column:
    s, e = num(start_elev), num(end_elev)
    text = F.format_string("Lift Must Go Uphill — %.0fm → %.0fm (%+.0fm)", whole(s), whole(e), whole(e - s))
    return F.when(e <= s, reason("lift_not_uphill", text))


def lift_nodes_differ(start_id: Column, end_id: Column) -> Column:
    text = F.lit("Same Location — Top station cannot be at the same point as bottom station.")
    return F.when(start_id == end_id, reason("same_node", text))


def target_downhill(start_elev, target_elev) -> Column:
    drop = num(start_elev) - num(target_elev)
    text = F.format_string("Not Downhill Enough — drop: %.0fm, need: 5m", whole(drop))
    return F.when(drop < C.MIN_DROP_M, reason("target_not_downhill", text))


def target_distance(start_lat, start_lon, target_lat, target_lon) -> Column:
    d = haversine_m(start_lat, start_lon, target_lat, target_lon)
    text = F.format_string("Target Too Far — %.0fm (max: 1000m)", whole(d))
    return F.when(d > C.LENGTH_MAX_M, reason("target_too_far", text))


def outside_terrain(lat, lon, elevation: Column) -> Column:
    text = F.format_string("Outside Terrain — Point (%.4f, %.4f) has no elevation data.", num(lat), num(lon))
    return F.when(elevation.isNull(), reason("outside_terrain", text))


def point_valid(elevation: Column) -> Column:
    return elevation.isNotNull() & ~F.isnan(elevation)


def lift_valid(lift_type: Column, terrain: Column, cable: Column) -> Column:
    return (
        F.when(~lift_type.isin(C.LIFT_TYPES), reason("lift_type", F.concat(F.lit("Invalid lift_type "), lift_type)))
        .when(F.size(terrain) < 2, reason("terrain_points", F.lit("at least 2 terrain points")))
        .when(F.size(cable) < 2, reason("cable_points", F.lit("at least 2 cable points")))
    )


def plan_ready(start_elev, target_elev, distance_m) -> Column:
    return (num(start_elev) - num(target_elev) > 0) & (num(distance_m) >= C.STEP_M)
