"""Slope classes, lookups and angle rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions.geo import bearing_deg, circular_mean_deg, let, num, wrap_turn


def classify(slope_pct) -> Column:
    """Difficulty class; negative and NaN slopes are green."""
    s = num(slope_pct)
    return (
        F.when(F.isnan(s) | s.isNull(), F.lit("green"))
        .when(s >= C.DIFFICULTY_FLOOR_PCT["black"], F.lit("black"))
        .when(s >= C.DIFFICULTY_FLOOR_PCT["red"], F.lit("red"))
        .when(s >= C.DIFFICULTY_FLOOR_PCT["blue"], F.lit("blue"))
        .otherwise(F.lit("green"))
    )


def lookup(table: dict, key: Column) -> Column:
    """Constant map lookup that folds into the projection (no join needed)."""
    pairs = []
    for k, v in table.items():
        pairs += [F.lit(k), F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)]
    return F.create_map(*pairs)[key]


def slope_color(difficulty: Column) -> Column:
    return lookup(C.SLOPE_COLORS, difficulty)


def orientation(slope_pct, fall_line) -> Column:
    """Fall line, contours and half slopes; NULL where the ground is too flat."""
    s, f = num(slope_pct), num(fall_line)
    turn = lambda d: F.pmod(f + d, F.lit(360.0))
    return F.when(
        s >= C.MIN_SKIABLE_PCT,
        F.struct(
            f.alias("fall_line"),
            s.alias("slope_pct"),
            turn(-90.0).alias("contour_left"),
            turn(90.0).alias("contour_right"),
            turn(-45.0).alias("half_slope_left"),
            turn(45.0).alias("half_slope_right"),
            slope_color(classify(s)).alias("difficulty_color"),
        ),
    )


def side_slope(slope_pct, fall_line, lon1, lat1, lon2, lat2) -> Column:
    """Cross slope of a ski direction, as struct<slope_pct, direction>."""
    cross = num(slope_pct) * F.sin(F.radians(num(fall_line) - bearing_deg(lon1, lat1, lon2, lat2)))
    value = F.when(num(slope_pct) < C.SIDE_GRADIENT_MIN_PCT, F.lit(0.0)).otherwise(cross)
    return let(value, lambda v: F.struct(v.alias("slope_pct"), side_direction(v).alias("direction")))


def side_direction(value) -> Column:
    v = num(value)
    return F.when(F.abs(v) < C.SIDE_FLAT_PCT, "flat").when(v > 0, "right").otherwise("left")


def traverse_angle(target, terrain) -> Column:
    """Angle off the fall line that turns the terrain slope into the target slope."""
    t, g = num(target), num(terrain)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t / g))))
    clamped = F.least(F.greatest(angle, F.lit(C.MIN_TRAVERSE_DEG)), F.lit(C.MAX_TRAVERSE_DEG))
    return F.when((g > 0) & (t < g), clamped).otherwise(F.lit(C.MIN_TRAVERSE_DEG))


def step_target(remaining_drop, remaining_m, target) -> Column:
    """Slope wanted for the next step so that the whole path meets its target."""
    wanted = num(remaining_drop) / num(remaining_m) * 100.0
    clamped = F.greatest(F.lit(C.MIN_SKIABLE_PCT), F.least(num(target) * 2.5, wanted))
    return F.when(num(remaining_m) > C.STEP_M, clamped).otherwise(num(target))


def noise_deg(key: Column, step: Column, angle, seed: int) -> Column:
    """Reproducible normal noise (Box-Muller on hashed uniforms), scaled by the angle."""
    unit = lambda salt: (
        F.pmod(F.xxhash64(key, step, F.lit(seed), F.lit(salt)), F.lit(2**31)).cast("double") + 0.5
    ) / float(2**31)
    gauss = F.sqrt(-2.0 * F.log(unit(1))) * F.cos(F.lit(6.283185307179586) * unit(2))
    return gauss * C.BASE_NOISE_DEG * F.greatest(F.lit(0.0), (90.0 - num(angle)) / 90.0)


def blend_momentum(terrain_bearing, recent: Column, terrain_slope) -> Column:
    """On flat ground pull the bearing toward the mean of the recent bearings."""
    b, s = num(terrain_bearing), num(terrain_slope)
    weight = C.MOMENTUM_WEIGHT * (1.0 - s / C.FLAT_TERRAIN_PCT)
    blended = let(
        circular_mean_deg(recent), lambda m: F.pmod(m + (1.0 - weight) * wrap_turn(b - m), F.lit(360.0))
    )
    return F.when((s < C.FLAT_TERRAIN_PCT) & (F.size(recent) >= 2), blended).otherwise(b)


def effective_slope(terrain, angle) -> Column:
    return num(terrain) * F.cos(F.radians(num(angle)))


def cross_slope(terrain, angle) -> Column:
    return num(terrain) * F.sin(F.radians(num(angle)))
