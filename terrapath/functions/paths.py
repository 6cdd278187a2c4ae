"""Path metrics, names, belts and warnings as column expressions.

``points`` is always ``array<struct<lon, lat, elevation>>`` of one bounded path
(one segment, one trace); unbounded point sequences use ``operators.profile``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions.geo import bearing_deg, compass, destination, let, num, point_distance_m
from terrapath.functions.terrain import classify, lookup


def first_point(points: Column) -> Column:
    return F.try_element_at(points, F.lit(1))


def last_point(points: Column) -> Column:
    return F.try_element_at(points, F.lit(-1))


def step_lengths(points: Column) -> Column:
    """Distance of every consecutive pair; empty for fewer than two points."""
    rest = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, 1, rest), F.slice(points, 2, rest), point_distance_m)


def cumulative(steps: Column) -> Column:
    """Distance from the start at every point: [0, d1, d1+d2, ...]."""
    return F.aggregate(
        steps,
        F.array(F.lit(0.0)),
        lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)),
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, d: acc + d)


def length_m(points: Column) -> Column:
    return total(step_lengths(points))


def drop_m(points: Column) -> Column:
    return F.when(
        F.size(points) >= 2, first_point(points)["elevation"] - last_point(points)["elevation"]
    ).otherwise(F.lit(0.0))


def avg_slope_pct(drop, length) -> Column:
    return F.when(num(length) > 0, num(drop) / num(length) * 100.0).otherwise(F.lit(0.0))


def steepest_section_pct(points: Column, cum: Column, avg: Column, window: float = C.ROLLING_WINDOW_M) -> Column:
    """Steepest rolling section of one bounded path.

    For every start the section ends at the last point within ``window`` metres
    and only counts when the path continues beyond the window.
    """
    n = F.size(points)
    whole = F.element_at(cum, -1)

    def section(i: Column) -> Column:
        start = F.element_at(cum, i)
        inside = F.aggregate(cum, F.lit(0), lambda acc, d: F.when(d - start <= window, acc + 1).otherwise(acc))
        return let(
            inside,
            lambda j: F.when(
                (j > i) & (j < n) & (F.element_at(cum, j) > start),
                F.abs(
                    (F.element_at(points, i)["elevation"] - F.element_at(points, j)["elevation"])
                    / (F.element_at(cum, j) - start)
                )
                * 100.0,
            ),
        )

    steepest = F.array_max(F.transform(F.sequence(F.lit(1), n), section))
    return F.when((n >= 2) & (whole >= window), F.greatest(avg, steepest)).otherwise(avg)


def belt_width_m(side_pct, difficulty: Column) -> Column:
    limits = lookup(C.BELT_WIDTH_M, difficulty)
    side = F.abs(num(side_pct))
    adaptive = F.lit(C.EXCAVATOR_CUT_M * 200.0) / side
    return F.when(side < 1.0, limits[1]).otherwise(F.greatest(limits[0], F.least(limits[1], adaptive)))


def vertical_cut_m(side_pct, width) -> Column:
    return F.abs(num(side_pct)) * num(width) / 200.0


def warnings(avg, side_pct, side_dir: Column, difficulty: Column) -> Column:
    """Construction warnings of one segment, as an array of structs."""
    avg, side = num(avg), F.abs(num(side_pct))
    width = belt_width_m(side_pct, difficulty)
    side_limit = F.lit(C.EXCAVATOR_CUT_M * 200.0) / lookup(C.BELT_WIDTH_M, difficulty)[0]
    missing_d, missing_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def item(kind: str, slope, belt, direction, limit, message: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warning_type"),
            slope.alias("slope_pct"),
            belt.alias("belt_width_m"),
            direction.alias("direction"),
            limit.alias("threshold_pct"),
            message.alias("message"),
        )

    excavator = item(
        "ExcavatorWarning",
        side,
        width,
        side_dir,
        missing_d,
        F.format_string(
            "🚜 Excavator Warning: %.1fm vertical side cut required across %.0fm piste width. "
            "Cross-slope %.0f%% (terrain leans %s)",
            F.bround(vertical_cut_m(side_pct, width), 1),
            F.bround(width, 0),
            F.bround(side, 0),
            side_dir,
        ),
    )
    steep = item(
        "TooSteepWarning",
        avg,
        missing_d,
        missing_s,
        F.lit(C.MAX_SKIABLE_PCT),
        F.format_string(
            "⚠️ Too Steep Warning: Gradient %.0f%% exceeds maximum safe slope of 70%% "
            "- may require terrain modification",
            F.bround(avg, 0),
        ),
    )
    flat = item(
        "TooFlatWarning",
        avg,
        missing_d,
        missing_s,
        F.lit(C.MIN_SKIABLE_PCT),
        F.format_string(
            "📐 Too Flat Warning: Gradient %.0f%% is below minimum skiable slope of 5%% - skiers may need to push",
            F.bround(avg, 0),
        ),
    )
    return F.array_compact(
        F.array(
            F.when(side > side_limit, excavator),
            F.when(avg >= C.MAX_SKIABLE_PCT, steep),
            F.when(avg < C.MIN_SKIABLE_PCT, flat),
        )
    )


CAP_STEPS = 8


def belt_polygon(points: Column, width) -> Column:
    """Closed ribbon around a centre line: left edge, round cap, right edge, round cap."""
    n = F.size(points)
    half = num(width) / 2.0

    def heading(i: Column) -> Column:
        a = F.element_at(points, F.greatest(i - 1, F.lit(1)))
        b = F.element_at(points, F.least(i + 1, n))
        return bearing_deg(a["lon"], a["lat"], b["lon"], b["lat"])

    def offset(i: Column, turn) -> Column:
        p = F.element_at(points, i)
        return destination(p["lon"], p["lat"], F.pmod(heading(i) + turn, F.lit(360.0)), half)

    order = F.sequence(F.lit(1), n)
    cap = F.sequence(F.lit(1), F.lit(CAP_STEPS - 1))
    ring = F.concat(
        F.transform(order, lambda i: offset(i, -90.0)),
        F.transform(cap, lambda k: offset(n, -90.0 + k * (180.0 / CAP_STEPS))),
        F.transform(F.reverse(order), lambda i: offset(i, 90.0)),
        F.transform(cap, lambda k: offset(F.lit(1), 90.0 + k * (180.0 / CAP_STEPS))),
    )
    closed = let(ring, lambda r: F.concat(r, F.slice(r, 1, 1)))
    return F.when(n >= 2, closed).otherwise(F.array().cast("array<struct<lon:double,lat:double>>"))


def id_number(entity_id: Column, kind: str) -> Column:
    return F.substring(entity_id, len(C.ID_PREFIX[kind]) + 1, 20).cast("long")


def pick(words: Column, number: Column) -> Column:
    """Stable stand-in for a random pick: the entity number selects the word."""
    return F.element_at(words, (F.pmod(number, F.size(words)) + 1).cast("int"))


def slope_name(difficulty: Column, number: Column, start_elev, end_elev, bearing) -> Column:
    prefix = pick(lookup(C.SLOPE_PREFIXES, difficulty), number)
    suffix = pick(F.array(*[F.lit(s) for s in C.SLOPE_SUFFIXES]), number)
    drop = num(start_elev) - num(end_elev)
    extra = F.when(drop > C.SUMMIT_M, "Summit ").when(drop > C.BIG_DROP_M, "Big ").otherwise("")
    return F.format_string("%d (%s %s %s%s)", number, prefix, compass(bearing), extra, suffix)


def lift_name(lift_type: Column, number: Column, length, rise, bearing_down) -> Column:
    prefix = pick(lookup(C.LIFT_PREFIXES, lift_type), number)
    suffix = pick(lookup(C.LIFT_SUFFIXES, lift_type), number)
    words = {k: F.array(*[F.lit(w) for w in v]) for k, v in C.LENGTH_WORDS.items()}
    size = (
        F.when(num(length) < C.SHORT_LIFT_M, F.concat(pick(words["short"], number), F.lit(" ")))
        .when(num(length) > C.LONG_LIFT_M, F.concat(pick(words["long"], number), F.lit(" ")))
        .otherwise("")
    )
    summit = num(rise) > C.SUMMIT_M
    return F.format_string(
        "%d (%s%s %s %s%s)",
        number,
        F.when(summit, "").otherwise(size),
        prefix,
        compass(bearing_down),
        F.when(summit, "Summit ").otherwise(""),
        suffix,
    )


def grade_name(difficulty: Column, side: Column, grade: Column) -> Column:
    return F.format_string("%s %s (%s)", F.initcap(difficulty), F.initcap(side), F.initcap(grade))


def similar_paths(a: Column, b: Column, tolerance: float = C.SIMILARITY_DEG) -> Column:
    """Mean squared degree distance at nine inner positions below the tolerance."""
    deciles = F.array(*[F.lit(k / 10) for k in range(1, 10)])

    def at(points: Column, q: Column) -> Column:
        return F.element_at(points, (q * (F.size(points) - 1)).cast("int") + 1)

    squared = F.aggregate(
        deciles,
        F.lit(0.0),
        lambda acc, q: acc
        + F.pow(at(a, q)["lon"] - at(b, q)["lon"], 2.0)
        + F.pow(at(a, q)["lat"] - at(b, q)["lat"], 2.0),
    )
    return (F.size(a) >= 3) & (F.size(b) >= 3) & (squared / 9.0 < tolerance * tolerance)


def path_metrics(points: Column) -> list[Column]:
    """Length, drop and average slope of a bounded path as named columns."""
    length, drop = length_m(points), drop_m(points)
    return [
        length.alias("length_m"),
        drop.alias("drop_m"),
        avg_slope_pct(drop, length).alias("avg_slope_pct"),
    ]


def with_path_metrics(df, points: str = "points"):
    """Add length, drop, average, steepest section and difficulty, each computed once."""
    p = F.col(points)

    def measure(cum: Column) -> Column:
        length = F.element_at(cum, -1)
        return let(
            avg_slope_pct(drop_m(p), length),
            lambda avg: F.struct(
                length.alias("length_m"),
                drop_m(p).alias("drop_m"),
                avg.alias("avg_slope_pct"),
                steepest_section_pct(p, cum, avg).alias("max_slope_pct"),
            ),
        )

    return (
        df.withColumn("_m", let(cumulative(step_lengths(p)), measure))
        .select(*df.columns, "_m.*")
        .withColumn("difficulty", classify(F.col("max_slope_pct")))
    )
