"""Fixed lookup tables as small DataFrames; each has at most some dozens of literal rows, so joins broadcast them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrapath import config as C

PYLONS = "lift_type string, pylon_height_m double, station_height_m double, min_spacing_m double, max_spacing_m double, min_clearance_m double, sag_factor double"
THRESHOLDS = "difficulty string, floor_pct double, below_pct double"
COLORS = "entity string, kind string, color string, icon string"
NAMES = "entity string, kind string, part string, ord int, word string"


def pylon_rows() -> list[tuple]:
    return [(kind, *values) for kind, values in C.PYLON_TABLE.items()]


def threshold_rows() -> list[tuple]:
    """Difficulties with the steepness they begin at and, but for the last, the next one's."""
    above = [C.DIFFICULTY_FLOOR_PCT[d] for d in C.DIFFICULTIES[1:]] + [None]
    return [(d, C.DIFFICULTY_FLOOR_PCT[d], b) for d, b in zip(C.DIFFICULTIES, above, strict=True)]


def color_rows() -> list[tuple]:
    slopes = [("slope", d, C.SLOPE_COLORS[d], C.DIFFICULTY_EMOJI[d]) for d in C.DIFFICULTIES]
    return slopes + [("lift", t, C.LIFT_COLORS[t], C.LIFT_ICONS[t]) for t in C.LIFT_TYPES]


def name_rows() -> list[tuple]:
    """Words of generated names in the order in which entity numbers pick them; suffixes of slopes fit every difficulty."""
    groups = [("slope", d, "prefix", C.SLOPE_PREFIXES[d]) for d in C.DIFFICULTIES]
    groups += [("slope", d, "suffix", C.SLOPE_SUFFIXES) for d in C.DIFFICULTIES]
    groups += [("lift", t, part, words[t]) for part, words in (("prefix", C.LIFT_PREFIXES), ("suffix", C.LIFT_SUFFIXES)) for t in C.LIFT_TYPES]
    return [(entity, kind, part, n, word) for entity, kind, part, words in groups for n, word in enumerate(words)]


def pylons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pylon_rows(), PYLONS)


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(threshold_rows(), THRESHOLDS)


def colors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(color_rows(), COLORS)


def names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(name_rows(), NAMES)
