"""Resampling of row-form paths at a fixed spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.operators.scan import with_previous

BEFORE = {"lon": "_lon0", "lat": "_lat0", "elevation": "_z0", "cum_m": "_x0"}


def spots_on_legs(legs: DataFrame, key: str, is_last: Column, step: float = C.RESAMPLE_M) -> DataFrame:
    """Points every ``step`` metres on legs (a point plus its predecessor, columns of ``BEFORE``).

    Every leg emits the multiples of ``step`` that fall on it, so the work is a plain
    projection: no search and no grouping.
    """
    x0, x1 = F.col("_x0"), F.col("cum_m")
    first = F.when(x0.isNull(), F.lit(0)).otherwise(F.floor(x0 / step) + 1)
    # a multiple of the spacing on a vertex belongs to the leg that ends there
    last = F.when(x0.isNull(), F.lit(0)).otherwise(F.floor(x1 / step))
    tail = F.ceil((x1 + step / 2) / step) - 1
    last = F.when(is_last, F.greatest(last, tail)).otherwise(last)
    spots = legs.where(last >= first).select("*", F.explode(F.sequence(first, last)).alias("i"))
    share = F.when(x0.isNotNull() & (x1 > x0), F.least(F.lit(1.0), (F.col("i") * step - x0) / (x1 - x0))).otherwise(F.lit(1.0))
    mix = lambda b: F.coalesce(F.col(BEFORE[b]) + (F.col(b) - F.col(BEFORE[b])) * share, F.col(b)).alias(b)
    return spots.select(key, "i", mix("lon"), mix("lat"), mix("elevation"))


def resample(measured: DataFrame, key: str, pos: str = "seq", step: float = C.RESAMPLE_M) -> DataFrame:
    """Points every ``step`` metres of paths of any length; the last may pass the end by half a step."""
    legs = with_previous(measured, [key], pos, BEFORE)
    ends = measured.groupBy(key).agg(F.max(pos).alias("_last"))
    return spots_on_legs(legs.join(ends, key), key, F.col(pos) == F.col("_last"), step)
