"""Row-form path computation: one row per point, paths of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapath import config as C
from terrapath.functions.geo import haversine_m
from terrapath.functions.paths import avg_slope_pct
from terrapath.functions.terrain import classify
from terrapath.operators.scan import running_total, with_previous

Key = str | list[str]


def keys_of(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


STEP_COLS = {"lon": "_lon0", "lat": "_lat0", "elevation": "_z0"}


def with_steps(points: DataFrame, key: Key, pos: str = "seq", keep_chunk: bool = False, chunk: int = C.CHUNK_ROWS) -> DataFrame:
    """Distance and drop from the preceding point (0 at the start of a path)."""
    df = with_previous(points, keys_of(key), pos, STEP_COLS, chunk, keep_chunk)
    d = haversine_m(F.col("_lat0"), F.col("_lon0"), F.col("lat"), F.col("lon"))
    return (
        df.withColumn("step_m", F.coalesce(d, F.lit(0.0)))
        .withColumn("step_drop_m", F.coalesce(F.col("_z0") - F.col("elevation"), F.lit(0.0)))
        .drop(*STEP_COLS.values())
    )


def with_distance(points: DataFrame, key: Key, pos: str = "seq", chunk: int = C.CHUNK_ROWS) -> DataFrame:
    """Running distance from the start of the path."""
    steps = with_steps(points, key, pos, keep_chunk=True, chunk=chunk)
    return running_total(steps, keys_of(key), pos, {"cum_m": F.col("step_m")}, chunk, placed="_chunk")


def gradient_strip(points: DataFrame, key: Key, pos: str = "seq") -> DataFrame:
    """Per-step slope class; steps without horizontal length are left out."""
    steps = with_distance(points, key, pos).where(F.col("step_m") > 0)
    slope = F.col("step_drop_m") / F.col("step_m") * 100.0
    return steps.withColumn("step_slope_pct", slope).withColumn("difficulty", classify(F.col("step_slope_pct")))


def path_totals(measured: DataFrame, key: Key, pos: str = "seq") -> DataFrame:
    return (
        measured.groupBy(*keys_of(key))
        .agg(
            F.max("cum_m").alias("length_m"),
            F.min_by("elevation", pos).alias("start_elevation"),
            F.max_by("elevation", pos).alias("end_elevation"),
        )
        .withColumn("drop_m", F.col("start_elevation") - F.col("end_elevation"))
        .withColumn("avg_slope_pct", avg_slope_pct(F.col("drop_m"), F.col("length_m")))
    )


def steepest_sections(measured: DataFrame, key: Key, pos: str = "seq", window: float = C.ROLLING_WINDOW_M) -> DataFrame:
    """Steepest rolling section and difficulty of every path.

    The path is cut into stretches of one window length.  A point starts sections in
    its own stretch and is also sent to the stretch before, so that every section
    lies inside one partition however long the path is.
    """
    keys = keys_of(key)
    home = F.floor(F.col("cum_m") / window)
    spread = measured.select(
        *keys,
        pos,
        "elevation",
        "cum_m",
        F.explode(
            F.array(
                F.struct(home.alias("stretch"), F.lit(True).alias("starts")),
                F.struct((home - 1).alias("stretch"), F.lit(False).alias("starts")),
            )
        ).alias("_s"),
    ).select(*keys, pos, "elevation", "cum_m", "_s.stretch", "_s.starts")
    ahead = W.partitionBy(*keys, "stretch").orderBy("cum_m").rangeBetween(0, int(window))
    ends = spread.select(
        *keys,
        "elevation",
        "cum_m",
        "starts",
        F.max_by(F.struct(F.col("elevation").alias("z"), F.col("cum_m").alias("x")), pos).over(ahead).alias("_end"),
    ).where("starts")
    span = F.col("_end.x") - F.col("cum_m")
    totals = path_totals(measured, key, pos)
    sections = (
        ends.join(totals.select(*keys, F.col("length_m").alias("_total")), keys)
        .where((span > 0) & (F.col("_total") > F.col("cum_m") + window))
        .groupBy(*keys)
        .agg(F.max(F.abs((F.col("elevation") - F.col("_end.z")) / span) * 100.0).alias("_steepest"))
    )
    steepest = F.when(
        F.col("length_m") >= window, F.greatest("avg_slope_pct", F.coalesce("_steepest", "avg_slope_pct"))
    ).otherwise(F.col("avg_slope_pct"))
    return (
        totals.join(sections, keys, "left")
        .withColumn("max_slope_pct", steepest)
        .withColumn("difficulty", classify(F.col("max_slope_pct")))
        .drop("_steepest")
    )
