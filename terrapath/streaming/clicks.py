"""Streaming forms of click handling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrapath import config as C
from terrapath.functions.clicks import parse
from terrapath.sources import dem as D


def route_clicks(clicks: DataFrame, cells: DataFrame, meta: D.DemMeta) -> DataFrame:
    """Parse clicks, read terrain elevations (static raster) and name the route; works on streams and tables."""
    p = clicks.withColumn("click", parse(F.col("coord"), F.col("object"), F.col("properties")))
    p = p.withColumn("_lon", F.col("click.lon")).withColumn("_lat", F.col("click.lat"))
    e = D.lookup_elevation(p, cells, meta, "_lon", "_lat").drop("_lon", "_lat")
    terrain = F.col("click.click_type") == "terrain"
    route = (
        F.when(F.col("click").isNull(), "ignored")
        .when(terrain & F.col("elevation").isNull(), "outside")
        .when(terrain, "terrain")
        .otherwise("marker")
    )
    return e.withColumn("route", route)


ACCEPTED = "session_id bigint, event_id bigint, accepted boolean"
STATE = "x double, y double, obj string, ms bigint"


def debounce_stream(clicks: DataFrame, wait_ms: int = C.DEBOUNCE_MS, ttl: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streaming debounce: per session only the last accepted click is kept as state.

    ``clicks``: session_id, event_id, ts (event time), ms, x, y, obj.  State expires when the
    watermark passes the last event by ``ttl``; clicks that come more than ``late`` after a newer one are dropped
    by the stream.
    """
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        x, y, obj, ms = state.get if state.exists else (None, None, None, None)
        out: list[tuple] = []
        batch = pd.concat(list(frames)).sort_values("event_id")
        for e in batch.itertuples(index=False):
            e_obj = None if pd.isna(e.obj) else e.obj
            e_x = None if pd.isna(e.x) else e.x
            late = ms is None or e.ms - ms >= wait_ms
            fresh = e_obj != obj if e_obj is not None else (e_x is not None and (e_x, e.y) != (x, y))
            ok = bool(late and fresh)
            if ok:
                obj, ms = (e_obj if e_obj is not None else obj), int(e.ms)
                if e_x is not None:
                    x, y = float(e_x), float(e.y)
            out.append((key[0], e.event_id, ok))
        state.update((x, y, obj, ms))
        state.setTimeoutTimestamp(max(int(batch["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame(out, columns=["session_id", "event_id", "accepted"])

    return (
        clicks.withWatermark("ts", late)
        .groupBy("session_id")
        .applyInPandasWithState(step, ACCEPTED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
