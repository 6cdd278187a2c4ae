"""Map-click parsing and keys as column expressions.

A click has ``coord`` (array<double>, lon/lat), ``object`` (map of the picked object, NULL
for bare terrain) and ``properties`` (map of a feature's properties).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapath.functions.geo import coord_key, let

ID_FIELD = {"node": "node_id", "slope": "slope_id", "segment": "segment_id", "lift": "lift_id"}
PROPOSALS = ["proposal_endpoint", "proposal_body"]


def split_event(coord: Column, obj: Column) -> list[Column]:
    """Usable coordinate (at least two values) and picked object (typed, and not the bare click)."""
    has = obj["type"].isNotNull() & (obj["type"] != "") & (obj["type"] != "click")
    return [F.when(F.size(coord) >= 2, coord).alias("coord"), F.when(has, obj).alias("object")]


def merged(obj: Column, props: Column, name: str) -> Column:
    """Feature properties win over the feature itself."""
    return F.when(obj["type"] == "Feature", F.coalesce(props[name], obj[name])).otherwise(obj[name])


FIELDS = ["id", "lon", "lat", "lift_id", "pylon_index", "proposal_index"]


def parse(coord: Column, obj: Column, props: Column) -> Column:
    """Parsed click struct, NULL when the click carries nothing usable."""
    kind = F.when(obj["type"] == "Feature", props["type"]).otherwise(obj["type"])
    picked = F.struct(
        kind.alias("kind"),
        obj.isNull().alias("bare"),
        *[F.when(merged(obj, props, n) != "", merged(obj, props, n)).alias(n) for n in FIELDS],
    )
    return let(picked, lambda f: _parsed(f, coord))


def _parsed(f: Column, coord: Column) -> Column:
    kind = f["kind"]
    is_ = lambda k: F.coalesce(kind == k, F.lit(False))
    lon = F.when(f["bare"], coord[0]).otherwise(f["lon"].cast("double"))
    lat = F.when(f["bare"], coord[1]).otherwise(f["lat"].cast("double"))
    terrain = (f["bare"] & coord.isNotNull()) | is_("terrain")
    pylon, proposal = is_("pylon"), F.coalesce(kind.isin(PROPOSALS), F.lit(False))
    ok = (
        F.when(terrain, lon.isNotNull() & lat.isNotNull())
        .when(kind.isin(list(ID_FIELD)), f["id"].isNotNull())
        .when(pylon, f["lift_id"].isNotNull() & f["pylon_index"].isNotNull())
        .when(proposal, f["proposal_index"].isNotNull())
        .otherwise(F.lit(False))
    )
    return F.when(
        ok,
        F.struct(
            F.when(terrain, "terrain").otherwise("marker").alias("click_type"),
            F.when(~terrain, kind).alias("marker_type"),
            F.when(terrain, lat).alias("lat"),
            F.when(terrain, lon).alias("lon"),
            F.when(is_("node"), f["id"]).alias("node_id"),
            F.when(is_("slope"), f["id"]).alias("slope_id"),
            F.when(is_("segment"), f["id"]).alias("segment_id"),
            F.when(pylon, f["lift_id"]).when(is_("lift"), f["id"]).alias("lift_id"),
            F.when(pylon, f["pylon_index"].cast("int")).alias("pylon_index"),
            F.when(proposal, f["proposal_index"].cast("int")).alias("proposal_index"),
        ),
    )


def object_id(obj: Column, map_version: Column) -> Column:
    """Identity of a picked object for de-duplication."""
    kind, ident = obj["type"], F.coalesce(obj["id"], F.lit(""))
    pylon = F.concat_ws("_", F.lit("pylon"), F.coalesce(obj["lift_id"], F.lit("")), F.coalesce(obj["pylon_index"], F.lit("0")))
    proposal = F.concat(kind, F.lit("_"), F.coalesce(obj["proposal_index"], F.lit("0")), F.lit("_v"), map_version)
    return F.when(
        obj.isNotNull(),
        F.when(kind == "pylon", pylon).when(kind.isin(PROPOSALS), proposal).when(ident != "", F.concat(kind, F.lit("_"), ident)).otherwise(kind),
    )


def dedup_key(click: Column) -> Column:
    """Key of a parsed click."""
    m = click["marker_type"]
    tail = (
        F.when(m == "pylon", F.concat(F.lit("pylon_"), click["pylon_index"], F.lit("_"), click["lift_id"]))
        .when(m == "proposal_endpoint", F.concat(F.lit("proposal_end_"), click["proposal_index"]))
        .when(m == "proposal_body", F.concat(F.lit("proposal_body_"), click["proposal_index"]))
        .otherwise(F.concat(m, F.lit("_"), F.coalesce(click["node_id"], click["slope_id"], click["segment_id"], click["lift_id"])))
    )
    return F.when(
        click["click_type"] == "terrain",
        F.concat(F.lit("terrain_"), coord_key(click["lat"]), F.lit("_"), coord_key(click["lon"])),
    ).when(click.isNotNull(), F.concat(F.lit("marker_"), tail))


def first_level_id(coord: Column, obj: Column) -> Column:
    """Coarse identity used before parsing: object id plus rounded position."""
    named = F.when((obj["type"] != "") & (F.coalesce(obj["id"], F.lit("")) != ""), F.concat_ws("_", obj["type"], obj["id"]))
    place = F.when(coord.isNotNull(), F.format_string("coord_%.5f_%.5f", coord[0], coord[1]))
    return F.concat_ws("_", named, place)


def record_error(click: Column) -> Column:
    """Broken invariants of a click record (click_type, marker_type, lat, lon, ids); NULL when sound."""
    m = click["marker_type"]
    placed = click["lat"].isNotNull() | click["lon"].isNotNull()
    need = F.lit(None).cast("string")
    for kind, field in [*ID_FIELD.items(), *[(p, "proposal_index") for p in PROPOSALS]]:
        need = F.when((m == kind) & click[field].isNull(), F.lit(f"{kind} needs {field}")).otherwise(need)
    pylon = (m == "pylon") & (click["lift_id"].isNull() | click["pylon_index"].isNull())
    need = F.when(pylon, F.lit("pylon needs lift_id and pylon_index")).otherwise(need)
    terrain = (
        F.when(click["lat"].isNull() | click["lon"].isNull(), "terrain needs lat/lon").when(m.isNotNull(), "terrain has a marker")
    )
    marker = F.when(m.isNull(), "marker needs a type").when(placed, "marker has lat/lon").otherwise(need)
    return F.when(click["click_type"] == "terrain", terrain).otherwise(marker)
