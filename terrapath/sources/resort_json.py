"""Resort documents (versioned JSON) and GPX tracks.

A document is written as ordered text fragments, one per entity, so that even a resort
with a large share of all entities is never assembled in one task.  Concatenating the
fragments of a resort in (part, item) order gives the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapath import config as C

POINT = "struct<lon:double,lat:double,elevation:double>"
PYLON = "struct<index:int,distance_m:double,lat:double,lon:double,ground_elevation_m:double,height_m:double>"
NODE = f"struct<id:string,location:{POINT}>"
SEGMENT = (
    f"struct<id:string,name:string,points:array<{POINT}>,start_node_id:string,end_node_id:string,"
    "side_slope_pct:double,side_slope_dir:string>"
)
SLOPE = "struct<id:string,name:string,segment_ids:array<string>,start_node_id:string,end_node_id:string>"
LIFT = (
    f"struct<id:string,name:string,start_node_id:string,end_node_id:string,lift_type:string,"
    f"terrain_points:array<{POINT}>,pylons:array<{PYLON}>,cable_points:array<{POINT}>>"
)
COUNTERS = "struct<node:int,segment:int,slope:int,lift:int>"
DOCUMENT = (
    f"version string, nodes map<string,{NODE}>, segments map<string,{SEGMENT}>, slopes map<string,{SLOPE}>, "
    f"lifts map<string,{LIFT}>, counters {COUNTERS}"
)
PARTS = ["nodes", "segments", "slopes", "lifts"]
REQUIRED = {
    "nodes": ["id", "location"],
    "segments": ["id", "name", "points", "start_node_id", "end_node_id"],
    "slopes": ["id", "name", "segment_ids", "start_node_id", "end_node_id"],
    "lifts": ["id", "name", "start_node_id", "end_node_id", "lift_type", "terrain_points", "pylons", "cable_points"],
}


def parse_documents(texts: DataFrame, key: str = "resort_id", text: str = "text") -> DataFrame:
    return texts.select(key, F.from_json(text, DOCUMENT).alias("d")).select(key, "d.*")


def bad_documents(documents: DataFrame, key: str = "resort_id") -> DataFrame:
    """Documents that give no rows, with a reason: unreadable text, or mandatory maps that are absent."""
    absent = F.filter(
        F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in (*PARTS, "counters")]), lambda p: p.isNotNull()
    )
    unread = F.size(absent) == len(PARTS) + 1
    reason = F.when(unread, F.lit("not a resort document")).otherwise(F.concat(F.lit("missing: "), F.array_join(absent, ", ")))
    return documents.where(F.size(absent) > 0).select(key, reason.alias("reason"))


def load_part(documents: DataFrame, part: str, key: str = "resort_id") -> tuple[DataFrame, DataFrame]:
    """Entities of one part: (rows, rejected rows with a missing mandatory field)."""
    rows = documents.select(key, F.explode(part).alias("_id", "e")).select(key, "e.*")
    whole = F.lit(True)
    for name in REQUIRED[part]:
        whole = whole & F.col(name).isNotNull()
    good = rows.where(whole)
    if part == "segments":
        good = good.withColumn("side_slope_pct", F.coalesce("side_slope_pct", F.lit(0.0))).withColumn(
            "side_slope_dir", F.coalesce("side_slope_dir", F.lit("flat"))
        )
    return good, rows.where(~whole)


def read_documents(spark, path: str) -> DataFrame:
    """One document per file."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("resort_id", F.input_file_name())


def fragments(parts: dict[str, DataFrame], counters: DataFrame) -> DataFrame:
    """Ordered text fragments (resort_id, part, item, text) of all resorts in ``counters``.

    ``parts[name]``: resort_id, item (order), entity (struct with ``id``).
    """
    heads = ['{"version":"' + C.DOCUMENT_VERSION + '","nodes":{', '},"segments":{', '},"slopes":{', '},"lifts":{']
    frame = F.array(
        *[F.struct(F.lit(2 * k).alias("part"), F.lit(0).cast("long").alias("item"), F.lit(h).alias("text")) for k, h in enumerate(heads)],
        F.struct(F.lit(8).alias("part"), F.lit(0).cast("long").alias("item"), F.concat(F.lit('},"counters":'), F.to_json("counters"), F.lit("}")).alias("text")),
    )
    out = counters.select("resort_id", F.inline(frame))
    for k, name in enumerate(PARTS):
        if name not in parts:
            continue
        # a resort with many entities is cut into chunks of items, so that no task holds all of them
        df = parts[name].withColumn("_chunk", F.floor(F.col("item") / C.CHUNK_ROWS))
        chunks = df.groupBy("resort_id", "_chunk").agg(F.min("item").alias("_lowest"))
        first = chunks.select("resort_id", "_chunk").join(chunks.groupBy("resort_id").agg(F.min("_lowest").alias("_first")), "resort_id")
        comma = F.when(F.col("item") == F.col("_first"), "").otherwise(",")
        text = F.concat(comma, F.lit('"'), F.col("entity.id"), F.lit('":'), F.to_json("entity"))
        out = out.unionByName(
            df.join(first, ["resort_id", "_chunk"]).select("resort_id", F.lit(2 * k + 1).alias("part"), F.col("item").cast("long").alias("item"), text.alias("text"))
        )
    return out


def write_fragments(frags: DataFrame, path: str) -> None:
    """Text files per resort, fragments in order."""
    order = ["resort_id", "part", "item"]
    frags.repartitionByRange(*order).sortWithinPartitions(*order).select("resort_id", F.col("text").alias("value")).write.mode(
        "overwrite"
    ).partitionBy("resort_id").text(path)


# ---------------------------------------------------------------- GPX


def xml_text(value: Column) -> Column:
    """Escape text content."""
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def whole(x: Column) -> Column:
    return F.format_string("%.0f", F.bround(x, 0))


def track_head(name: Column, desc: Column, kind: Column) -> Column:
    """Opening of one <trk> element up to its points."""
    return F.concat(
        F.lit("<trk><name>"), xml_text(name), F.lit("</name><desc>"), xml_text(desc), F.lit("</desc><type>"), xml_text(kind),
        F.lit("</type><trkseg>"),
    )


def track_points(points: Column) -> Column:
    point = lambda p: F.concat(
        F.lit('<trkpt lat="'), p["lat"].cast("string"), F.lit('" lon="'), p["lon"].cast("string"), F.lit('"><ele>'),
        F.format_string("%.1f", F.bround(p["elevation"], 1)), F.lit("</ele></trkpt>"),
    )
    return F.array_join(F.transform(points, point), "")


def slope_desc(difficulty: Column, drop: Column, length: Column) -> Column:
    return F.concat(F.initcap(difficulty), F.lit(" - Drop "), whole(drop), F.lit("m - Length "), whole(length), F.lit("m"))


def lift_desc(rise: Column, length: Column) -> Column:
    return F.concat(F.lit("Rise "), whole(rise), F.lit("m - Length "), whole(length), F.lit("m"))


TRACK_END = 2**31


def gpx_fragments(tracks: DataFrame, pieces: DataFrame, exported_at: str) -> DataFrame:
    """GPX documents as ordered fragments (resort_id, part, item, piece, text).

    ``tracks``: resort_id, kind ('slope' before 'lift'), item, name, desc, type.
    ``pieces``: resort_id, kind, item, piece (order), points (bounded array, one segment or
    one cable).  A track is never collected: its opening, its pieces and its end are rows.
    """
    head = (
        f'<gpx xmlns="{C.GPX_NAMESPACE}" version="1.1" creator="{C.GPX_CREATOR}"><metadata>'
        f"<name>{C.GPX_CREATOR} Export</name><time>{exported_at}</time></metadata>"
    )
    zero = F.lit(0).cast("long")
    ends = F.array(
        *[
            F.struct(F.lit(p).alias("part"), zero.alias("item"), zero.alias("piece"), F.lit(t).alias("text"))
            for p, t in ((0, head), (3, "</gpx>"))
        ]
    )
    frame = tracks.groupBy("resort_id").agg(F.count(F.lit(1)).alias("_n")).select("resort_id", F.inline(ends))
    part = F.when(F.col("kind") == "slope", 1).otherwise(2).alias("part")
    item = F.col("item").cast("long").alias("item")
    shell = F.array(
        F.struct(zero.alias("piece"), track_head(F.col("name"), F.col("desc"), F.col("type")).alias("text")),
        F.struct(F.lit(TRACK_END).cast("long").alias("piece"), F.lit("</trkseg></trk>").alias("text")),
    )
    shells = tracks.select("resort_id", part, item, F.inline(shell))
    body = pieces.select("resort_id", part, item, (F.col("piece") + 1).cast("long").alias("piece"), track_points(F.col("points")).alias("text"))
    return frame.unionByName(shells).unionByName(body)
