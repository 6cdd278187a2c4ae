"""Many rows under one key are spread over tasks."""

from pyspark.sql import functions as F

from terrapath.operators.snapping import nearest_node
from terrapath.sources import resort_json as J


def test_fragments_of_one_resort_are_spread(spark):
    nodes = spark.range(20000, numPartitions=4).select(
        (F.col("id") % 1).alias("resort_id"), F.col("id").alias("item"),
        F.struct(F.concat(F.lit("N"), "id").alias("id"), F.struct(F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.lit(3.0).alias("elevation")).alias("location")).alias("entity"),
    )
    counters = spark.range(1).select(F.col("id").alias("resort_id"), F.struct(*[F.lit(0).alias(n) for n in ("node", "segment", "slope", "lift")]).alias("counters"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        f = J.fragments({"nodes": nodes}, counters).where("part = 1")
        per_task = [r["count"] for r in f.groupBy(F.spark_partition_id()).count().collect()]
        bare = f.where("text NOT LIKE ',%'").select("item").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(per_task) == 20000 and max(per_task) < 20000
    assert [r.item for r in bare] == [0]


def test_points_on_one_spot_are_looked_up_once(spark):
    points = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 999, 10.0).alias("lon"), F.lit(46.0).alias("lat"))
    nodes = spark.createDataFrame([("N1", 1, 10.0, 46.0001), ("N2", 2, 10.0, 46.0002)], "node_id string, node_ord long, lon double, lat double")
    got = nearest_node(points, nodes, "k", 80.0)
    assert {(r.node_id, r["count"]) for r in got.groupBy("node_id").count().collect()} == {("N1", 999), (None, 1)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan
