"""Equal starts are traced once; similar paths are told by nine positions."""

from pyspark.sql import functions as F

from terrapath.operators import fan as N
from terrapath.operators import route as R
from terrapath.sources import dem as D

META = D.DemMeta(10.0, 47.0, 0.0008, 0.00054, 64, 64)


def test_equal_starts(spark):
    grid = spark.range(64 * 64).select(F.floor(F.col("id") / 64).alias("row"), (F.col("id") % 64).cast("int").alias("col"))
    cells = grid.select("row", "col", (3000.0 - 9.0 * F.col("row") + 3.0 * (F.col("col") % 5)).alias("elevation"))
    rows = [(1, 10.02, 46.99, 305.0, "a"), (2, 10.02, 46.99, 305.0, "b"), (3, 10.02, 46.99, 405.0, "c"), (4, 11.0, 46.99, 305.0, "d"), (5, 10.02, 46.99, 305.0, None)]
    starts = spark.createDataFrame(rows, "request_id long, lon double, lat double, length_m double, tag string")
    made = N.generate_fan(starts, cells, META)
    fans = {}
    for r in made.collect():
        assert r.tag == dict((x[0], x[4]) for x in rows)[r.request_id]
        fans.setdefault(r.request_id, []).append((r.ord, r.length_m, r.difficulty, [tuple(p) for p in r.points]))
    assert set(fans) == {1, 2, 3, 5}
    assert sorted(fans[1]) == sorted(fans[2]) == sorted(fans[5]) != sorted(fans[3])
    # a count does not carry the points through the shuffles
    plan = made.groupBy("request_id").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "points" not in plan and "arrays_zip" not in plan


def test_only_compared_positions_are_packed(spark):
    p = lambda dx, n=5: [(10 + dx + 0.001 * i, 47.0, 100.0 - i) for i in range(n)]
    df = spark.createDataFrame(
        [(1, 0, 20.0, p(0.0)), (1, 1, 10.0, p(0.00001)), (1, 2, 30.0, p(0.01)), (1, 3, 40.0, p(0.0, 2)), (1, 4, 50.0, p(0.0, 2)), (2, 0, 1.0, p(0.0))],
        "request_id long, ord int, avg_slope_pct double, points array<struct<lon:double,lat:double,elevation:double>>",
    )
    assert sorted(map(tuple, R.similar_pairs(df).collect())) == [(1, 0, 1)]
    kept = R.distinct_ords(df)
    assert sorted(map(tuple, kept.collect())) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()  # the fan is not computed again
