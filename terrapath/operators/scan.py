"""Ordered computation over groups of any size.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  The helpers
here split every key into bounded chunks, so that a key holding a large share of
all rows is spread over many tasks, and return the same result.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapath.config import CHUNK_ROWS


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the folder of ``spark.checkpoint.dir``; only a local master may go without that setting."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """Dense 0-based position of every row inside its key.

    Rows are range-partitioned on (keys, order), so a hot key is cut at its order
    values.  Inside a partition the rows of a key are contiguous; only the number of
    rows a key has in earlier partitions must be added (one small row per key and
    partition).  ``order`` must make rows unique within a key.
    """
    cols = [*keys, *order]
    placed = cut_lineage(
        df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(*keys, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(runs, [*keys, "_part"])
        .withColumn(out, F.col("_at") - F.col("_first") + F.col("_before"))
        .drop("_at", "_part", "_first", "_before")
    )


def _offsets(totals: DataFrame, keys: list[str], names: list[str], chunk: int, levels: int) -> DataFrame:
    """Sum of all earlier chunks, for every (key, chunk)."""
    if levels == 0:
        before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
        return totals.select(
            *keys, "_chunk", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in names]
        )
    grouped = totals.withColumn("_super", F.floor(F.col("_chunk") / chunk))
    before = W.partitionBy(*keys, "_super").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    inner = grouped.select(
        *keys, "_super", "_chunk", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_in_{n}") for n in names]
    )
    supers = grouped.groupBy(*keys, F.col("_super").alias("_chunk")).agg(*[F.sum(n).alias(n) for n in names])
    outer = _offsets(supers, keys, names, chunk, levels - 1).withColumnRenamed("_chunk", "_super")
    return inner.join(outer, [*keys, "_super"]).select(
        *keys, "_chunk", *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(f"_off_{n}") for n in names]
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    totals: dict[str, Column],
    chunk: int = CHUNK_ROWS,
    levels: int = 1,
    placed: str | None = None,
) -> DataFrame:
    """Inclusive running sums per key in ``pos`` order, for keys of any size.

    ``pos`` is an integer position (gaps are fine).  Chunks of ``chunk`` positions
    are summed locally; chunk totals are scanned the same way one level up.
    ``placed`` names a column that already holds the chunk number (see
    ``with_previous``), so that its partitioning is used again.
    """
    keys, names = list(keys), list(totals)
    base = df.select("*", *[v.alias(f"_v_{n}") for n, v in totals.items()]).withColumn(
        "_chunk", F.col(placed) if placed else F.floor(F.col(pos) / chunk)
    )
    upto = W.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    local = base.select("*", *[F.sum(f"_v_{n}").over(upto).alias(f"_s_{n}") for n in names])
    sums = base.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(n) for n in names])
    offsets = _offsets(sums, keys, names, chunk, levels)
    return local.join(offsets, [*keys, "_chunk"]).select(
        *[c for c in df.columns if c not in (*names, placed)],
        *[(F.col(f"_s_{n}") + F.col(f"_off_{n}")).alias(n) for n in names],
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    cols: dict[str, str],
    chunk: int = CHUNK_ROWS,
    keep_chunk: bool = False,
) -> DataFrame:
    """Values of the preceding row as new columns, for keys of any size.

    Positions may have gaps.  A key is cut into chunks of ``chunk`` positions; the first row of
    a chunk takes the last row present in the chunks before it, found among one small row per chunk.
    """
    keys = list(keys)
    placed = df.withColumn("_chunk", F.floor(F.col(pos) / chunk))
    item = F.struct(*[F.col(c).alias(f"_p_{out}") for c, out in cols.items()])
    last = placed.groupBy(*keys, "_chunk").agg(F.max_by(item, pos).alias("_item"))
    before = last.select(*keys, "_chunk", F.lag("_item").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_before"))
    w = W.partitionBy(*keys, "_chunk").orderBy(pos)
    inner = placed.select("*", F.row_number().over(w).alias("_rank"), *[F.lag(c).over(w).alias(f"_in_{out}") for c, out in cols.items()])
    value = lambda out: F.when(F.col("_rank") == 1, F.col(f"_before._p_{out}")).otherwise(F.col(f"_in_{out}")).alias(out)
    seen = inner.join(before, [*keys, "_chunk"]).select(*df.columns, "_chunk", *[value(out) for out in cols.values()])
    return seen if keep_chunk else seen.drop("_chunk")


def hot_key_salts(df: DataFrame, keys: Sequence[str], rows_per_group: int) -> DataFrame:
    """Number of salts each key needs so that no group exceeds ``rows_per_group`` on average."""
    return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_group).cast("int").alias("_salts"))


def spread_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash groups over all shuffle partitions.

    Groups that are small in bytes but heavy in work must not be packed into a few
    tasks, which size-based partition coalescing would do.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
