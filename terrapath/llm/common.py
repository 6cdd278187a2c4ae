"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see and which outlives each of them.

    Without that setting a local master gets a temporary folder (tests); a cluster
    has no folder that all machines share, so the call fails there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again; readers then fetch only the columns they need."""
    path = f"{folder or shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A ``store`` whose tables are deleted at the end of the block; what outlives it must not read them any more."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield lambda df: store(df, folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def replace_columns(df: DataFrame, **new: Column) -> DataFrame:
    """``df`` with the new columns at its end; equally named columns (in any case) go."""
    taken = {name.lower() for name in new}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[c.alias(n) for n, c in new.items()])


def hash60(*cols: Column) -> Column:
    """Number in [0, 2**60) that depends on the values alone; null counts as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def text_batches(batches: Iterator, column: str = "text", max_chars: int = 4_000_000) -> Iterator:
    """Cut Arrow record batches so that a piece holds some 4 MB of text, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_chars:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)
