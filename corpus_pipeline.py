"""Toxicity, near-dedup, decontamination, mixing and sharding of ``documents``, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapath.llm import decontaminate, mixing, near_copies, queries, sharding, toxicity
from terrapath.llm.common import store, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject."""
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies: five words, similarity 0.8 or more."""
    return near_copies.one_of_each(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item; a row goes by its own text, whatever rows share its id or have none."""
    same_row = F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    rows = docs.select(*COLUMNS).withColumn("_row", same_row)
    leaks = decontaminate.find_items(rows, table(spark, sf_dir, "benchmark"), doc_id="_row")
    gone = leaks.select(F.col("doc_id").alias("_gone")).distinct()
    return rows.join(gone, F.col("_row") == F.col("_gone"), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks for, once at least."""
    mixed = mixing.mix(docs, mixing.Target(repetition=queries.REPETITION))
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, queries.SHARDS)


STAGES = [
    ("toxicity", drop_toxic), ("near-dedup", drop_copies), ("decontamination", drop_leaks),
    ("mixing", mix_sources), ("sharding", shard),
]

#: SQL cannot express the trained and sketching stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage returns is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
