"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapath.llm.common import hash60, keep, replace_columns

#: A token is a maximal run of characters other than ASCII white space.
TOKEN = "[^ \\t\\n\\x0B\\f\\r]+"
#: Blocks a source's permutation is cut into, as a power of two.
BLOCK_BITS = 12
#: Exponents tried in one pass over the sources: the inner points of six bisections.
FAN = 64
PASSES = 6
#: Up to so many sources (some 100 bytes each) the plan is sent to every task instead of shuffling texts.
SMALL_PLAN = 50_000


@dataclass(frozen=True)
class Target:
    """Either an entropy of the weights in nats, or the most times a source may be shown; ``budget``
    in tokens, or None for the least that shows each document once."""

    entropy: float | None = None
    repetition: float | None = None
    budget: float | None = None


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def permuted(doc_id: Column, seed: int) -> Column:
    """Place of a document in its source's permutation: blocks in order, then inside the block."""
    return hash60(F.lit(seed), doc_id)


def find_exponent(sources: DataFrame, target: Target) -> float:
    """Exponent in [0, 1] nearest to the natural shares (1) that meets an entropy, or nearest to
    even weights (0) that keeps a repetition limit.

    Entropy and repetition fall as the exponent grows.  A pass over the sources evaluates all
    inner points of six successive bisections; ``PASSES`` passes leave an interval of 1.5e-11.
    A limit that even the end of the interval cannot meet gives that end.
    """
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        step = (high - low) / FAN
        points = [low + step * i for i in range(FAN + 1)]
        tried = sources.where("share > 0").select("*", F.explode(F.array(*[F.lit(p) for p in points])).alias("exponent"))
        power = F.pow("share", F.col("exponent"))
        sums = tried.groupBy("exponent").agg(
            F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("m"),
            F.max(power / F.col("tokens")).alias("most"), F.min(power / F.col("tokens")).alias("least"),
        )
        budget = F.lit(float(target.budget)) if target.budget is not None else F.col("z") / F.col("least")
        measured = sums.select(
            "exponent", (F.log("z") - F.col("exponent") * F.col("m") / F.col("z")).alias("entropy"),
            (F.col("most") / F.col("z") * budget).alias("repetition"),
        )
        ok = F.col("entropy") >= target.entropy if target.entropy is not None else F.col("repetition") <= target.repetition
        good = {r["exponent"]: r["ok"] for r in measured.select("exponent", ok.alias("ok")).collect()}
        if not good:
            return 1.0
        met = [p for p in points if good[p]]
        if target.entropy is not None:
            if not met:
                return low
            low, high = max(met), min(max(met) + step, high)
        else:
            if not met:
                return high
            low, high = max(min(met) - step, low), min(met)
    return low if target.entropy is not None else high


def plan_mix(docs: DataFrame, target: Target, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per source: ``source, tokens, share, exponent, weight, repetition, whole, cut``.

    A document is shown ``whole`` times, and once more where its place is at or before ``cut``.
    """
    counted = keep(
        docs.select(F.col(source).alias("source"), token_count(F.col(text)).alias("tokens"), permuted(F.col(doc_id), seed).alias("place"))
    )
    blocked = counted.withColumn("block", F.shiftright("place", 60 - BLOCK_BITS))
    blocks = keep(blocked.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")))
    totals = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = keep(totals.withColumn("share", F.col("tokens") / F.lit(float(max(everything, 1)))))
    exponent = find_exponent(shares, target)
    power = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0)
    sums = shares.where("share > 0").agg(F.sum(power).alias("z"), F.min(power / F.col("tokens")).alias("least")).first()
    z = sums["z"] or 1.0
    budget = float(target.budget) if target.budget is not None else (z / sums["least"] if sums["least"] else 0.0)
    weights = (
        shares.withColumn("exponent", F.lit(exponent))
        .withColumn("weight", power / F.lit(z))
        .withColumn("repetition", F.when(F.col("tokens") > 0, F.col("weight") * F.lit(budget) / F.col("tokens")).otherwise(1.0))
        .withColumn("whole", F.floor(F.col("repetition") + 1e-9))
        .withColumn("rest", (F.col("repetition") - F.col("whole")) * F.col("tokens"))
    )
    same = F.col("b.source").eqNullSafe(F.col("w.source"))
    up_to = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    summed = blocks.withColumn("upto", F.sum("tokens").over(up_to)).alias("b")
    border = (
        summed.join(weights.alias("w"), same)
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("b.tokens") <= F.col("rest")))
        .select("w.source", "block", (F.col("rest") - F.col("upto") + F.col("b.tokens")).alias("left_over"))
    )
    inside = (
        blocked.alias("b")
        .join(border.alias("w"), same & (F.col("b.block") == F.col("w.block")))
        .select("b.source", "place", "tokens", "left_over")
        .withColumn("upto", F.sum("tokens").over(W.partitionBy("source").orderBy("place")))
    )
    cuts = inside.where("upto <= left_over").groupBy("source").agg(F.max("place").alias("cut"))
    starts = border.select("source", (F.shiftleft("block", 60 - BLOCK_BITS) - 1).alias("start"))
    return (
        weights.alias("w")
        .join(starts.alias("s"), F.col("w.source").eqNullSafe(F.col("s.source")), "left")
        .join(cuts.alias("c"), F.col("w.source").eqNullSafe(F.col("c.source")), "left")
        .select("w.source", "tokens", "share", "exponent", "weight", "repetition", "whole", F.coalesce("cut", "start", F.lit(-1)).alias("cut"))
    )


def mix(docs: DataFrame, target: Target, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Add ``share, exponent, weight, repetition, block, place, copies`` to every row.

    Token shares of the sources are raised to an exponent and normalised; the exponent is bisected
    (``find_exponent``).  The weights become token budgets, and a budget is realised over the
    source's permutation, cut into 4096 blocks: as many whole passes as fit, then the longest
    beginning of the permutation within what is left.  Block sums find the block where the
    budget ends and only that block is walked, so a source of any size needs no task of its own.

    A null source is a source of its own; a null or empty text has no tokens and costs nothing.
    A source without tokens is shown once.  Rows with one id have one place and stay or go
    together.  An empty table gives an empty result; input columns named like an output column are replaced.
    """
    plan = keep(plan_mix(docs, target, seed, doc_id, text, source))
    plan = F.broadcast(plan) if plan.count() <= SMALL_PLAN else plan
    chosen = plan.select(
        F.struct("share", "exponent", "weight", "repetition", "whole", "cut").alias("__plan"), F.col("source").alias("__source")
    )
    placed = docs.withColumn("__place", permuted(F.col(doc_id), seed))
    joined = placed.join(chosen, placed[source].eqNullSafe(chosen["__source"]))
    at = F.col("__place")
    return replace_columns(
        joined, share=F.col("__plan.share"), exponent=F.col("__plan.exponent"), weight=F.col("__plan.weight"), repetition=F.col("__plan.repetition"),
        block=F.shiftright(at, 60 - BLOCK_BITS), place=at, copies=(F.col("__plan.whole") + (at <= F.col("__plan.cut")).cast("int")).cast("long"),
    ).drop("__plan", "__source", "__place")
