"""Jump consistent hashing of rows to shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapath.llm.common import replace_columns

LOW32 = (1 << 32) - 1
#: Fixed values of the published jump hash: multiplier of its linear congruential generator, and the range of its quotient.
MULTIPLIER = 2862933555777941757
JUMP_RANGE = float(1 << 31)


def _half(md5: Column, start: int) -> Column:
    return F.conv(F.substring(md5, start, 8), 16, 10).cast("long")


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """``state * MULTIPLIER + 1`` modulo 2**64 on two 32-bit halves, free of overflow."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & LOW32
    top, bottom = m_lo >> 16, m_lo & 0xFFFF

    def cut(c: Column) -> Column:
        return c.bitwiseAND(F.lit(LOW32))

    def upper_part(x: Column) -> Column:
        return F.shiftleft((x * F.lit(top)).bitwiseAND(F.lit(0xFFFF)), 16)

    low = lo * F.lit(bottom) + upper_part(lo) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(lo * F.lit(top), 16)
    return cut(carry + cut(lo * F.lit(m_hi)) + cut(hi * F.lit(bottom)) + upper_part(hi)), cut(low)


def jump_shards(key: Column, shards: int) -> tuple[Column, Column]:
    """Shard of a key among ``shards`` and among ``shards + 1``.

    The key's text is hashed with MD5 to the 64-bit start state (null: the empty
    text).  Both counts share one walk: a key's stops do not depend on the number of
    shards, only on where the walk ends, and every jump goes forward, so
    ``shards + 1`` jumps always suffice.
    """
    md5 = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    start = F.struct(
        _half(md5, 1).alias("hi"), _half(md5, 9).alias("lo"), F.lit(0).cast("long").alias("stop"),
        F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"),
    )

    def jump(at: Column, _: Column) -> Column:
        hi, lo = _next_state(at.hi, at.lo)
        further = F.floor((at.stop + 1).cast("double") * (F.lit(JUMP_RANGE) / (F.shiftright(hi, 1) + 1).cast("double")))
        return F.struct(
            hi.alias("hi"), lo.alias("lo"), F.when(at.stop <= shards, further).otherwise(at.stop).alias("stop"),
            F.when(at.stop < shards, at.stop).otherwise(at.shard).alias("shard"),
            F.when(at.stop <= shards, at.stop).otherwise(at.grown).alias("grown"),
        )

    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, jump)
    return end.shard, end.grown


def assign_shards(docs: DataFrame, shards: int = 24, blocks: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``size, text_crc32, law, shard, slot, grown_shard`` to every row.

    ``size`` is the UTF-8 length of the text plus 8, ``text_crc32`` its checksum,
    ``shard`` the jump hash of the key among ``shards``, ``grown_shard`` the same with
    one shard more.  ``slot`` numbers the rows of a shard from 0 without gaps.  A shard
    is numbered in ``blocks`` independent blocks, so that no task holds a whole shard:
    counts of blocks are added up first (``shards * blocks`` rows at most).

    A null text counts as empty, a null key as the empty text.  Repeated rows get one
    shard and a slot each; an empty table gives an empty result.  Input columns with a
    name of an output column are replaced.
    """
    shard, grown = jump_shards(F.col(key), shards)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = replace_columns(
        docs,
        size=(F.octet_length(body) + 8).cast("long"), text_crc32=F.crc32(body), law=F.lit("key"),
        __at=F.struct(shard.cast("int").alias("shard"), grown.cast("int").alias("grown")),
    ).select("*", F.col("__at.shard").alias("__shard"))
    placed = placed.withColumn("__block", F.pmod(F.xxhash64(F.col(key).cast("string"), "text_crc32"), F.lit(blocks)))
    counts = placed.groupBy("__shard", "__block").count()
    before = W.partitionBy("__shard").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__shard", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(W.partitionBy("__shard", "__block").orderBy(key, "text_crc32"))
    numbered = placed.withColumn("__rank", inside).join(offsets, ["__shard", "__block"])
    return replace_columns(
        numbered, shard=F.col("__at.shard"), slot=(F.col("__rank") - 1 + F.col("__offset")).cast("long"), grown_shard=F.col("__at.grown")
    ).drop("__shard", "__block", "__at", "__rank", "__offset")
