"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapath.llm.common import text_batches

#: Cells of a fingerprint; every digest lies in one cell of each third.
CELLS = 24
#: A sketch that does not peel is tried again with so many times the cells.
GROWTH = 4
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all paragraphs (lines), and where each text's begin (one more entry for the end).

    An empty text has no paragraph.  The n-th repetition of a paragraph in a text has a digest of its
    own, so a text is a set of digests and repetitions count.
    """
    from xxhash import xxh64_intdigest

    lines = [[xxh64_intdigest(p) for p in t.encode("utf-8", "surrogatepass").split(b"\n")] if t else [] for t in texts]
    counts = np.fromiter(map(len, lines), np.int64, len(lines))
    keys = np.fromiter((d for row in lines for d in row), np.uint64, int(counts.sum()))
    owner = np.repeat(np.arange(len(lines)), counts)
    order = np.lexsort((keys, owner))
    same = np.concatenate([[False], (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])]) if len(keys) else np.zeros(0, bool)
    place = np.arange(len(keys))
    nth = np.empty(len(keys), np.int64)
    nth[order] = place - np.maximum.accumulate(np.where(same, 0, place))
    return mix(keys + nth.astype(np.uint64) * _A), np.concatenate([[0], np.cumsum(counts)])


def cells(keys: np.ndarray, size: int) -> np.ndarray:
    """The three cells of each digest."""
    third = size // 3
    salts = [np.uint64(((j + 1) * int(_A) + size) % (1 << 64)) for j in range(3)]
    spread = [(mix(keys + salt) >> np.uint64(32)) * np.uint64(third) >> np.uint64(32) for salt in salts]
    return np.stack([s.astype(np.int64) + j * third for j, s in enumerate(spread)], axis=1)


def check_of(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ _C) & np.uint64(0xFFFFFFFF)


class Sketches:
    """Count, sum of digests and sum of check values per cell, for many texts side by side (all sums wrap)."""

    def __init__(self, count: np.ndarray, total: np.ndarray, check: np.ndarray):
        self.count, self.total, self.check = count, total, check

    @classmethod
    def of(cls, keys: np.ndarray, owner: np.ndarray, n: int, size: int) -> Sketches:
        new = cls(np.zeros((n, size), np.int64), np.zeros((n, size), np.uint64), np.zeros((n, size), np.uint64))
        new.add(keys, owner, np.ones(len(keys), np.int64))
        return new

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        """Add (or, with sign -1, take away) digests."""
        size = self.count.shape[1]
        at = (owner[:, None] * size + cells(keys, size)).ravel()
        sign = np.repeat(sign, 3)
        wide = sign.astype(np.uint64)  # -1 wraps
        np.add.at(self.count.reshape(-1), at, sign)
        np.add.at(self.total.reshape(-1), at, np.repeat(keys, 3) * wide)
        np.add.at(self.check.reshape(-1), at, np.repeat(check_of(keys), 3) * wide)

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(self.count - other.count, self.total - other.total, (self.check - other.check))

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recover what is left: digests, their text, their sign; and which texts were emptied.

        A cell that holds one digest, in either version, gives it away; taking it out of its other
        cells opens further ones.  All such cells of all texts are peeled in one round.
        """
        found = []
        while True:
            text, cell = np.nonzero(np.abs(self.count) == 1)
            sign = self.count[text, cell]
            key = self.total[text, cell] * sign.astype(np.uint64)
            good = (check_of(key) == (self.check[text, cell] * sign.astype(np.uint64)) & np.uint64(0xFFFFFFFF)) & (
                cells(key, self.count.shape[1]) == cell[:, None]
            ).any(axis=1)
            if not good.any():
                break
            text, key, sign = text[good], key[good], sign[good]
            order = np.lexsort((key, text))
            new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1])])
            text, key, sign = text[order][new], key[order][new], sign[order][new]
            self.add(key, text, -sign)
            found.append((key, text, sign))
        empty = ~((self.count != 0) | (self.total != 0) | (self.check & np.uint64(0xFFFFFFFF) != 0)).any(axis=1)
        parts = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, k) for i, k in enumerate((np.uint64, np.int64, np.int64))]
        return parts[0], parts[1], parts[2], empty


def encode(sketches: Sketches, paragraphs: np.ndarray) -> list[str]:
    """Fingerprints: number of paragraphs, then count, digest sum and 16 bits of check per cell, in base 64."""
    n, size = sketches.count.shape
    row = np.dtype([("paragraphs", "<u4"), ("count", "<i2", size), ("total", "<u8", size), ("check", "<u2", size)])
    out = np.zeros(n, row)
    out["paragraphs"], out["count"], out["total"] = paragraphs, sketches.count, sketches.total
    out["check"] = sketches.check & np.uint64(0xFFFF)
    return [base64.b64encode(r.tobytes()).decode() for r in out]


def likeness(keys: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of paragraphs that texts ``a`` and ``b`` have in common, of all that either has (two empty texts: 1).

    The two sketches are subtracted and peeled, which recovers the digests that only one
    version has; a pair that does not peel is sketched again with more cells.
    """
    sizes = np.diff(starts)
    out = np.ones(len(a))
    rest, size = np.arange(len(a)), CELLS
    while len(rest):
        used, place = np.unique(np.concatenate([a[rest], b[rest]]), return_inverse=True)
        left, right = place[: len(rest)], place[len(rest) :]
        owner = np.repeat(np.arange(len(used)), sizes[used])
        at = np.repeat(starts[used] - np.cumsum(sizes[used]) + sizes[used], sizes[used]) + np.arange(len(owner))
        all_ = Sketches.of(keys[at], owner, len(used), size)
        difference = Sketches(*[x[left] - x[right] for x in (all_.count, all_.total, all_.check)])
        _, text, sign, done = difference.peel()
        only_a = np.bincount(text[sign > 0], minlength=len(rest))
        only_b = np.bincount(text[sign < 0], minlength=len(rest))
        union = sizes[a[rest]] + only_b
        value = np.where(union > 0, (sizes[a[rest]] - only_a) / np.maximum(union, 1), 1.0)
        out[rest[done]] = value[done]
        rest, size = rest[~done], size * GROWTH
    return out


def edit(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many first characters of ``following``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(texts: list[str], nexts: list[str]) -> dict[str, list]:
    """Result columns of texts and the texts that follow them."""
    edited = [edit(a, b) for a, b in zip(texts, nexts, strict=True)]
    n = len(texts)
    keys, starts = digests([*texts, *edited, *nexts])
    own = np.arange(n)
    shown = Sketches.of(keys[: starts[2 * n]], np.repeat(np.arange(2 * n), np.diff(starts)[: 2 * n]), 2 * n, CELLS)
    names = encode(shown, np.diff(starts)[: 2 * n])
    near = likeness(keys, starts, np.concatenate([own, own]), np.concatenate([own + n, own + 2 * n]))
    return {
        "n_chars": list(map(len, texts)),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": names[:n], "edited_fingerprint": names[n:], "near_edited": near[:n], "near_next": near[n:],
    }


RESULT = T.StructType(
    [T.StructField(n, T.StringType() if "sha" in n or "finger" in n else T.DoubleType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")]
)


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text (``edit`` with the next row's text) and their likeness.

    Rows are ordered by id (null first), equal ids by a hash of the text; the first row follows the last one.
    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  Equal texts have equal fingerprints; a null text counts as empty; a single row
    follows itself; an empty table gives an empty result; other columns are not used.

    The ids alone are range-partitioned first; the smallest id of each range is a border.  The
    texts are then dealt to these ranges once, and rows at a border go to the range before it as
    well, so each range knows the row that follows its last one.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id").distinct().repartitionByRange(4 * partitions, F.col("doc_id").asc_nulls_first())
    ranges = ids.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("low"))
    lows = sorted({(r.low.known, r.low.doc_id) for r in ranges.collect()}, key=lambda x: (x[0], x[1] if x[0] else 0))
    nulls = bool(lows) and not lows[0][0]
    borders = np.array([x for known, x in lows if known])
    count = len(lows)

    @F.pandas_udf("range int, before int")
    def deal(ids):
        import pandas as pd

        known = ids.notna().to_numpy()
        at = np.zeros(len(ids), np.int64)
        first = ~known & nulls
        if len(borders):
            values = ids[known].to_numpy().astype(borders.dtype)
            place = np.searchsorted(borders, values, side="right") - 1
            at[known] = place + nulls
            first[known] = (borders[np.maximum(place, 0)] == values) & (place >= 0)
        before = pd.array(np.where(first, (at - 1) % max(count, 1), -1), dtype="Int32")
        return pd.DataFrame({"range": at.astype(np.int32), "before": before})

    dealt = rows.withColumn("at", deal("doc_id")).withColumn("tie", F.xxhash64("text"))
    homes = F.array(F.struct(F.col("at.range").alias("range"), F.lit(False).alias("lent")))
    both = F.concat(homes, F.array(F.struct(F.col("at.before").alias("range"), F.lit(True).alias("lent"))))
    spread = dealt.select("doc_id", "text", "tie", F.explode(F.when(F.col("at.before") >= 0, both).otherwise(homes)).alias("to"))
    placed = spread.select("doc_id", "text", "tie", "to.range", "to.lent").repartition(partitions, "range")
    ordered = placed.sortWithinPartitions("range", "lent", F.col("doc_id").asc_nulls_first(), "tie").select("range", "lent", "doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_chars", T.LongType()), *RESULT.fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def result(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
            made = compare(texts, nexts)
            arrays = [pa.array(ids, id_type), pa.array(made["n_chars"], pa.int64()), *[pa.array(made[f.name]) for f in RESULT.fields]]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        last, id_type = None, None  # a row waits for the one that follows it
        for piece in text_batches(batches):
            id_type = piece.schema.field("doc_id").type
            ids, texts, nexts = [], [], []
            for r, lent, i, t in zip(*[piece.column(c).to_pylist() for c in ("range", "lent", "doc_id", "text")], strict=True):
                if last is not None and last[0] == r:
                    ids.append(last[1])
                    texts.append(last[2])
                    nexts.append(t)
                last = None if lent else (r, i, t)
            if ids:
                yield result(ids, texts, nexts)

    return ordered.mapInArrow(run, schema)
