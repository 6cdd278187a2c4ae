"""SimHash near-duplicates found by a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapath.llm.common import keep, text_batches
from terrapath.llm.components import components

SEED = 42
BITS = 64
#: Codes below a lowest node, and nodes below an upper one.
FANOUT = 8
#: Node pairs looked at side by side; bounds memory only.
PAIRS = 200_000
#: Rows read before whole buckets are searched; bounds memory only.
ROWS = 100_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the word shingles, repeats included.

    Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased.  A text of fewer
    words than ``width`` is one shingle; one without words has fingerprint zero.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    n = max(1, len(words) - width + 1)
    begins = [0, *ends[: n - 1]]
    stops = ends[width - 1 :] if len(words) >= width else [len(line) + 1]
    hashes = np.array([xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(begins, stops, strict=True)], ">u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, code``: the fingerprint of every row as a signed 64-bit number."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, code bigint"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for piece in text_batches(batches):
            codes = np.array([fingerprint(t, width) for t in piece.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(codes.view(np.int64))], names=["doc_id", "code"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def masks(radius: int) -> list[int]:
    """Bit patterns of which two codes within ``radius`` bits must share one in full.

    The bits are cut into ``radius + 2`` blocks; at most ``radius`` blocks differ, so two are equal.
    """
    blocks = np.array_split(np.arange(BITS), radius + 2)
    return [sum(1 << int(b) for b in (*x, *y)) for x, y in combinations(blocks, 2)]


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence, where neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Codes of many buckets under a forest of nodes.

    Codes are sorted by (bucket, Gray rank), so neighbours share many bits.  A node stands for up to
    ``FANOUT`` successive codes or nodes of one bucket and holds the bits that all codes
    below it share (``same``) and their values (``bits``).  The root of a bucket holds at least
    the bucket's mask.  For two nodes, the differences in commonly shared bits bound the
    distance of any two codes below them from below; bits that are not shared add to the bound
    from above.
    """

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), bucket))
        self.order, self.codes, bucket = order, codes[order], bucket[order]
        self.levels = [(np.full(len(codes), ~np.uint64(0)), self.codes, np.arange(len(codes)), np.arange(len(codes)) + 1)]
        while True:
            same, bits, _, _ = self.levels[-1]
            new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            if len(new) == len(bucket):
                return
            size = np.diff(np.append(new, len(bucket)))
            nth = np.arange(len(bucket)) - np.repeat(new, size)
            first = np.flatnonzero(nth % FANOUT == 0)
            ones = np.bitwise_and.reduceat(bits | ~same, first)
            zeros = np.bitwise_and.reduceat(~bits | ~same, first)
            shared = np.bitwise_and.reduceat(same, first) & (ones | zeros)
            last = np.append(first[1:], len(bucket))
            self.levels.append((shared, ones & shared, first, last))
            bucket = bucket[first]

    def forest(self, radius: int) -> np.ndarray:
        """For every code (in the given order) the number of a code it is linked with, directly or over others.

        Codes with one number are connected inside a bucket; all connected ones have one number.
        """
        parent = np.arange(len(self.codes))
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS:
                stack += [(level, a[i : i + PAIRS], b[i : i + PAIRS]) for i in range(0, len(a), PAIRS)]
                continue
            same, bits, first, last = self.levels[level]
            common = same[a] & same[b]
            least = np.bitwise_count((bits[a] ^ bits[b]) & common)
            most = least + np.bitwise_count(~common)
            linked = most <= radius
            low = self._first_code(level)
            self._unite(parent, low[a[linked]], low[b[linked]])
            alone = linked & (a == b)
            if level and alone.any():
                self._unite_below(parent, level, a[alone])
            open_ = (least <= radius) & ~linked
            if level and open_.any():
                stack.append((level - 1, *self._children(first, last, a[open_], b[open_])))
        out = np.empty(len(parent), np.int64)
        out[self.order] = self.order[parent]
        return out

    def _first_code(self, level: int) -> np.ndarray:
        at = self.levels[level][2] if level else np.arange(len(self.codes))
        for lower in range(level - 1, 0, -1):
            at = self.levels[lower][2][at]
        return at

    def _unite_below(self, parent: np.ndarray, level: int, nodes: np.ndarray) -> None:
        """Link all codes below a node: any two of them are near."""
        begin = self._first_code(level)
        stop = np.append(begin[1:], len(self.codes))[nodes]
        size = stop - begin[nodes]
        first = np.repeat(begin[nodes], size)
        self._unite(parent, first, first + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))

    @staticmethod
    def _children(first: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children; of a node with itself each pair once."""
        na, nb = last[a] - first[a], last[b] - first[b]
        many = na * nb
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        wide = np.repeat(nb, many)
        x, y = np.repeat(first[a], many) + nth // wide, np.repeat(first[b], many) + nth % wide
        once = np.repeat(a != b, many) | (x <= y)
        return x[once], y[once]

    @staticmethod
    def _unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Hook the larger root below the smaller until no link joins two roots."""
        while len(x):
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up
            rx, ry = parent[x], parent[y]
            apart = rx != ry
            if not apart.any():
                return
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            np.minimum.at(parent, np.maximum(rx, ry), np.minimum(rx, ry))


def link_codes(codes: DataFrame, radius: int = 4) -> DataFrame:
    """Edges ``a, b`` that connect all codes of ``codes (code, distinct)`` within ``radius`` bits of each other.

    Every code goes to one bucket per mask, keyed by its bits under the mask; two near codes meet in one
    bucket at least.  Inside a bucket the Gray-ordered index finds near codes and returns a spanning forest,
    so the edges never outnumber the codes times the masks.
    """
    patterns = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks(radius)]
    placed = codes.select(
        "code", F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(m)) for m in patterns])).alias("mask", "key")
    )
    partitions = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = placed.repartition(partitions, "mask", "key").sortWithinPartitions("mask", "key")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []

        def search(rows: np.ndarray) -> pa.RecordBatch:
            new = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
            bucket = np.concatenate([[0], np.cumsum(new)])
            crowded = np.bincount(bucket)[bucket] > 1
            value = rows[crowded, 2]
            to = value[GrayIndex(bucket[crowded], value.view(np.uint64)).forest(radius)]
            linked = value != to
            return pa.RecordBatch.from_arrays([pa.array(value[linked]), pa.array(to[linked])], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("mask", "key", "code")], axis=1))
            if sum(map(len, held)) >= ROWS:
                rows = np.concatenate(held)
                change = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1))
                if len(change):  # the last bucket may go on
                    held = [rows[change[-1] + 1 :]]
                    yield search(rows[: change[-1] + 1])
                else:
                    held = [rows]
        if held:
            yield search(np.concatenate(held))

    return buckets.select("mask", "key", "code").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``fingerprint`` has 16 lower-case hexadecimal digits; ``component_id`` is the smallest id that
    can be reached over links of at most ``radius`` differing bits.  Equal fingerprints
    are one class, represented by their smallest id, before any search.

    A null, empty or wordless text has fingerprint zero and is linked like any other.  A null id never is a
    smallest id unless its component has no other.  Repeated rows stay; an empty table gives an empty result.
    """
    marked = keep(fingerprints(docs, width, doc_id, text))
    classes = keep(marked.groupBy("code").agg(F.min("doc_id").alias("first_id")))
    edges = keep(link_codes(classes.select("code"), radius))
    labels = components(edges)
    labelled = classes.join(labels.withColumnRenamed("node", "code"), "code", "left").withColumn("label", F.coalesce("label", "code"))
    smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(smallest, "label").select("code", "component_id")
    return marked.join(named, "code").select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; a repeated row stays once.

    Rows without an id stay, as no other row can stand for them by name, but equal ones stay once.
    """
    found = near_duplicates(docs, radius, width, doc_id, text)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col(doc_id) == F.col("_gone"), "left_anti").dropDuplicates([doc_id, text])
