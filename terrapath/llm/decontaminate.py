"""Benchmark passages in documents: q-gram counts in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapath.llm.common import keep, text_batches

#: Bytes of a q-gram; two 8-byte words, overlapping by 4, make one.
Q = 12
#: ASCII white space counts as a blank.
BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
FILTER_BITS = 21
#: Bit of a region's score that counts edits; the bits below carry the region's start.
EDIT = np.int64(1 << 32)


@dataclass(frozen=True)
class Settings:
    """``rate``: allowed edits per byte of an item; ``block_bytes``: item texts that one pass over the documents looks for."""

    rate: float = 0.06
    block_bytes: int = 4_000_000


def fold(text: str) -> bytes:
    """UTF-8 bytes of the text without case, in all scripts: a passage in capitals equals its item."""
    return text.casefold().encode("utf-8", "surrogatepass").translate(BLANKS)


def unfold(text: str, begin: int, end: int) -> tuple[int, int]:
    """Bytes of ``text`` that became the bytes [begin, end) of ``fold(text)``; a letter that changed its length is taken whole."""
    if text.isascii():
        return begin, end
    sizes, folded = (np.array([len(c.encode("utf-8", "surrogatepass")) for c in x], np.int64) for x in (text, map(str.casefold, text)))
    if (sizes == folded).all():
        return begin, end
    at, to = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, folded))

    def place(byte: int, last: bool) -> int:
        k = int(np.searchsorted(to, byte, side="right")) - 1
        inside = byte - to[k]
        if not inside:
            return int(at[k])
        if sizes[k] == folded[k]:
            return int(at[k] + inside)
        return int(at[k + 1] if last else at[k])

    return place(begin, False), place(end, True)


def qgrams(data: bytes) -> np.ndarray:
    """A 64-bit code of every q-gram."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = data + bytes(16)
    words = np.empty(n + 4, np.uint64)
    for k in range(8):
        lane = np.frombuffer(padded, "<u8", (len(padded) - k) // 8, k)
        words[k::8] = lane[: len(words[k::8])]
    return words[:n] * np.uint64(0x9E3779B97F4A7C15) ^ words[4:] * np.uint64(0xC2B2AE3D27D4EB4F)


def edit_budget(size: int, rate: float) -> int:
    """Most edits allowed: ``rate`` of the size, less where no q-gram would have to survive them."""
    return max(0, min(int(size * rate), (size - Q) // Q))


def least_shared(size: int, edits: int) -> int:
    """q-gram lemma: q-grams that an item must share with a text within so many edits."""
    return max(1, size - Q + 1 - edits * Q)


class Index:
    """q-grams of a block of items, and a bit filter in front of them."""

    def __init__(self, items: list[bytes], rate: float):
        self.items = items
        self.edits = np.array([edit_budget(len(b), rate) for b in items], np.int64)
        self.shared = np.array([least_shared(len(b), e) for b, e in zip(items, self.edits, strict=True)], np.int64)
        self.band = np.maximum(self.edits + 1, 8)
        codes = [qgrams(b) for b in items]
        code = np.concatenate([np.zeros(0, np.uint64), *codes])
        owner = np.repeat(np.arange(len(items)), [len(c) for c in codes])
        at = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(c)) for c in codes]])
        order = np.argsort(code, kind="stable")
        self.code, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.owner, self.at = owner[order], at[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.code >> np.uint64(64 - FILTER_BITS)] = True
        #: Items too short for a q-gram are looked for as they are.
        self.short = [i for i, b in enumerate(items) if len(b) < Q]

    def hits(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``data`` and number in ``code`` of every q-gram of an item."""
        codes = qgrams(data)
        at = np.flatnonzero(self.filter[codes >> np.uint64(64 - FILTER_BITS)])
        place = np.searchsorted(self.code, codes[at])
        place[place == len(self.code)] = 0
        real = self.code[place] == codes[at] if len(self.code) else np.zeros(0, bool)
        return at[real], place[real]

    def regions(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, document and first diagonal of every band with enough shared q-grams.

        ``starts`` are the documents' places in ``data``.  A diagonal is the place of a match less
        its place in the item.  Bands of an item are ``2 * band`` diagonals wide and overlap
        by half, so that matches spread over at most ``edits`` diagonals always share one.
        """
        at, place = self.hits(data)
        many = self.count[place]
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(self.first[place], many) + nth
        item, spot = self.owner[entry], np.repeat(at, many)
        doc = np.searchsorted(starts, spot, side="right") - 1
        half = (spot - starts[doc] - self.at[entry] + len(data)) // self.band[item]
        key = (doc * np.int64(len(self.items)) + item) << 32 | half
        half_key, n = np.unique(key, return_counts=True)
        joint = np.concatenate([half_key, half_key - 1])
        band, inverse = np.unique(joint, return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([n, n]))
        item = (band >> 32) % len(self.items)
        good = total >= self.shared[item]
        band, item = band[good], item[good]
        return item, (band >> 32) // len(self.items), (band & 0xFFFFFFFF) * self.band[item] - len(data)

    def align(self, data: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits between each item and a stretch of its document ([low, high) of ``data``), begin and end.

        Banded dynamic programming, all regions of one item at a time side by side: cell (i, j) of the
        band is item byte i against the document at ``low + diagonal + i + j``.  A score carries the edits in its upper and the
        stretch's begin in its lower bits, so that one minimum finds both.
        """
        edits, begin, end = (np.empty(len(item), np.int64) for _ in range(3))
        for which in np.unique(item):
            rows = np.flatnonzero(item == which)
            for part in np.array_split(rows, -(-len(rows) // 2048)):
                edits[part], begin[part], end[part] = self._align_item(data, which, low[part], high[part], diagonal[part])
        return edits, begin, end

    def _align_item(self, data: np.ndarray, which: int, low: np.ndarray, high: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, e = self.items[which], self.edits[which]
        width = int(2 * self.band[which] + 2 * e + 1)
        offsets = np.arange(width)
        base = low + diagonal - e
        far = EDIT * np.int64(1 << 20)
        spot = base[:, None] + offsets
        score = np.where((spot >= low[:, None]) & (spot <= high[:, None]), spot, far)
        ramp = offsets * EDIT
        for i, byte in enumerate(text):
            spot = base[:, None] + offsets + i
            there = (spot >= low[:, None]) & (spot < high[:, None])
            seen = data[np.clip(spot, 0, len(data) - 1)]
            step = np.where(there, score + np.where(seen == byte, 0, EDIT), far)
            skip = np.concatenate([score[:, 1:], np.full((len(score), 1), far)], axis=1) + EDIT
            best = np.minimum(step, skip)
            score = np.minimum.accumulate(best - ramp, axis=1) + ramp
            score = np.where(spot + 1 <= high[:, None], score, np.where(spot + 1 == high[:, None] + 1, skip, far))
        j = score.argmin(axis=1)
        least = score[np.arange(len(score)), j]
        return least >> 32, least & 0xFFFFFFFF, base + j + len(text)


def find(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, begin, end, edits) of the best stretch of every item in every text, bytes."""
    folded = [fold(t) if t else b"" for t in texts]
    gap = bytes(Q)
    data = gap.join(folded)
    sizes = np.array([len(b) for b in folded], np.int64)
    starts = np.cumsum(sizes + Q) - sizes - Q
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i in index.short:
        for n, b in enumerate(folded):
            at = b.find(index.items[i]) if index.items[i] else -1
            if at >= 0:
                found[n, i] = (0, at, at + len(index.items[i]))
    if len(index.code) and len(data) >= Q:
        item, doc, diagonal = index.regions(data, starts)
        low, high = starts[doc], starts[doc] + sizes[doc]
        edits, begin, end = np.full(len(item), -1), np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        for k in range(len(item)):  # a stretch that equals its item needs no alignment
            first = max(low[k], low[k] + diagonal[k])
            at = data.find(index.items[item[k]], first, min(high[k], first + 2 * index.band[item[k]] + len(index.items[item[k]])))
            if at >= 0:
                edits[k], begin[k], end[k] = 0, at, at + len(index.items[item[k]])
        rest = np.flatnonzero(edits < 0)
        edits[rest], begin[rest], end[rest] = index.align(np.frombuffer(data, np.uint8), item[rest], low[rest], high[rest], diagonal[rest])
        for k in np.flatnonzero(edits <= index.edits[item]):
            pair = (int(doc[k]), int(item[k]))
            hit = (int(edits[k]), int(begin[k] - low[k]), int(end[k] - low[k]))
            found[pair] = min(found.get(pair, hit), hit)
    return [(n, i, *unfold(texts[n], begin, end), e) for (n, i), (e, begin, end) in sorted(found.items())]


def find_items(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold a benchmark item up to ``rate`` edits per byte.

    One row per document row and different item text: ``doc_id, item_id`` (the smallest of equal
    texts), ``item_ids`` (all of them), ``begin, end`` (bytes of the text), ``edits`` (bytes, case folded).

    Items are handed to the tasks in blocks of at most ``block_bytes`` (an item larger
    than that is a block of its own), and every block passes over all documents, so the
    size of what is broadcast is bounded and no pairs are shuffled.  Case (in all scripts) and the
    kind of white space don't count.  Null or empty documents hold nothing; null or
    empty items are in no document.  Repeated document rows are all reported; equal item
    texts are searched once.  Other columns of the inputs are not used.
    """
    spark = docs.sparkSession
    texts = (
        items.where(F.length("text") > 0)
        .groupBy("text")
        .agg(F.min("item_id").alias("item_id"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )
    size = F.octet_length("text").cast("long")
    shelf = F.floor(F.sum(size).over(W.partitionBy("_hash").orderBy("item_id", "text")) / settings.block_bytes)
    blocks = keep(texts.withColumn("_hash", F.pmod(F.xxhash64("text"), F.lit(_hashes(texts, settings)))).withColumn("_shelf", shelf))
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item bigint, begin bigint, end bigint, edits bigint"
    found = None
    for b in sorted(tuple(r) for r in blocks.select("_hash", "_shelf").distinct().collect()):
        names = blocks.where((F.col("_hash") == b[0]) & (F.col("_shelf") == b[1])).withColumn(
            "item", F.row_number().over(W.orderBy("item_id", "text")).cast("long") - 1
        )
        rows = sorted(names.select("item", "text").collect())
        shared = spark.sparkContext.broadcast(Index([fold(r.text) for r in rows], settings.rate))
        hits = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_searcher(shared), schema)
        named = hits.join(F.broadcast(names.select("item", "item_id", "item_ids")), "item")
        found = named if found is None else found.unionByName(named)
    if found is None:
        found = docs.select(F.col(doc_id).alias("doc_id"), F.lit(0).cast("long").alias("item")).limit(0)
        kind = items.schema["item_id"].dataType.simpleString()
        found = found.selectExpr("*", "0L AS begin", "0L AS end", "0L AS edits", f"CAST(NULL AS {kind}) AS item_id", f"CAST(NULL AS array<{kind}>) AS item_ids")
    return found.select("doc_id", "item_id", "item_ids", "begin", "end", "edits")


def _hashes(texts: DataFrame, settings: Settings) -> int:
    """Groups that items are dealt to before they are cut into blocks."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 + total // settings.block_bytes


def _searcher(shared):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = shared.value
        for piece in text_batches(batches, max_chars=1_000_000):
            hits = find(index, piece.column("text").to_pylist())
            if hits:
                n, i, begin, end, edits = (pa.array(x, pa.int64()) for x in zip(*hits, strict=True))
                ids = piece.column("doc_id").take(n)
                yield pa.RecordBatch.from_arrays([ids, i, begin, end, edits], names=["doc_id", "item", "begin", "end", "edits"])

    return run
