"""Repeated byte strings by external induced sorting of sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapath.llm.common import store, text_batches

#: Bytes of the gram whose hash decides which suffixes are sampled, and by which they meet.
GRAM = 32
#: Contexts that are induced side by side; bounds memory only.
ROWS = 20_000
#: A gram with more rows than this is compared by string hashes, spread over tasks, not in one task.
CROWD = 20_000
#: Bytes of text that are looked at together; bounds memory only.
SLICE = 1_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from every place on (too short ends: none)."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).tobytes()
    words = np.empty(n + 24, np.uint64)
    for k in range(8):
        part = np.frombuffer(padded, "<u8", (len(padded) - k) // 8, k)
        words[k::8] = part[: len(words[k::8])]
    half = words[:-8] * _A + _mix(words[8:])
    return _mix(half[:-16] * _A + (half[16:] ^ (half[16:] >> np.uint64(31))))


def samples(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Sampled suffixes of the texts that follow each other in ``data``.

    Every string of ``length`` bytes samples the suffix that starts at its least gram hash (the first
    of equal ones), which only depends on the string's bytes.  Returns for each sample its
    text, place, and the first and last start of the strings that chose it (places in
    ``data``), the gram's hash and a hash of all bytes those strings cover.
    """
    hashes = gram_hashes(data)
    span = length - GRAM + 1
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :]) if span > width else least
    chosen = (least[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[:n]
    inside = np.arange(n) + length <= ends[text]
    at = np.flatnonzero(inside)
    new = np.flatnonzero(np.concatenate([[True], (chosen[at][1:] != chosen[at][:-1]) | (text[at][1:] != text[at][:-1])])) if len(at) else at
    first, last = at[new], at[np.append(new[1:] - 1, len(at) - 1)] if len(at) else at
    place = chosen[first]
    return text[first], place, first, last, hashes[place], _mix(_range_hash(data, hashes, first, last + length) ^ (place - first).astype(np.uint64) * _A)


def _range_hash(data: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``data[begin:end]`` from the hashes of grams that cover it, and its length."""
    size = end - begin
    total = size.astype(np.uint64) * _A
    for k in range(int(-(-size.max(initial=0) // GRAM))):
        at = np.minimum(begin + k * GRAM, end - GRAM)
        total = np.where(k * GRAM < size, _mix(total * _B + hashes[at]), total)
    return total


def pack(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place of a sample in its text, and how far before it its strings start, in one number."""
    return place << 16 | (place - first) << 8 | (place - last)


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 16, packed >> 8 & 255, packed & 255


def induce(bucket: np.ndarray, contexts: list[bytes], most: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which strings of ``length`` bytes occur twice: (context number, bytes from the string's start to the sample).

    ``contexts`` are sorted by (bucket, bytes from the sample on), ``most`` is how many bytes lie before the sample.
    The order of the suffixes one byte further left is induced from the order at hand:
    by that byte, then by rank.  The common prefix of neighbours is carried along: one more than the
    least value between two suffixes that stay neighbours within their byte.  Two neighbours with at least
    ``length`` common bytes hold a string twice.  Suffixes that no longer can reach
    ``length`` bytes are left out.
    """
    n = len(contexts)
    width = max(map(len, contexts), default=0)
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    table = np.zeros((n, width + 1), np.int16)
    filled = np.arange(width) < sizes[:, None]
    table[:, :width][filled] = np.frombuffer(b"".join(contexts), np.uint8)
    table[:, :width][~filled] = -1
    table[:, width] = -1
    right = np.arange(width)[None, :] + most[:, None]
    tail = np.take_along_axis(table, np.minimum(right, width), axis=1)
    same = (tail[1:] == tail[:-1]) & (tail[1:] >= 0)
    common = np.zeros(n, np.int64)
    if n > 1:
        common[1:] = np.where(same.all(axis=1), width, (~same).argmax(axis=1))
        common[1:][bucket[1:] != bucket[:-1]] = 0
    rank = np.arange(n)  # context numbers in suffix order
    found, reach = [], 0
    while len(rank):
        twice = common >= length
        if twice.any():
            hit = np.unique(np.concatenate([rank[twice], rank[np.flatnonzero(twice) - 1]]))
            found.append((hit, np.full(len(hit), reach)))
        nearest = np.maximum(common, np.append(common[1:], 0))
        alive = (most[rank] > reach) & (nearest + most[rank] - reach >= length)
        rank, common = _only(rank, common, alive)
        if not len(rank):
            break
        reach += 1
        byte = table[rank, most[rank] - reach].astype(np.int64)
        order = np.argsort(np.cumsum(common == 0) << 8 | byte, kind="stable")
        block = np.cumsum(common == 0)
        kept = np.concatenate([[False], (block[order][1:] == block[order][:-1]) & (byte[order][1:] == byte[order][:-1])])
        moved = np.zeros(len(rank), np.int64)
        here = np.flatnonzero(kept)
        moved[here] = 1 + _least_between(common, order[here - 1] + 1, order[here] + 1)
        rank, common = rank[order], moved
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _only(rank: np.ndarray, common: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leave suffixes out; the common prefix with the one before is the least over the gap."""
    at = np.flatnonzero(alive)
    if len(at) == len(rank) or not len(at):
        return rank[at], common[at]
    begin = np.concatenate([[0], at[:-1] + 1])
    return rank[at], np.minimum.reduceat(common[: at[-1] + 1], begin)


def _least_between(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of ``values[begin:end]`` for many ranges of one entry at least: two overlapping power-of-two stretches each."""
    size, out = end - begin, np.empty(len(begin), np.int64)
    level, width = values, 1
    while True:
        now = (size >= width) & (size < 2 * width)
        out[now] = np.minimum(level[begin[now]], level[end[now] - width])
        if 2 * width > size.max(initial=1):
            return out
        level = np.minimum(level[:-width], level[width:])
        width *= 2


def _sampler(length: int):
    """Arrow batches of (rid, text) to samples; a long text is cut into overlapping slices, so memory stays bounded."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_batches(batches, max_chars=SLICE):
            rid, owner, shift, parts = batch.column("rid"), [], [], []
            for n, text in enumerate(batch.column("text").to_pylist()):
                body = text.encode("utf-8", "surrogatepass")
                for at in range(0, max(1, len(body) - length + 1), SLICE):
                    owner.append(n)
                    shift.append(at)
                    parts.append(body[at : at + SLICE + length - 1])
                    if sum(map(len, parts)) > 2 * SLICE:
                        yield sampled(pa, rid, owner, shift, parts)
                        owner, shift, parts = [], [], []
            yield sampled(pa, rid, owner, shift, parts)

    def sampled(pa, rid, owner: list, shift: list, parts: list):
        sizes = np.array(list(map(len, parts)), np.int64)
        part, place, first, last, gram, cover = samples(np.frombuffer(b"".join(parts), np.uint8), sizes, length)
        base = np.array(shift, np.int64)[part] - (np.cumsum(sizes) - sizes)[part] if len(part) else part
        packed = pack(place + base, first + base, last + base)
        rows = rid.take(pa.array(np.array(owner, np.int64)[part] if len(part) else part))
        arrays = [rows, pa.array(packed), pa.array(gram.view(np.int64)), pa.array(cover.view(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["rid", "packed", "gram", "cover"])

    return run


def _cutter(length: int):
    """(rid, text, marks) to the bytes around each marked sample, before it and from it on."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in text_batches(batches, max_chars=SLICE):
            out: list[list] = [[], [], [], [], [], []]
            for rid, text, marks in zip(*[batch.column(c).to_pylist() for c in ("rid", "text", "marks")], strict=True):
                body = text.encode("utf-8", "surrogatepass")
                for mark in marks:
                    place, most, least = unpack(mark["packed"])
                    row = (mark["gram"], rid, mark["packed"], mark["crowded"], body[place - most : place], body[place : place - least + length])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            names = ["gram", "rid", "packed", "crowded", "before", "rest"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


def _inducer(length: int):
    """Rows sorted by (gram, rest) to ranges of bytes that repeated strings cover."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows >= ROWS:
                gram = held.column("gram").to_numpy()
                change = np.flatnonzero(gram[1:] != gram[:-1])
                if len(change):  # the last gram may go on
                    cut = int(change[-1]) + 1
                    yield ranges(pa, held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield ranges(pa, held)

    def ranges(pa, rows):
        packed = rows.column("packed").to_numpy()
        place, most, _ = unpack(packed)
        contexts = [a + b for a, b in zip(rows.column("before").to_pylist(), rows.column("rest").to_pylist(), strict=True)]
        which, reach = induce(rows.column("gram").to_numpy(), contexts, most, length)
        order = np.lexsort((reach, which))
        which, reach = which[order], reach[order]
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (reach[1:] > reach[:-1] + 1)]) if len(which) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(which) - 1) if len(first) else first
        row = which[first]
        arrays = [pa.array(rows.column("rid").to_numpy()[row]), pa.array(place[row] - reach[last]), pa.array(place[row] - reach[first] + length)]
        return pa.RecordBatch.from_arrays(arrays, names=["rid", "begin", "end"])

    return run


def _strings(length: int):
    """Rows of (rid, packed, before, rest) to a 128-bit hash of each string and its range."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                out: list[list] = [[], [], [], []]
                for rid, packed, before, rest in zip(*[batch.slice(low, 500).column(c).to_pylist() for c in ("rid", "packed", "before", "rest")], strict=True):
                    place, most, _ = unpack(packed)
                    body = before + rest
                    for at in range(len(body) - length + 1):
                        out[0].append(hashlib.blake2b(body[at : at + length], digest_size=16).digest())
                        out[1].append(rid)
                        out[2].append(place - most + at)
                        out[3].append(place - most + at + length)
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["string", "rid", "begin", "end"])

    return run


def _remover(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in text_batches(batches, max_chars=SLICE):
        out: list[list] = [[], [], [], []]
        for text, begins, ends in zip(*[batch.column(c).to_pylist() for c in ("text", "begins", "ends")], strict=True):
            body = text.encode("utf-8", "surrogatepass")
            spans: list[list[int]] = []
            for begin, end in sorted(zip(begins or [], ends or [], strict=True)):
                if spans and begin <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([begin, end])
            borders = [0, *[x for span in spans for x in span], len(body)]
            kept = b"".join(body[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True))
            for column, value in zip(out, (len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
        arrays = [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts (null: empty) under a 64-bit number of id and text; repeated rows share one."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), text).alias("rid")
    )


def _range(length: int) -> tuple[Column, Column]:
    """Begin and end of what all strings of a sample cover."""
    place = F.shiftright("packed", 16)
    return (place - F.shiftright("packed", 8).bitwiseAND(F.lit(255))).alias("begin"), (place - F.col("packed").bitwiseAND(F.lit(255)) + length).alias("end")


def repeated_ranges(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``rid, begin, end``: byte ranges that together are all bytes covered by a repeated string of ``length`` bytes.

    1. Each string samples one suffix by the least hash of its 32-byte grams, so equal strings sample
       equally; about one suffix in 85 is kept, whatever the text.
    2. Samples meet by gram.  A gram that occurs once is done.  Where all bytes that the strings of a gram's
       samples cover are the same, all of them repeat.
    3. Samples of one gram that cover the same bytes are one context: what it covers repeats where it has
       copies, and one sample stands for it.  Contexts bring the bytes around the sample, are sorted by gram and suffix in Spark's external
       sort, which spills to disk, and the strings further left are induced with their common prefixes
       (``induce``).
    4. A gram with more than ``crowd`` rows would be one large task; its strings are counted by hash
       instead, which spreads and combines before the shuffle.
    """
    if not GRAM <= length <= GRAM + 255:
        raise ValueError("length must be 32 to 287")
    rows = _numbered(docs, doc_id, text)
    marks = rows.select("rid", "text").where(F.octet_length("text") >= length).mapInArrow(_sampler(length), "rid bigint, packed bigint, gram bigint, cover bigint")
    counted = marks.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("cover").alias("low"), F.max("cover").alias("high"))
    grams = store(counted.where("n > 1"))  # a written table, so that the join below can split a frequent gram
    met = store(
        marks.join(grams, "gram").select("rid", "packed", "gram", "cover", "n", (F.col("low") == F.col("high")).alias("whole"))
    )
    parted = met.where("NOT whole")
    contexts = store(
        parted.groupBy("gram", "cover").agg(
            F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.min("rid").alias("rid"), F.min_by("packed", "rid").alias("packed")
        )
    )
    copied = parted.join(contexts.where("copies > 1").select("gram", "cover"), ["gram", "cover"], "left_semi")
    out = met.where("whole").select("rid", *_range(length)).unionByName(copied.select("rid", *_range(length)))

    marked = F.struct("packed", "gram", (F.col("n") > crowd).alias("crowded"))
    lists = contexts.groupBy("rid").agg(F.collect_set(marked).alias("marks"))
    bodies = rows.join(lists, "rid").select("rid", "text", "marks").mapInArrow(
        _cutter(length), "gram bigint, rid bigint, packed bigint, crowded boolean, before binary, rest binary"
    )
    bodies = store(bodies)  # read by both ways below; the texts are dealt once
    few = bodies.where("NOT crowded").select("gram", "rid", "packed", "before", "rest")
    sorted_ = few.repartition("gram").sortWithinPartitions("gram", "rest")
    out = out.unionByName(sorted_.mapInArrow(_inducer(length), "rid bigint, begin bigint, end bigint"))
    many = bodies.where("crowded").select("rid", "packed", "before", "rest")
    strings = store(many.mapInArrow(_strings(length), "string binary, rid bigint, begin bigint, end bigint"))
    twice = strings.groupBy("string").count().where("count > 1").select("string")
    return out.unionByName(strings.join(twice, "string", "left_semi").select("rid", "begin", "end"))


def remove_repeats(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that starts anywhere else too, in any text.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.  Texts are UTF-8 bytes; a null text is empty.
    Strings are judged on the input; they may overlap and may repeat inside one text, but never span two texts.
    A repeated row is one more text, so both go in full where they have ``length`` bytes.  An empty table
    gives an empty result; other columns are not used.
    """
    found = repeated_ranges(docs, length, doc_id, text, crowd)
    lists = found.groupBy("rid").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    joined = _numbered(docs, doc_id, text).join(lists, "rid", "left")
    kind = docs.schema[doc_id].dataType.simpleString()
    return joined.select("doc_id", "text", F.col("ranges.begin").alias("begins"), F.col("ranges.end").alias("ends")).mapInArrow(
        _remover, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
