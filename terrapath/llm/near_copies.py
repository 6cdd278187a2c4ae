"""Near copies by Jaccard similarity of word shingles: SimHashes and MinHash bands propose, whole shingle sets confirm."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapath.llm import simhash
from terrapath.llm.chaining import word_hashes, word_table
from terrapath.llm.common import keep, scratch, store, text_batches
from terrapath.llm.components import components

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Settings:
    """``width``: words of a shingle; ``similarity``: least Jaccard similarity of two copies; ``bands`` of ``rows`` least hashes:
    two texts of similarity s share no band with chance ``(1 - s ** rows) ** bands``, 6e-4 at 0.8, 7e-6 at 0.85;
    ``radius``: bits that SimHashes differ in at most for their texts to be compared."""

    width: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 7
    radius: int = 4


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    return (h ^ (h >> np.uint64(29))) * _B


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of all texts, ordered by text and value, and how many each text has.

    A text of fewer words than ``width`` is one shingle; one without words has none.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    text = np.repeat(np.arange(len(counts)), counts)
    left = ends[text] - np.arange(len(hashes))
    value = np.zeros(len(hashes), np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for i in range(width):
        value = _mix(value) + np.where(left > i, padded[i : i + len(hashes)], np.uint64(i))
    value = _mix(value)
    real = (left >= width) | (np.arange(len(hashes)) == begins[text])
    text, value = text[real], value[real]
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return value[new], np.bincount(text[new], minlength=len(counts))


def signatures(values: np.ndarray, sizes: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Code of every set in two words (equal sets have equal codes, an empty one zeros) and its band keys, a row per set that has any."""
    some = sizes > 0
    begins = (np.cumsum(sizes) - sizes)[some]
    codes = np.zeros((len(sizes), 2), np.uint64)
    keys = np.zeros((len(begins), settings.bands), np.uint64)
    if len(begins):
        codes[some, 0] = _mix(np.add.reduceat(_mix(values), begins))
        codes[some, 1] = _mix(np.add.reduceat(_mix(values ^ _B), begins))
        random = np.random.default_rng(7)
        for band in range(settings.bands):
            key = np.full(len(begins), band, np.uint64)
            for _ in range(settings.rows):
                a, c = random.integers(0, 1 << 64, 2, np.uint64)
                key = _mix(key) + np.minimum.reduceat(values * (a | np.uint64(1)) + c, begins)
            keys[:, band] = _mix(key)
    return codes, keys


def _sets(texts: list[str | None], table, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    table.begin()
    return shingles(*word_hashes(texts, table), settings.width)


def _reader(settings: Settings):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = word_table()
        for piece in text_batches(batches, max_chars=2_000_000):
            texts = piece.column("text").to_pylist()
            values, sizes = _sets(texts, table, settings)
            prints = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
            codes, keys = signatures(values, sizes, settings)
            offsets = np.concatenate([[0], np.cumsum(sizes > 0)]) * settings.bands
            bands = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
            ends = pa.py_buffer(np.arange(0, 16 * len(codes) + 1, 16, dtype=np.int32))
            code = pa.BinaryArray.from_buffers(pa.binary(), len(codes), [None, ends, pa.py_buffer(codes.tobytes())])
            marks = [code, pa.array(prints.view(np.int64)), pa.array(sizes.astype(np.int32)), bands]
            yield pa.RecordBatch.from_arrays([piece.column("rid"), piece.column("doc_id"), *marks], names=["rid", "doc_id", "code", "print", "size", "bands"])

    return run


def _set_reader(settings: Settings):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = word_table()
        for piece in text_batches(batches, max_chars=2_000_000):
            values, sizes = _sets(piece.column("text").to_pylist(), table, settings)
            ends = np.cumsum(sizes)
            sets = pa.array([values[e - n : e].tobytes() for n, e in zip(sizes, ends, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column("code"), sets], names=["code", "shingles"])

    return run


def alike(x: bytes, y: bytes, similarity: float) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(both) - common) - 1e-9


def _confirmer(settings: Settings):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            pairs = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            good = pa.array([n for n, (x, y) in enumerate(pairs) if alike(x, y, settings.similarity)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(good), batch.column("b").take(good)], names=["a", "b"])

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The ``pairs (a, b)`` whose sets are similar."""
    first = pairs.join(sets.select(F.col("code").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("code").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_confirmer(settings), "a binary, b binary")


def _rarest(settings: Settings):
    """Of each set, rarest shingles first, as many as a similar set must share one of, with their places in that order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            row, place, out = [], [], []
            for r, (n, known) in enumerate(zip(batch.column("size").to_pylist(), batch.column("known").to_pylist(), strict=True)):
                # shingles of one set only are not in ``known``; they come first
                alone = n - len(known)
                wanted = n - int(np.ceil(settings.similarity * n - 1e-9)) + 1 - alone
                if wanted > 0:
                    for p, k in enumerate(sorted((x["many"], x["shingle"]) for x in known)[:wanted]):
                        row.append(r), place.append(alone + p), out.append(k[1])
            at = pa.array(row, pa.int64())
            arrays = [*[batch.column(c).take(at) for c in ("code", "label", "size")], pa.array(place, pa.int32()), pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["code", "label", "size", "place", "shingle"])

    return run


def _exploder(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        sets = [np.frombuffer(s, np.int64) for s in batch.column("shingles").to_pylist()]
        many = np.array([len(s) for s in sets], np.int64)
        at = pa.array(np.repeat(np.arange(len(sets)), many))
        arrays = [batch.column("code").take(at), batch.column("label").take(at), batch.column("size").take(at)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], names=["code", "label", "size", "shingle"])


def _meet(rare: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of ``rare (code, label, size, place, shingle)`` of different labels that can still be similar.

    Similar sets share ``least`` shingles, so what lies before the first shared one leaves room for ``least`` in both.
    """
    other = rare.select("shingle", *[F.col(c).alias(f"_{c}") for c in ("code", "label", "size", "place")])
    least = F.ceil((F.col("size") + F.col("_size")) * F.lit(settings.similarity / (1 + settings.similarity)) - 1e-9)
    near = (F.col("size") >= settings.similarity * F.col("_size") - 1e-9) & (F.col("_size") >= settings.similarity * F.col("size") - 1e-9)
    room = (F.col("place") + least <= F.col("size")) & (F.col("_place") + least <= F.col("_size"))
    met = rare.join(other, "shingle").where((F.col("code") < F.col("_code")) & (F.col("label") != F.col("_label")) & near & room)
    return met.select(F.col("code").alias("a"), F.col("_code").alias("b")).distinct()


def _labelled(rows: DataFrame, labels: DataFrame, name: str, out: str) -> DataFrame:
    found = labels.select(F.col("node").alias(name), F.col("label").alias("_found"))
    return rows.join(found, name, "left").withColumn(out, F.coalesce("_found", name)).drop("_found")


def link_sets(classes: DataFrame, proposed: DataFrame, read_sets, settings: Settings = Settings(), store=store) -> DataFrame:
    """Edges ``a, b`` that connect all codes of ``classes (code, size, bands)`` with similar sets.

    The hub of a band is the member that meets most sets in all its bands together.  Every code is compared with one hub,
    that of its fullest band, and along ``proposed (a, b)``, which joins nearly all copies by one comparison each; then with the other
    hubs of its bands, as far as their labels still differ.  Only members of bands that hold several labels even then are compared
    with each other, where the rarest shingles of two sets leave room for enough shared ones:
    a passage that millions of texts hold makes no pairs.
    """
    placed = classes.select("code", F.explode("bands").alias("key"))
    # written tables on the small side of a join let Spark split a frequent key
    shared = store(placed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    met = store(placed.join(shared, "key"))
    weights = store(met.groupBy("code").agg(F.sum("members").alias("weight")))
    hubs = store(met.join(weights, "code").groupBy("key").agg(F.max(F.struct("weight", "code"))["code"].alias("hub")))
    asks = store(met.join(hubs, "key").where("code <> hub").groupBy("code", "hub").agg(F.max("members").alias("members")))
    ends = met.select("code").unionByName(proposed.select(F.col("a").alias("code"))).unionByName(proposed.select(F.col("b").alias("code")))
    sets = store(read_sets(ends.distinct()))
    first = asks.groupBy(F.col("code").alias("a")).agg(F.max(F.struct("members", "hub"))["hub"].alias("b"))
    links = keep(_confirm(first.unionByName(proposed).distinct(), sets, settings))
    labels = components(links)
    apart = _labelled(_labelled(asks, labels, "code", "_a"), labels, "hub", "_b").where("_a <> _b").select(F.col("code").alias("a"), F.col("hub").alias("b"))
    links = keep(links.unionByName(_confirm(apart.join(first, ["a", "b"], "left_anti"), sets, settings)))
    labels = components(links)
    marked = store(_labelled(met, labels, "code", "label").select("key", "code", "label"))
    mixed = store(marked.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("key"))
    open_ = store(marked.join(mixed, "key").select("code", "label").distinct())
    exploded = "code binary, label binary, size int, shingle bigint"
    held = store(open_.join(sets, "code").selectExpr("code", "label", "cast(length(shingles) / 8 as int) AS size", "shingles").mapInArrow(_exploder, exploded))
    often = store(held.groupBy("shingle").agg(F.count("*").alias("many")).where("many > 1"))
    known = held.join(often, "shingle").groupBy("code", "label", "size").agg(F.collect_list(F.struct("shingle", "many")).alias("known"))
    rare = store(known.mapInArrow(_rarest(settings), "code binary, label binary, size int, place int, shingle bigint"))
    return keep(links.unionByName(_confirm(store(_meet(rare, settings)), sets, settings)))


def near_prints(classes: DataFrame, radius: int, store=store) -> DataFrame:
    """Edges ``a, b`` between codes of ``classes (code, print)`` that connect all whose SimHashes are equal or within ``radius`` bits."""
    leads = store(classes.groupBy("print").agg(F.min("code").alias("lead")))
    same = classes.join(leads, "print").where("code <> lead").select(F.col("code").alias("a"), F.col("lead").alias("b"))
    near = simhash.link_codes(leads.select(F.col("print").alias("code")), radius)
    for end in ("a", "b"):
        near = near.join(leads.select(F.col("print").alias(end), F.col("lead").alias(f"_{end}")), end).drop(end)
    return store(same.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b"))))


def one_of_each(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group of near copies; a repeated row stays once.

    Two texts are linked if the sets of their shingles (words apart by ASCII white space, A-Z lower-cased) have a Jaccard similarity
    of ``similarity`` at least; a group is what links connect.  Texts without words (null and empty ones too) are one group.
    Rows without an id stay, as no other row can stand for them by name, but equal ones stay once.  An empty table
    gives an empty result; other columns, whatever their names, pass unchanged.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    # 128 bits: two rows of a very large table must not share a name
    name, body = F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.concat(F.lit("t"), F.col(text))
    rid = F.unhex(F.md5(F.concat_ws("\x1f", F.coalesce(name, F.lit("")), F.coalesce(body, F.lit("")))))
    rows = docs.select(rid.alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    with scratch(docs.sparkSession) as put:
        marked = put(rows.mapInArrow(_reader(settings), f"rid binary, doc_id {kind}, code binary, print bigint, size int, bands array<bigint>"))
        classes = put(marked.groupBy("code").agg(F.min_by(F.struct("rid", "print", "size", "bands"), "rid").alias("_one")).select("code", "_one.*"))

        def read_sets(codes: DataFrame) -> DataFrame:
            wanted = put(classes.join(codes, "code").select("rid", "code"))
            # repeated rows go while they are text, by the key of the join: sets take twice the room
            found = rows.select("rid", "text").join(wanted, "rid").dropDuplicates(["rid"]).select("code", "text")
            return found.mapInArrow(_set_reader(settings), "code binary, shingles binary")

        near = near_prints(classes.select("code", "print"), settings.radius, put)
        labels = components(link_sets(classes.select("code", "size", "bands"), near, read_sets, settings, put))
        ids = marked.groupBy("code").agg(F.min("doc_id").alias("first_id"))
        labelled = _labelled(ids, labels, "code", "label")
        smallest = labelled.groupBy("label").agg(F.min("first_id").alias("smallest_id"))
        named = put(labelled.join(smallest, "label").select("code", "smallest_id"))
        gone = store(marked.select("rid", "doc_id", "code").join(named, "code").where("doc_id <> smallest_id").select(F.col("rid").alias("_gone")).distinct())
    left = docs.withColumn("_rid", rid).join(gone, F.col("_rid") == F.col("_gone"), "left_anti")
    return left.dropDuplicates(["_rid"]).drop("_rid")
