"""Which sources differ from the rest of their language: exact divergences over a quadtree of group-term counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapath.llm.common import store, text_batches

#: Shares are whole billionths.
SCALE = 1_000_000_000
#: Added to every count.
PRIOR = 2
#: A term is a run of ASCII letters and of characters outside ASCII, so any byte of such a run stays and A-Z is lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Different terms that a counting task holds before it sends them on; bounds memory only.
HELD = 400_000
#: Triples of tree nodes that are expanded side by side.
FRONTIER = 200_000


@dataclass(frozen=True)
class Settings:
    """``least_docs``: a language keeps the terms in so many of its documents; ``top``: terms reported for a group.
    ``tile_terms`` and ``block_groups``, columns of a matrix tile and rows of a block of groups, bound a task's matrix and change no result."""

    least_docs: int = 10
    top: int = 10
    tile_terms: int = 1024
    block_groups: int = 64


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of a term in a group and documents that hold it; combined inside tasks first.

    A row with a null term stands for the group itself, so a group without terms is there too.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def send(held: dict) -> Iterator:
            for (lang, source), (n, docs) in held.items():
                terms = list(n)
                size = len(terms) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
                        pa.array([None, *terms], pa.binary()).cast(pa.string()),
                        pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, terms)], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

        held: dict = {}
        for piece in text_batches(batches):
            for lang, source, text in zip(*[piece.column(c).to_pylist() for c in ("lang", "source", "text")], strict=True):
                words = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
                counts = held.setdefault((lang, source), (Counter(), Counter()))
                counts[0].update(words)
                counts[1].update(set(words))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from send(held)
                held = {}
        yield from send(held)

    partial = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms))`` by long division, three digits at a time, free of overflow."""
    whole = total + terms * F.lit(PRIOR)
    value, left = F.lit(1).cast("long"), n + F.lit(PRIOR)
    for weight in (1_000_000, 1_000, 1):
        left = left * F.lit(1000)
        value = value + _whole(left, whole) * F.lit(weight).cast("long")
        left = left % whole
    return value


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)**2 / (p + q))`` in whole numbers."""
    return F.when(p + q > 0, _whole((p - q) * (p - q), p + q))


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


class Quadtree:
    """K-squared tree (K = 2) of one block of rows and one tile of columns.

    A level holds four bits for every node above that is not all zero; the child behind a set
    bit has the number of set bits before it.  Node -1 stands for any all-zero quadrant, which
    takes no space.  The values of the leaves are kept in the order of their numbers.
    """

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, height: int):
        code = np.zeros(len(rows), np.int64)
        for i in range(height):
            code |= (((rows >> i) & 1) << (2 * i + 1)) | (((cols >> i) & 1) << (2 * i))
        order = np.argsort(code)
        nodes = code[order]
        self.values, self.height = values[order], height
        self.bits, self.rank = [], []  # level 1 holds the children that are single cells
        for _ in range(height):
            above = np.unique(nodes >> 2)
            bits = np.zeros(4 * len(above), bool)
            bits[4 * np.searchsorted(above, nodes >> 2) + (nodes & 3)] = True
            self.bits.append(bits)
            self.rank.append(np.cumsum(bits) - 1)
            nodes = above
        self.root = 0 if len(rows) else -1

    def child(self, level: int, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        """Numbers of the children of nodes ``level`` above the cells."""
        out = np.full(len(node), -1, np.int64)
        some = node >= 0
        at = 4 * node[some] + quadrant[some]
        out[some] = np.where(self.bits[level - 1][at], self.rank[level - 1][at], -1)
        return out

    def leaf(self, node: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Values of single cells, ``zero`` where there is none."""
        out = zero.copy()
        out[node >= 0] = self.values[node[node >= 0]]
        return out


def _whole_gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def joint_gaps(a: Quadtree, b: Quadtree, zero_a: np.ndarray, zero_b: np.ndarray, columns: int, same: bool) -> np.ndarray:
    """Sum of ``gap`` over ``columns`` columns for every pair of a row of ``a`` and a row of ``b``.

    Both trees are walked together, top down.  A quadrant that is all zero on both sides is not
    opened: each of its columns costs the gap of the two rows' shares of a zero, so only widths are
    added up per pair of row nodes.  What is left reaches single cells of which one at least is
    not zero.  ``zero_*`` are the rows' shares of a zero; with ``same`` the trees are one, and only
    pairs with the smaller row first are priced (the others are 0).
    """
    rows_a, rows_b, height = len(zero_a), len(zero_b), a.height
    total = np.zeros((rows_a, rows_b), np.int64)
    widths = [np.zeros((-(-rows_a // (1 << level)), -(-rows_b // (1 << level))), np.int64) for level in range(height + 1)]
    top = np.zeros(1, np.int64)
    todo = [(height, top, top, top, top + a.root, top + b.root)]
    while todo:
        level, ra, rb, col, na, nb = todo.pop()
        empty = (na < 0) & (nb < 0)
        if empty.any():
            wide = np.minimum(1 << level, columns - (col[empty] << level))
            np.add.at(widths[level], (ra[empty], rb[empty]), wide)
            ra, rb, col, na, nb = (x[~empty] for x in (ra, rb, col, na, nb))
        if not len(ra):
            continue
        if level == 0:
            np.add.at(total, (ra, rb), _whole_gap(a.leaf(na, zero_a[ra]), b.leaf(nb, zero_b[rb])))
            continue
        eight = np.tile(np.arange(8), len(ra))
        ra, rb, col, na, nb = (np.repeat(x, 8) for x in (ra, rb, col, na, nb))
        qa, qb, qc = eight >> 2, (eight >> 1) & 1, eight & 1
        ra, rb, col, below = 2 * ra + qa, 2 * rb + qb, 2 * col + qc, level - 1
        real = (ra << below < rows_a) & (rb << below < rows_b) & (col << below < columns)
        if same:
            real &= ra <= rb
        ra, rb, col, na, nb, qa, qb, qc = (x[real] for x in (ra, rb, col, na, nb, qa, qb, qc))
        na, nb = a.child(level, na, 2 * qa + qc), b.child(level, nb, 2 * qb + qc)
        for i in range(0, len(ra), FRONTIER):
            todo.append((below, *[x[i : i + FRONTIER] for x in (ra, rb, col, na, nb)]))
    zeros = np.zeros((1, 1), np.int64)
    for level in range(height, -1, -1):
        spread = np.repeat(np.repeat(zeros, 2, 0), 2, 1) if level < height else zeros
        zeros = widths[level] + spread[: widths[level].shape[0], : widths[level].shape[1]]
    total += zeros * _whole_gap(zero_a[:, None], zero_b[None, :])
    return np.triu(total, 1) if same else total


def _tile_pairs(lang: str, cells: pd.DataFrame, block_groups: int) -> pd.DataFrame:
    """Gaps of all pairs of groups of two blocks over one tile; rows without a term describe the groups."""
    about = cells[cells["term"].isna()]
    cells = cells[cells["term"].notna()]
    columns = int(about["columns"].iloc[0])
    # frequent terms first, as groups with many words come first: the zeros gather in one corner
    terms = cells.drop_duplicates("term").sort_values(["df", "term"], ascending=[False, True])["term"]
    place = pd.Series(np.arange(len(terms)), index=terms.to_numpy())
    low, high = int(about["low"].iloc[0]), int(about["high"].iloc[0])
    height = max(1, int(max(columns, block_groups) - 1).bit_length())

    def side(block: int) -> tuple[Quadtree, np.ndarray, np.ndarray]:
        groups = about[about["grp"] // block_groups == block].sort_values("grp")
        mine = cells[cells["grp"] // block_groups == block]
        at = place.loc[mine["term"]].to_numpy() if len(mine) else np.zeros(0, np.int64)
        rows = (mine["grp"].to_numpy() % block_groups).astype(np.int64)
        return Quadtree(rows, at, mine["p"].to_numpy().astype(np.int64), height), groups["p"].to_numpy().astype(np.int64), groups["grp"].to_numpy()

    left = side(low)
    right = left if low == high else side(high)
    sums = joint_gaps(left[0], right[0], left[1], right[1], columns, low == high)
    i, j = np.nonzero(sums)
    return pd.DataFrame({"lang": lang, "one": left[2][i], "two": right[2][j], "value": sums[i, j]})


def divergences(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """How far each (lang, source) group lies from the other sources of its language, and by which terms.

    Returns ``lang, source, part, item, value, rank``.  Part ``pair`` has a row for every other source of
    the language, valued by ``gap`` of the two groups' shares summed over all kept terms; part ``term`` has
    the first ``top`` terms that the group uses more than its language does.  A language keeps the terms in at
    least ``least_docs`` of its documents; ``share`` gives a term's share in a group.  All numbers are whole.

    The counts form a matrix of groups and terms.  It is cut into tiles of terms and pairs of blocks of
    groups, one Spark group each, whose cells go into quadtrees that are walked together; the sums of
    the tiles are added up.  A frequent word or a large source is thus spread over tiles, and word counts are
    combined in the counting tasks before they are shuffled.

    Null text, lang and source count as empty; repeated rows count each; a group without terms keeps its row (all
    shares alike); a language with one source has no pairs; an empty table gives an empty result; further
    columns are not used.
    """
    counted = store(_with_language_totals(count_terms(docs)).where(F.col("term").isNull() | (F.col("df") >= settings.least_docs)))
    cells = counted.where("term IS NOT NULL")
    named = counted.where("term IS NULL").select("lang", "source")
    langs = cells.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("first").alias("v"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_n", "v"])
    by_size = W.partitionBy("lang").orderBy(F.desc("total"), "source")
    groups = groups.withColumn("grp", F.row_number().over(by_size) - 1).withColumn("groups", F.count(F.lit(1)).over(W.partitionBy("lang")))
    groups = store(groups.withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v")))))
    shown = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    return _pairs(shown, groups, settings).unionByName(_terms(shown, settings.top))


def _with_language_totals(counts: DataFrame) -> DataFrame:
    """Documents and occurrences of the term in the whole language, and a mark on one of its rows."""
    same = W.partitionBy("lang", "term")
    first = F.row_number().over(same.orderBy("source")) == 1
    return counts.select(
        "lang", "source", "term", "n", F.when(F.col("term").isNotNull(), F.sum("docs").over(same)).alias("df"), F.sum("n").over(same).alias("lang_term"), first.alias("first")
    )


def _terms(shown: DataFrame, top: int) -> DataFrame:
    q = share(F.col("lang_term"), F.col("lang_n"), F.col("v"))
    more = shown.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def _pairs(shown: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    size = settings.block_groups
    tiles = F.ceil(F.col("v") / settings.tile_terms).cast("int")
    blocks = F.ceil(F.col("groups") / size).cast("int")
    shown = shown.where("groups > 1").withColumn("tile", F.pmod(F.xxhash64("term"), tiles).cast("int"))
    columns = shown.where("first").groupBy("lang", "tile").agg(F.count(F.lit(1)).alias("columns"))
    task = ["lang", "tile", "low", "high"]

    def dealt(rows: DataFrame, **cols: Column) -> DataFrame:
        """A group's rows go to every pair of blocks that its own block is in."""
        own = F.floor(F.col("grp") / size).cast("int")
        met = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        met = met.withColumn("low", F.least("_own", "_other")).withColumn("high", F.greatest("_own", "_other"))
        return met.select(*task, "grp", *[c.alias(n) for n, c in cols.items()])

    cells = dealt(shown, term=F.col("term"), df=F.col("df"), p=F.col("p"), columns=F.lit(0).cast("long"))
    about = dealt(
        groups.where("groups > 1").join(columns, "lang"),
        term=F.lit(None).cast("string"), df=F.lit(0).cast("long"), p=F.col("zero"), columns=F.col("columns"),
    )
    sums = cells.unionByName(about).groupBy(*task).applyInPandas(lambda key, rows: _tile_pairs(key[0], rows, size), "lang string, one int, two int, value long")
    sums = sums.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    mine = groups.select("lang", "source", F.col("grp").alias("mine"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("grp").alias("theirs"))
    # the result has a row for every two groups of a language
    pairs = mine.join(others, "lang").where("mine <> theirs")
    pairs = pairs.withColumn("one", F.least("mine", "theirs")).withColumn("two", F.greatest("mine", "theirs")).join(sums, ["lang", "one", "two"], "left")
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(ranked))
