"""Source divergences against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, texts

from terrapath.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, top=10):
    """(lang, source, part, item, value, rank) by the definition."""
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]
        groups[lang or "", source or ""].update(words)
        held[lang or ""].update(set(words))
    out = set()
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in held[lang].items() if n >= least]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        mine = {s: shares(c) for (x, s), c in groups.items() if x == lang}
        whole = shares(sum((c for (x, _), c in groups.items() if x == lang), Counter()))
        for s, p in mine.items():
            pairs = [(-sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in kept), o.encode(), o) for o, q in mine.items() if o != s]
            terms = [(-((p[t] - whole[t]) ** 2 // (p[t] + whole[t])), t.encode(), t) for t in kept if groups[lang, s][t] and p[t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)}
    return out


@pytest.mark.parametrize(("least", "tile", "block"), [(1, 1024, 64), (2, 16, 2), (5, 3, 1)])
def test_against_definition(spark, least, tile, block):
    docs = documents(spark, texts() + [(70, "Ünder_score x86 ÀB cD"), (71, "ONE one One")]).selectExpr("*", "1 AS term", "2 AS n", "3 AS grp")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    got = D.divergences(docs, D.Settings(least, 10, tile, block)).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == plain(rows, least)


def test_odd_tables(spark):
    docs = documents(spark, texts())
    assert D.divergences(docs.limit(0)).count() == 0
    one = docs.selectExpr("doc_id", "text", "'en' AS lang", "'a' AS source")
    assert {r.part for r in D.divergences(one, D.Settings(2)).collect()} <= {"term"}
    bare = spark.createDataFrame([(1, None, "en", "a"), (2, "12", "en", "b"), (3, "", None, None)], "doc_id int, text string, lang string, source string")
    assert {tuple(r) for r in D.divergences(bare).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_trees():
    """Joint walks against dense matrices, all-zero rows and columns included."""
    rng = random.Random(3)
    for rows_a, rows_b, columns, dense in [(1, 1, 1, 1.0), (5, 3, 40, 0.2), (8, 8, 17, 0.0), (7, 7, 64, 0.6), (2, 6, 33, 0.05)]:
        height = max(rows_a, rows_b, columns, 2).bit_length()
        matrix = [np.array([[rng.randrange(1, 10**9) if rng.random() < dense else 0 for _ in range(columns)] for _ in range(n)]) for n in (rows_a, rows_b)]
        zero = [np.array([rng.randrange(1, 99) for _ in range(n)]) for n in (rows_a, rows_b)]
        trees = [D.Quadtree(*np.nonzero(m), m[np.nonzero(m)], height) for m in matrix]
        full = [np.where(m > 0, m, z[:, None]) for m, z in zip(matrix, zero, strict=True)]
        want = [[sum((int(p) - int(q)) ** 2 // (int(p) + int(q)) for p, q in zip(x, y, strict=True)) for y in full[1]] for x in full[0]]
        assert D.joint_gaps(*trees, *zero, columns, False).tolist() == want
        same = D.joint_gaps(trees[0], trees[0], zero[0], zero[0], columns, True)
        for i in range(rows_a):
            for j in range(rows_a):
                assert same[i, j] == (sum((int(p) - int(q)) ** 2 // (int(p) + int(q)) for p, q in zip(full[0][i], full[0][j], strict=True)) if i < j else 0)


def test_share_of_great_counts(spark):
    cases = [(0, 0, 1), (10**14, 3 * 10**14, 10**6), (7, 7, 2**20), (123_456_789_012, 9 * 10**14, 3)]
    df = spark.createDataFrame(cases, "n bigint, total bigint, v bigint")
    got = [r.p for r in df.select(D.share(df.n, df.total, df.v).alias("p")).collect()]
    assert got == [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in cases]
