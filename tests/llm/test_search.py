"""Benchmark search, shared passages, language and toxicity."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import documents, prose, texts

from terrapath.llm import chaining, decontaminate, language, queries, toxicity


def edits(item, text):
    """Least edits between the item and any stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(item):
        step = row[:-1] + (np.frombuffer(text, np.uint8) != c)
        best = np.concatenate([[i + 1], np.minimum(step, row[1:] + 1)])
        row = np.minimum.accumulate(best - np.arange(len(best))) + np.arange(len(best))
    return int(row.min())


def changed(rng, text, n):
    out = list(text)
    for _ in range(n):
        p = rng.randrange(len(out))
        out[p : p + 1] = rng.choice([["q"], [], [out[p], "z"]])
    return "".join(out)


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(8, 60))) for i in range(12)]
    items += [(20, items[0][1]), (21, None), (22, ""), (23, "tiny qz"), (None, prose(rng, 30))]
    rows = texts()
    for n in range(40):
        item = items[n % 12][1]
        rows.append((100 + n, f"{prose(rng, 50)} {changed(rng, item, n % 9)} {prose(rng, 40)}".upper() if n % 3 else changed(rng, item, 2)))
    rows.append((200, "before TINY\tQZ after"))
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, edits string")
    got = decontaminate.find_items(documents(spark, rows), bench, decontaminate.Settings(block_bytes=400)).collect()
    folded = {t: decontaminate.fold(t) for _, t in items if t}
    want = {}
    for d, t in rows:
        for item, body in folded.items():
            limit = decontaminate.edit_budget(len(body), 0.06)
            least = edits(body, decontaminate.fold(t or "")) if len(t or "") < 5000 else limit + 1
            if least <= limit:
                want[d, item] = least
    ids = defaultdict(list)
    for i, t in items:
        ids[t] += [i] if i is not None else []
    found = {(r.doc_id, r.item_id, tuple(r.item_ids)): r for r in got}
    assert {k: r.edits for k, r in found.items()} == {(d, min(ids[t], default=None), tuple(sorted(ids[t]))): n for (d, t), n in want.items()}
    text = dict(rows)
    for (d, i, _), r in found.items():
        body = folded[next(t for t, v in ids.items() if t and min(v, default=None) == i)]
        assert edits(body, decontaminate.fold(text[d])[r.begin : r.end]) == r.edits
    assert len(want) > 30


def test_decontamination_empty(spark):
    docs, bench = documents(spark, texts()), spark.createDataFrame([(1, "some item text of a benchmark")], "item_id bigint, text string")
    assert decontaminate.find_items(docs.limit(0), bench).count() == 0
    assert decontaminate.find_items(docs, bench.limit(0)).count() == 0


def test_chains_match_exhaustive_search():
    rng = random.Random(2)
    s = chaining.Settings()
    for _ in range(200):
        rows = [(a, a + n, b, b + n) for a, b, n in ((rng.randint(0, 60), rng.randint(0, 60), rng.randint(5, 12)) for _ in range(rng.randint(1, 7)))]
        best = {}
        for i in sorted(range(len(rows)), key=lambda x: rows[x][0]):
            options = [
                best[j] - s.gap_cost * (rows[i][0] - rows[j][1] + rows[i][2] - rows[j][3])
                for j in best
                if rows[j][1] <= rows[i][0] and rows[j][3] <= rows[i][2]
            ]
            best[i] = rows[i][1] - rows[i][0] + max([0.0, *options])
        chain = chaining.chains(rows, chaining.Settings(gap=1000))
        assert sorted(x for c in chain for x in c) == list(range(len(rows)))
        first = [rows[i] for i in chain[0]]
        score = sum(r[1] - r[0] for r in first) - s.gap_cost * sum(y[0] - x[1] + y[2] - x[3] for x, y in zip(first, first[1:]))
        assert score == pytest.approx(max(best.values()))


def test_common_words():
    rng = random.Random(6)
    for _ in range(100):
        a, b = (bytes(rng.choices(range(4), k=rng.randint(0, 20))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert chaining.common_words(a, b) == row[-1]


def test_shared_passages(spark):
    rng = random.Random(8)
    rows = texts()
    fuzzy = prose(rng, 80).split()
    other = [w if i % 16 else "changed" for i, w in enumerate(fuzzy)]
    rows += [(300, f"{prose(rng, 60)} {' '.join(fuzzy)} {prose(rng, 20)}"), (301, f"{' '.join(other)} {prose(rng, 70)}"), (302, prose(rng, 400))]
    got = chaining.shared_passages(documents(spark, rows)).collect()
    words = defaultdict(list)
    for i, t in rows:
        words[i].append((t or "").lower().split())
    partners = defaultdict(set)
    for r in got:
        partners[r.doc_id].add(r.other_id)
        assert r.end - r.begin >= 50 and r.similarity >= 0.8
    assert partners[300] == {301} and partners[301] == {300} and 302 not in partners
    assert all(partners[40 + i] & {40, 41, 42, 43} for i in range(4))
    assert all(20 + i in partners[i] or i in partners[20 + i] for i in range(3))
    assert not set(partners) & {50, 51, 52, 53, 56, 57}
    assert chaining.shared_passages(documents(spark, rows).limit(0)).count() == 0


def test_seeds_are_dense_enough():
    rng = np.random.default_rng(1)
    s = chaining.Settings()
    hashes = rng.integers(0, 1 << 62, 5000, dtype=np.uint64)
    text, place, seed = chaining.sample_seeds(hashes, np.array([3000, 0, 4, 7, 1989]), s)
    for t, (low, n) in enumerate(((0, 3000), (3000, 0), (3000, 4), (3004, 7), (3011, 1989))):
        mine = place[text == t]
        assert (mine + s.seed <= n).all() and (len(mine) > 0) == (n >= s.seed)
        assert np.diff(mine).max(initial=0) <= s.window
        again = chaining.sample_seeds(hashes[low : low + n], np.array([n]), s)
        assert (again[1] == mine).all() and (again[2] == seed[text == t]).all()


PIECES = ["the", "▁the", "▁t", "he", "t", "h", "e", "▁", "th", "▁la", "la", "l", "a"]


def test_forward_sums_all_segmentations():
    lattice = language.Lattice(PIECES)
    rng = np.random.default_rng(0)
    chance = rng.random((len(PIECES) + 1, 3))
    chance[-1] = 1e-3

    def total(text, n):
        if not text:
            return 1.0
        out = chance[-1, n] * total(text[1:], n)
        for i, p in enumerate(PIECES):
            if text.startswith(p):
                out += chance[i, n] * total(text[len(p) :], n)
        return out

    words = ["the", "la", "x", "thela", "hethe", "e"]
    got = language.log_likelihoods(lattice, chance, words)
    want = [[np.log(total("▁" + w, n)) for n in range(3)] for w in words]
    assert np.allclose(got, want)
    long = "thela" * 40
    assert np.isfinite(language.log_likelihoods(lattice, chance, [long])).all()


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.collect()}
    out = queries.op1_language(spark, sf).collect()
    held = [r for r in out if r.held_out]
    assert Counter(r.doc_id for r in out) == Counter(known.keys())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    assert sum(known[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95


def test_language_odd_texts(spark):
    model = language.train([("the cat and the dog", "en"), ("le chat et la souris", "fr")])
    out = language.identify(documents(spark, texts()), model).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(texts())
    for r in out:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has_letter) and (has_letter or r.score == 0)
    assert language.identify(documents(spark, texts()).limit(0), model).count() == 0
    assert {r.lang_pred for r in language.identify(documents(spark, texts()), language.train([])).collect()} == {"und"}


def test_toxicity(spark):
    """The rows of sf0.01: few enough to train in seconds, enough to hold some out."""
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = queries.op4_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id in label]
    assert sum(label[r.doc_id] == r.predicted for r in held) / len(held) > 0.9


def test_toxicity_odd_texts(spark):
    rng = random.Random(3)
    rows = [(prose(rng, 60) + (" horrid" if n % 3 == 0 else "") + prose(rng, 20), int(n % 3 == 0)) for n in range(90)]
    model = toxicity.train(rows)
    docs = documents(spark, texts())
    out = toxicity.score(docs, model).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(texts())
    empty = {r.score for r in out if not (r.text or "").strip()}
    assert len(empty) == 1 and min(r.score for r in out) == empty.pop()
    assert toxicity.score(docs.limit(0), model).count() == 0
    for few in ([], [("a", 1)], [("a", 0), ("b", 0)], [("", 1), (" ", 0)]):
        assert all(0 <= r.score <= 1 for r in toxicity.score(docs, toxicity.train(few)).collect())


def test_gradients():
    """Backward pass against differences of the loss."""
    rng = np.random.default_rng(5)
    h, steps, n, words = 3, 5, 4, 6
    model = {
        "uf": rng.standard_normal((h, 3 * h)), "ub": rng.standard_normal((h, 3 * h)), "att": rng.standard_normal(2 * h),
        "out": rng.standard_normal(2 * h), "bias": np.zeros(1),
    }
    gates = rng.standard_normal((words, 6 * h))
    ids = rng.integers(0, words, (n, steps))
    mask = (np.arange(steps) < np.array([5, 3, 1, 4])[:, None]).astype(float)
    pull = rng.standard_normal(n)
    trace = {}
    toxicity.forward(model, gates, ids, mask, trace)
    grad = toxicity.backward(model, ids, mask, trace, pull, words)
    for name, array in [*model.items(), ("gates", gates)]:
        for at in [tuple(rng.integers(0, d) for d in array.shape) for _ in range(6)]:
            keep, diff = array[at], []
            for e in (1e-3, -1e-3):
                array[at] = keep + e
                diff.append((toxicity.forward(model, gates, ids, mask).astype(float) * pull).sum())
            array[at] = keep
            assert grad[name][at] == pytest.approx((diff[0] - diff[1]) / 2e-3, rel=0.05, abs=0.02)


def test_windows_cover_every_word():
    doc, at = toxicity.windows(np.array([0, 1, 32, 33, 48, 49, 200]), 32, 16)
    for d, n in enumerate([0, 1, 32, 33, 48, 49, 200]):
        starts = at[doc == d]
        assert {w for s in starts for w in range(s, min(n, s + 32))} == set(range(n))
        assert (np.diff(starts) <= 16).all() and (len(starts) == 0) == (n == 0)
