"""SimHash links, document fingerprints and suffix removal against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from fixtures import documents, roots, texts

from terrapath.llm import components, simhash, sketch, suffix


def plain_simhash(text):
    words, word = [], b""
    for c in (text or "").encode() + b" ":
        if c in (0x20, 9, 10, 11, 12, 13):
            if word:
                words.append(word)
            word = b""
        else:
            word += bytes([c + 32 if 65 <= c <= 90 else c])
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for _, t in texts():
        assert simhash.fingerprint(t) == plain_simhash(t)


@pytest.mark.parametrize("n, centres", [(300, 20), (3000, 3), (2000, 2000)])
def test_gray_index(n, centres):
    rng = np.random.default_rng(n)
    codes = rng.integers(0, 1 << 63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(6):
        codes ^= np.where(rng.random(n) < 0.7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    codes, bucket = np.unique(codes), None
    bucket = rng.integers(0, 2, len(codes))
    links = [(i, int(j)) for i in range(len(codes)) for j in np.flatnonzero((np.bitwise_count(codes ^ codes[i]) <= 4) & (bucket == bucket[i]))]
    got = simhash.GrayIndex(bucket, codes).forest(4)
    assert len(set(zip(roots(len(codes), links), got.tolist(), strict=True))) == len(set(got.tolist())) == len(set(roots(len(codes), links)))


def test_masks_leave_no_near_pair_apart():
    for radius in (0, 1, 4):
        rng = np.random.default_rng(radius)
        for _ in range(200):
            flip = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(flip & m == 0 for m in simhash.masks(radius))


def test_near_duplicates(spark):
    rows = texts()
    codes = [plain_simhash(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 4]
    root = roots(len(rows), links)
    smallest = defaultdict(list)
    for (i, _), r in zip(rows, root, strict=True):
        smallest[r] += [i] if i is not None else []
    want = Counter((i, f"{c:016x}", min(smallest[r], default=None)) for (i, _), c, r in zip(rows, codes, root, strict=True))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, rows)).collect())
    assert got == want
    kept = [r.doc_id for r in simhash.one_of_each(documents(spark, rows)).collect()]
    assert sorted(i for i in kept if i is not None) == sorted({min(v) for v in smallest.values() if v})
    assert simhash.near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(30)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 50 for i in [*range(50, 80), 100]}, 200: 200, 201: 200}


def alike(a, b):
    x, y = (Counter(t.split("\n")) if t else Counter() for t in (a, b))
    return 1.0 if not x and not y else sum((x & y).values()) / sum((x | y).values())


def test_fingerprints_of_versions(spark):
    rows = [(i, t or "") for i, t in texts() if i is not None]
    rows = list(dict(rows).items()) + [(None, "alone\nline")]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r.doc_id: r for r in sketch.fingerprint_edits(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    names = defaultdict(set)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(t, edited)) and r.near_next == pytest.approx(alike(t, following))
        names[t].add(r.fingerprint)
        names[edited].add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in names.values())
    assert len({min(v) for v in names.values()}) == len(names)


def test_versions_of_odd_tables(spark):
    one = documents(spark, [(3, "a\nb\nc")])
    (r,) = sketch.fingerprint_edits(one).collect()
    assert r.edited_sha256 == hashlib.sha256(b"a\nba\n").hexdigest()
    assert sketch.fingerprint_edits(one.limit(0)).count() == 0
    ties = sketch.fingerprint_edits(documents(spark, texts())).collect()
    assert len(ties) == len(texts())


def covered(bodies, length):
    starts = defaultdict(list)
    for n, t in enumerate(bodies):
        for p in range(len(t) - length + 1):
            starts[t[p : p + length]].append((n, p))
    out = [bytearray(len(t)) for t in bodies]
    for places in starts.values():
        if len(places) > 1:
            for n, p in places:
                out[n][p : p + length] = b"\1" * length
    return out


@pytest.mark.parametrize("crowd", [20_000, 1])
@pytest.mark.parametrize("length", [200, 48])
def test_remove_repeats(spark, length, crowd, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE", 10_000)  # long texts are cut
    rows = texts(3)
    bodies = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), body, marks in zip(rows, bodies, covered(bodies, length), strict=True):
        kept = bytes(b for b, m in zip(body, marks, strict=True) if not m)
        spans = len([x for x in bytes(marks).split(b"\0") if x])
        want[i, len(body), len(body) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix.remove_repeats(documents(spark, rows), length, crowd=crowd).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_remove_repeats_empty(spark):
    assert suffix.remove_repeats(documents(spark, texts()).limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix.repeated_ranges(documents(spark, texts()), 20)
