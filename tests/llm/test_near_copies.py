"""Near copies against all pairs."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
from fixtures import documents, prose, roots, texts

from terrapath.llm import near_copies, simhash


def shingles(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def smallest_ids(rows):
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for n, own in enumerate(sets):
        for s in own or {None}:
            holders[s].append(n)
    shared = Counter(pair for held in holders.values() for pair in combinations(held, 2))
    links = [(a, b) for (a, b), common in shared.items() if not sets[a] or 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common)]
    groups = {}
    for (i, _), r in zip(rows, roots(len(rows), links), strict=True):
        groups.setdefault(r, []).extend([i] if i is not None else [])
    return sorted({min(g) for g in groups.values() if g})


def varied(rng, text, similarity):
    """A copy with words changed in the middle until its similarity is just at least ``similarity``."""
    words, before = text.split(), text
    own = shingles(text)
    for p in rng.sample(range(len(words)), len(words)):
        words[p] += "x"
        now = " ".join(words)
        if jaccard(own, shingles(now)) < similarity:
            return before
        before = now
    return before


def test_stage_drops_copies_of_similarity_08(spark):
    rng = random.Random(11)
    rows = texts()
    wide = 0
    for n in range(40):
        body = prose(rng, rng.randint(60, 300))
        copy = varied(rng, body, (0.8, 0.85, 0.9, 0.95)[n % 4])
        rows += [(1000 + 2 * n, body), (1001 + 2 * n, copy)]
        wide += (simhash.fingerprint(body) ^ simhash.fingerprint(copy)).bit_count() > 4
    assert wide > 20  # a rule of four bits keeps both
    common = prose(rng, 60)  # in many texts that are no copies, in small and in large bands
    rows += [(2000 + n, f"{common} {prose(rng, 30)}") for n in range(60)]
    body = prose(rng, 120)
    rows += [(3000 + n, varied(rng, body, 0.9)) for n in range(40)]
    docs = documents(spark, rows)
    stage = corpus_pipeline.drop_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in stage if r.doc_id is not None) == smallest_ids(rows)
    assert sorted(r.text or "" for r in stage if r.doc_id is None) == sorted({t or "" for i, t in rows if i is None})
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_working_tables_go_when_the_stage_is_done(spark):
    from pathlib import Path

    from terrapath.llm.common import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "i j k l m n")]
    docs = documents(spark, rows)
    left = near_copies.one_of_each(docs)
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]
    names = [p.name for p in set(folder.iterdir()) - before]
    assert [n.split("-")[0] for n in names if not n.startswith("rdd")] == ["table"]
