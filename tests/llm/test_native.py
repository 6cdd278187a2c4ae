"""Sharding, URL rules and mixing against plain Python."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import documents, texts
from pyspark.sql import functions as F

from terrapath.llm import mixing, queries, sharding, url_filter


def jump(key, shards):
    """The published jump hash on the first 64 bits of the key's MD5."""
    state = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16)
    b, j = -1, 0
    while j < shards:
        b = j
        state = (state * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((state >> 33) + 1)))
    return b


def test_shards(spark):
    rows = texts()
    out = sharding.assign_shards(documents(spark, rows), 5, blocks=4).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    slots = defaultdict(list)
    for r in out:
        body = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key")
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 5), jump(r.doc_id, 6))
        assert r.grown_shard in (r.shard, 5)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_and_few_rows_move(spark):
    shard, grown = sharding.jump_shards(F.col("id"), 24)
    rows = spark.range(20_000).select("id", shard.alias("a"), grown.alias("b")).collect()
    assert all((r.a, r.b) == (jump(r.id, 24), jump(r.id, 25)) for r in rows[:2000])
    assert 600 < sum(r.a != r.b for r in rows) < 1000
    assert max(Counter(r.a for r in rows).values()) < 1000


URLS = [
    "http://Example.COM/en/1?x#y", "https://www.example.com/en/", "http://m.www.example.com/en/a/b/", "http://a.net/es/1", "http://a.net/es",
    "http://net/fr/x", "ftp://notnet/fr/x", "http://example.com", "http://example.com?/en/", "no scheme", None, "", "http:///en/x", "x://y://z.com/a",
    "http://com/", "http://.com/", "http://a.com:80/", "http://a..com/b//c", "http://example.com/en", "http://EXAMPLE.com/EN/", "http://a.com/" + "p/" * 300,
]


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, a) for h, p, a in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[1] if best else None, best[2] if best else "allow")


@pytest.mark.parametrize("extra", [[], [("a.com", "/p/p", "block"), ("z.com", "", "block"), ("y:", "", "block")]])
def test_urls(spark, extra):
    rules = queries.URL_RULES + extra
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS + URLS[:3])] + [(None, None, "h")], "page_id bigint, url string, host string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, table).collect()]
    want = [(i, *judge(u, rules)) for i, u in enumerate(URLS + URLS[:3])] + [(None, *judge(None, rules))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_urls_empty(spark):
    rules = queries.url_rules(spark)
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()] == ["allow"]


def mixed(rows, target):
    """Copies of each row by the definition: exponent by plain bisection, budget over the permutation."""
    tokens = [len([w for w in __import__("re").split("[ \t\n\x0b\f\r]+", t or "") if w]) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, tokens, strict=True):
        total[s] += n
    share = {s: n / sum(total.values()) for s, n in total.items() if n}

    def state(e):
        power = {s: p**e for s, p in share.items()}
        z = sum(power.values())
        budget = target.budget or max(total[s] * z / power[s] for s in share)
        w = {s: p / z for s, p in power.items()}
        return w, {s: w[s] * budget / total[s] for s in w}, -sum(p * math.log(p) for p in w.values())

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        _, rep, entropy = state(mid)
        if target.entropy is not None:
            low, high = (mid, high) if entropy >= target.entropy else (low, mid)
        else:
            low, high = (low, mid) if max(rep.values()) <= target.repetition else (mid, high)
    weights, rep, _ = state(low if target.entropy is not None else high)
    place = [int(hashlib.md5(f"7\x1f{'' if i is None else i}".encode()).hexdigest()[:15], 16) for i, _, _ in rows]
    out = []
    for (_, _, s), at in zip(rows, place, strict=True):
        r = rep.get(s, 1.0)
        upto = sum(n for (_, _, x), n, p in zip(rows, tokens, place, strict=True) if x == s and p <= at)
        whole = math.floor(r + 1e-9)
        out.append(whole + (upto <= (r - whole) * total[s]))
    return out, weights


@pytest.mark.parametrize("target", [mixing.Target(repetition=2.0), mixing.Target(entropy=1.36, budget=30_000.0), mixing.Target(repetition=1.2, budget=9_000.0)])
def test_mixing(spark, target):
    docs = documents(spark, texts())
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want, weights = mixed(rows, target)
    got = mixing.mix(docs, target).collect()
    assert Counter((r.doc_id, r.text, r.source, r.copies) for r in got) == Counter((*r, n) for r, n in zip(rows, want, strict=True))
    for r in got:
        assert r.weight == pytest.approx(weights.get(r.source, 0.0), abs=1e-8)
    if target.budget is None:
        assert min(r.copies for r in got) == 1


def test_mixing_odd_tables(spark):
    docs = documents(spark, texts())
    target = mixing.Target(repetition=2.0)
    assert mixing.mix(docs.limit(0), target).count() == 0
    assert {r.copies for r in mixing.mix(docs.where("doc_id IN (50, 51)"), target).collect()} == {1}
    one = mixing.mix(docs.withColumn("source", F.lit(None).cast("string")), target).collect()
    assert {r.copies for r in one} == {1} and len(one) == docs.count()
