"""Small document tables with every awkward case, and brute-force helpers."""

import random

SYLLABLES = "the of and in to er tion an re on at en st ing ou ha nd".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def prose(rng, n):
    return " ".join(word(rng) + ("\n" if rng.random() < 0.08 else "") for _ in range(n))


def texts(seed=1):
    """(doc_id, text): copies, near copies, shared passages, repeated rows, nulls, empty and very long texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(60, 300)) for _ in range(12)]
    passage = prose(rng, 90)
    rows = list(enumerate(base))
    rows += [(20 + i, base[i]) for i in range(3)]
    rows += [(30 + i, base[i + 3].replace("tion", "sion", 1)) for i in range(3)]
    rows += [(40 + i, f"{prose(rng, 40)} {passage} {prose(rng, 30)}") for i in range(4)]
    rows += [(50, None), (51, ""), (52, "   \n\t "), (53, "12345 ---"), (54, "a" * 3000), (55, "Élan ñandú 東京 " * 30), (56, "one two")]
    rows += [(57, prose(rng, 20_000)), (0, base[0]), (0, base[0]), (None, base[1]), (None, None), (None, prose(rng, 80))]
    return rows


def documents(spark, rows, clash=True):
    """The rows with the other columns of ``documents`` and columns named like those the operators add."""
    clashing = "score predicted lang_pred size shard slot law rid code label item copies weight share place fingerprint component_id".split()
    data = [(i, t, None if n % 5 == 4 else ("en", "fr")[n % 2], None if n % 7 == 6 else f"s{n % 3}", None if t is None else len(t)) for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if clash:
        for c in clashing:
            df = df.selectExpr("*", f"'x' AS {c}")
    return df.repartition(3)


def roots(n, links):
    """Component representative (smallest number) of 0..n-1."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
