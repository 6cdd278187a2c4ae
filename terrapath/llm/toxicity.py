"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapath.llm.common import hash60, replace_columns, text_batches
from terrapath.llm.words import WORD, WordRows, join_words, ngram_hashes

NGRAMS = (3, 4, 5)
#: Words whose n-gram vectors are gathered at once; bounds memory only.
CHUNK = 20_000


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled rows that training looks at, at most and as an expected number, of label 1; twice as many of label 0."""

    sample: int = 1000
    window: int = 32
    stride: int = 16
    hidden: int = 8
    embed: int = 16
    buckets: int = 1 << 16
    epochs: int = 10
    batch: int = 256
    rate: float = 0.01
    seed: int = 11


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, and (bucket, word number) of its character n-grams, in word order."""
    parts = [_some_features(words[i : i + CHUNK], buckets) for i in range(0, len(words), CHUNK)]
    if not parts:
        return (np.zeros(0, np.int32),) * 3
    own, grams, owners = zip(*parts, strict=True)
    return np.concatenate(own), np.concatenate(grams), np.concatenate([o + np.int32(i * CHUNK) for i, o in enumerate(owners)])


def _some_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points, starts = join_words(words)
    grams = [ngram_hashes(points, starts, n) for n in NGRAMS]
    hashes, owners = np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams])
    order = np.argsort(owners, kind="stable")
    h = points * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * (np.arange(len(points), dtype=np.uint64) - np.repeat(starts[:-1], np.diff(starts)).astype(np.uint64) + np.uint64(3))
    whole = np.add.reduceat(h, starts[:-1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    return (whole >> shift).astype(np.int32), (hashes[order] >> shift).astype(np.int32), owners[order].astype(np.int32)


def embed(model: dict, words: list[str]) -> np.ndarray:
    """Input vectors: the word's own vector plus the scaled sum of its character n-grams' vectors."""
    if len(words) > CHUNK:
        return np.concatenate([embed(model, words[i : i + CHUNK]) for i in range(0, len(words), CHUNK)])
    own, grams, owners = word_features(words, len(model["word"]))
    x = model["word"][own]
    count = np.bincount(owners, minlength=len(words))
    has = count > 0
    if len(grams):
        at = np.concatenate([[0], np.cumsum(count)])[:-1][has]
        x[has] += np.add.reduceat(model["char"][grams], at, axis=0) / np.sqrt(count[has])[:, None].astype(np.float32)
    return x


def gate_inputs(model: dict, x: np.ndarray) -> np.ndarray:
    return x @ model["wx"] + model["bx"]


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * a)


def _run(gates: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, u: np.ndarray, backwards: bool, trace: list | None = None) -> np.ndarray:
    """Hidden states, (time, window, unit), of one direction."""
    steps, hidden = ids.shape[1], u.shape[0]
    h = np.zeros((len(ids), hidden), np.float32)
    out = np.empty((steps, len(ids), hidden), np.float32)
    for t in range(steps - 1, -1, -1) if backwards else range(steps):
        x, g = gates[ids[:, t]], h @ u
        zr = _sigmoid(x[:, : 2 * hidden] + g[:, : 2 * hidden])
        z, r, gc = zr[:, :hidden], zr[:, hidden:], g[:, 2 * hidden :]
        c = np.tanh(x[:, 2 * hidden :] + r * gc)
        step = z * (c - h)
        if mask is not None:
            step *= mask[:, t, None]
        if trace is not None:
            trace.append((t, h, z, r, gc, c))
        h = h + step
        out[t] = h
    return out


def forward(model: dict, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, trace: dict | None = None) -> np.ndarray:
    """Logit of every window; ``gates`` are rows of both directions' gate inputs, ``ids`` their numbers."""
    k = 3 * model["uf"].shape[0]
    traces = ([], []) if trace is not None else (None, None)
    h = np.concatenate(
        [_run(gates[:, :k], ids, mask, model["uf"], False, traces[0]), _run(gates[:, k:], ids, mask, model["ub"], True, traces[1])], axis=2
    )
    s = h @ model["att"]
    if mask is not None:
        s = np.where(mask.T > 0, s, np.float32(-30))
    a = np.exp(s - s.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", a, h)
    if trace is not None:
        trace.update(h=h, a=a, pooled=pooled, runs=traces)
    return pooled @ model["out"] + model["bias"][0]


def backward(model: dict, ids: np.ndarray, mask: np.ndarray, trace: dict, d_logit: np.ndarray, rows: int) -> dict:
    """Gradients of all dense weights, and of the gate inputs (``gates``)."""
    h, a = trace["h"], trace["a"]
    hidden = model["uf"].shape[0]
    grad = {"out": trace["pooled"].T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
    towards = h @ model["out"] * d_logit
    d_s = a * (towards - (a * towards).sum(axis=0))
    grad["att"] = np.einsum("tb,tbh->h", d_s, h)
    d_h = (a * d_logit)[:, :, None] * model["out"] + d_s[:, :, None] * model["att"]
    d_gates = np.zeros((rows, 6 * hidden), np.float32)
    for name, run, cols, where in (("uf", trace["runs"][0], slice(0, hidden), 0), ("ub", trace["runs"][1], slice(hidden, 2 * hidden), 3 * hidden)):
        u, d_u, carry = model[name], np.zeros_like(model[name]), np.zeros((len(ids), hidden), np.float32)
        for t, before, z, r, gc, c in reversed(run):
            d = carry + d_h[t][:, cols]
            d_step = d * mask[:, t, None]
            d_c = d_step * z * (1 - c * c)
            d_z = d_step * (c - before) * z * (1 - z)
            d_r = d_c * gc * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_c * r], axis=1)
            d_u += before.T @ d_g
            carry = d - d_step * z + d_g @ u.T
            np.add.at(d_gates[:, where : where + 3 * hidden], ids[:, t], np.concatenate([d_z, d_r, d_c], axis=1))
        grad[name] = d_u
    grad["gates"] = d_gates
    return grad


def windows(counts: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and first word of all overlapping windows; the last one ends with the text.

    A text without words has none.
    """
    per = np.where(counts > 0, np.maximum(0, -(-(counts - size) // stride)) + 1, 0)
    doc = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    return doc, np.minimum(nth * stride, np.maximum(counts[doc] - size, 0))


def window_ids(flat: np.ndarray, begin: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word rows of windows that begin at ``begin`` of ``flat`` and have ``left`` words; mask of real words."""
    steps = np.arange(size)
    mask = steps < left[:, None]
    return flat[np.where(mask, begin[:, None] + steps, 0)], mask.astype(np.float32)


def _flat(words_of: list[list[str]], table: WordRows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, words_of), np.int64, len(words_of))
    flat = table.ids([w for ws in words_of for w in ws])
    return flat, counts, np.cumsum(counts) - counts


def train(rows: list[tuple[str, int]], settings: Settings = Settings()) -> dict:
    """Fit the network on (text, label) rows, in one process; the rows are a bounded sample.

    A text's logit is that of its strongest window, so only that window of each text is
    learned from (multiple instances).  Embeddings start with the log-odds of their feature.
    """
    s, rng = settings, np.random.default_rng(settings.seed)
    vocabulary: dict[str, int] = {}
    label = np.array([y for _, y in rows], np.float32)
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(text.lower())], np.int32) for text, _ in rows]
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat, first = np.concatenate([np.zeros(0, np.int32), *ids]), np.cumsum(counts) - counts
    names = list(vocabulary)
    own, grams, owners = word_features(names, s.buckets)
    reach = np.searchsorted(owners, np.arange(len(names) + 1))
    share = np.sqrt(np.bincount(owners, minlength=len(names))).astype(np.float32)

    model = {k: (rng.standard_normal((s.buckets, s.embed)) * 0.05).astype(np.float32) for k in ("word", "char")}
    for key, feature, word in (("word", own, np.arange(len(names))), ("char", grams, owners)):
        model[key][:, 0] = 0.3 * _log_odds(flat, counts, label, feature, word, s.buckets)
    h = s.hidden
    model |= {
        "wx": (rng.standard_normal((s.embed, 6 * h)) / np.sqrt(s.embed)).astype(np.float32), "bx": np.zeros(6 * h, np.float32),
        "uf": (rng.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32), "ub": (rng.standard_normal((h, 3 * h)) / np.sqrt(h)).astype(np.float32),
        "att": (rng.standard_normal(2 * h) * 0.3).astype(np.float32), "out": (rng.standard_normal(2 * h) * 0.3).astype(np.float32),
        "bias": np.zeros(1, np.float32), "slope": np.array([1.0, 0.0], np.float32),
    }
    if not names or len(set(label)) < 2:
        model["slope"] = np.array([0.0, 4.0 if len(label) and label.min() == 1 else -4.0], np.float32)
        return model

    doc, at = windows(counts, s.window, s.stride)
    begin, left = first[doc] + at, np.minimum(counts[doc] - at, s.window)
    dense = ["wx", "bx", "uf", "ub", "att", "out", "bias"]
    moments = {k: [np.zeros_like(model[k]), np.zeros_like(model[k])] for k in dense}
    squares = {k: np.full(s.buckets, 1e-3, np.float32) for k in ("word", "char")}
    steps = 0
    for epoch in range(s.epochs):
        gates = gate_inputs(model, _embed_known(model, own, grams, owners, share))
        logit = _all_logits(model, gates, flat, begin, left, s)
        best = _strongest(doc, logit)
        extra = rng.integers(0, len(doc), len(best) // 2)
        picked = np.concatenate([best, extra[label[doc[extra]] == 0]])
        rng.shuffle(picked)
        for i in range(0, len(picked), s.batch):
            part = picked[i : i + s.batch]
            ids, mask = window_ids(flat, begin[part], left[part], s.window)
            known, ids = np.unique(ids, return_inverse=True)
            ids = ids.reshape(len(part), s.window)
            many = reach[known + 1] - reach[known]
            chosen = np.repeat(reach[known] - np.cumsum(many) + many, many) + np.arange(many.sum())
            renamed = np.repeat(np.arange(len(known)), many)
            x = _embed_known(model, own[known], grams[chosen], renamed, share[known])
            trace: dict = {}
            z = forward(model, gate_inputs(model, x), ids, mask, trace)
            d = ((_sigmoid(z) - label[doc[part]]) / len(part)).astype(np.float32)
            grad = backward(model, ids, mask, trace, d, len(known))
            d_gates = grad.pop("gates")
            grad |= {"wx": x.T @ d_gates, "bx": d_gates.sum(axis=0)}
            d_x = d_gates @ model["wx"].T
            steps += 1
            for k in dense:
                m, v = moments[k]
                m += 0.1 * (grad[k] - m)
                v += 0.001 * (grad[k] ** 2 - v)
                model[k] -= s.rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
            for k, feature, change in (("word", own[known], d_x), ("char", grams[chosen], d_x[renamed] / share[known][renamed][:, None])):
                rows_used, place = np.unique(feature, return_inverse=True)
                total = np.zeros((len(rows_used), s.embed), np.float32)
                np.add.at(total, place, change)
                squares[k][rows_used] += (total**2).mean(axis=1)
                model[k][rows_used] -= 0.05 * total / np.sqrt(squares[k][rows_used])[:, None]
    gates = gate_inputs(model, _embed_known(model, own, grams, owners, share))
    logit = _all_logits(model, gates, flat, begin, left, s)
    top = np.full(len(rows), -20.0)
    top[doc[_strongest(doc, logit)]] = logit[_strongest(doc, logit)]
    model["slope"] = _calibrate(top, label)
    return model


def _embed_known(model: dict, own: np.ndarray, grams: np.ndarray, owners: np.ndarray, share: np.ndarray) -> np.ndarray:
    x = model["word"][own]
    for low in range(0, len(own), CHUNK):
        part = slice(*np.searchsorted(owners, [low, low + CHUNK]))
        at = np.flatnonzero(np.diff(owners[part], prepend=-1))
        if len(at):
            named = owners[part][at]
            x[named] += np.add.reduceat(model["char"][grams[part]], at, axis=0) / share[named][:, None]
    return x


def _log_odds(flat: np.ndarray, counts: np.ndarray, label: np.ndarray, feature: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    """Log-odds of a text's label given that the feature occurs in the text."""
    first = np.cumsum(counts) - counts
    per = np.bincount(word, minlength=int(flat.max(initial=-1)) + 1)
    start = np.cumsum(per) - per
    bad, good = np.zeros(buckets), np.zeros(buckets)
    for n, begin, y in zip(counts, first, label, strict=True):
        used = np.unique(flat[begin : begin + n])
        many = per[used]
        spread = np.repeat(start[used] - np.cumsum(many) + many, many) + np.arange(many.sum())
        (bad if y else good)[np.unique(feature[spread])] += 1
    odds = np.log((bad + 0.5) / (label.sum() + 1)) - np.log((good + 0.5) / ((1 - label).sum() + 1))
    return np.where(bad + good > 0, odds, 0).astype(np.float32)


def _all_logits(model: dict, gates: np.ndarray, flat: np.ndarray, begin: np.ndarray, left: np.ndarray, s: Settings, chunk: int = 4096) -> np.ndarray:
    out = [np.zeros(0, np.float32)]
    for i in range(0, len(begin), chunk):
        ids, mask = window_ids(flat, begin[i : i + chunk], left[i : i + chunk], s.window)
        out.append(forward(model, gates, ids, None if mask.all() else mask))
    return np.concatenate(out)


def _strongest(doc: np.ndarray, logit: np.ndarray) -> np.ndarray:
    """Number of the strongest window of each document (documents in order)."""
    order = np.lexsort((-logit, doc))
    return order[np.flatnonzero(np.diff(doc[order], prepend=-1))]


def _calibrate(top: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Slope and shift of a logistic curve over the strongest logits, by Newton steps."""
    x = np.stack([np.clip(top, -20, 20), np.ones(len(top))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w -= np.linalg.solve(curve, x.T @ (p - label) + 1e-2 * (w - [1, 0]))
    return np.array([max(w[0], 1e-3), w[1]], np.float32)


def score_texts(model: dict, texts: list[str | None], settings: Settings, table: WordRows) -> np.ndarray:
    """Probability of every text, from its strongest window."""
    table.begin()
    words_of = [WORD.findall(t.lower()) if t else [] for t in texts]
    flat, counts, first = _flat(words_of, table)
    doc, at = windows(counts, settings.window, settings.stride)
    top = np.full(len(texts), -20.0, np.float32)
    if len(doc):
        logit = _all_logits(model, table.rows, flat, first[doc] + at, np.minimum(counts[doc] - at, settings.window), settings)
        np.maximum.at(top, doc, logit)
    slope, shift = model["slope"]
    return 1 / (1 + np.exp(-np.clip(slope * np.clip(top, -20, 20) + shift, -30, 30).astype(np.float64)))


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings, key: str, text: str, label: str) -> DataFrame:
    known = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("_label"))
    sizes = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    chance = F.lit(0.0)
    for value, n in sorted(sizes.items()):
        chance = F.when(F.col("_label") == value, F.lit(min(1.0, (2 - value) * settings.sample / n))).otherwise(chance)
    taken = known.where(hash60(F.lit(settings.seed), F.col(key)) < chance * F.lit(float(1 << 60)))
    found = docs.where(F.col(text).isNotNull()).select(key, text).join(F.broadcast(taken), key)
    return found.select(F.col(text).alias("text"), F.col("_label").cast("int").alias("label"))


def sample_labelled(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[str, int]]:
    """Texts and labels to learn from: a hash of the key picks ``sample`` rows of label 1 and twice as many of label 0.

    Labels are picked before they meet the texts, so the join moves no text.  Of several labels of
    one key the largest counts; labels other than 0 and 1, and null texts, are left out.
    """
    return sorted((r[0], r[1]) for r in _sample(docs, labels, settings, key, text, label).collect())


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """The network of ``train`` on the rows of ``sample_labelled``, trained in a task: the driver sees the finished weights only."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows = [r for b in batches for r in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(sorted(rows), settings))], pa.binary())], names=["model"])

    made = _sample(docs, labels, settings, key, text, label).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0][0]) if made else train([], settings)


def score(docs: DataFrame, model: dict, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row.

    Every whole text is cut into all windows of ``window`` words, ``stride`` apart; the network reads
    word and character n-gram vectors forwards and backwards, pools by attention, and the
    strongest window is the text's score.  Null, empty and wordless texts get the score of the weakest window;
    equal texts get equal scores.  Columns named like an output column are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[c for c in docs.columns if c.lower() not in ("score", "predicted")])
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        table = WordRows(lambda new: gate_inputs(m, embed(m, new)))
        for piece in text_batches(batches, text):
            values = score_texts(m, piece.column(text).to_pylist(), settings, table)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(values)], names=[*piece.schema.names, "score"])

    scored = kept.mapInArrow(run, schema)
    return replace_columns(scored, score=F.col("score"), predicted=(F.col("score") >= 0.5).cast("int"))
