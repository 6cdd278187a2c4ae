"""Language by unigrams of vocabulary pieces, summed over all segmentations of every word."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapath.llm.common import hash60, replace_columns, text_batches
from terrapath.llm.words import WordRows

UNKNOWN = "und"
#: A run of letters is a word; `letter_runs` takes out the number signs that the pattern lets through.
LETTERS = re.compile(r"[^\W\d_]+")
#: Products over words of so many letters stay in range, all letters outside the vocabulary included; longer words are summed as logarithms.
SHORT = 30
#: Marks the begin of a word, as in the vocabulary.
MARK = "▁"
#: Probability of one letter as a piece outside the vocabulary, in every language.
STRANGE = 1e-9
#: Bits of the table that most substrings outside the vocabulary fail.
FILTER_BITS = 20
#: Words segmented side by side, and letters of long ones; bound memory only.
CHUNK, LETTERS_AT_ONCE = 20_000, 200_000


def letter_runs(text: str) -> list[str]:
    """The words of a text in lower case; number signs such as ½, ² and Ⅷ are no letters."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [run for w in found for run in "".join(c if c.isalpha() else " " for c in w).split()]


@dataclass(frozen=True)
class Settings:
    """``vocabulary``: path of a public sentencepiece model, or None for the installed one;
    ``sample``: labelled rows of each language that are learned from, an expected number; ``rounds`` of expectation maximisation."""

    vocabulary: str | None = None
    sample: int = 400
    rounds: int = 4
    smoothing: float = 0.01
    seed: int = 5


def load_pieces(path: str | None) -> list[str]:
    """Pieces made of letters, with or without the mark of a word's begin, lower-cased."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i)}
    return sorted(p for p in found if p == MARK or p.removeprefix(MARK).isalpha())


def _hashes(points: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(points) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + points[i : i + len(h)]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Lattice:
    """All ways to build words from the vocabulary's pieces."""

    def __init__(self, pieces: list[str]):
        codes = np.array([_hashes(_points(p), len(p))[0] for p in pieces], np.uint64)
        self.piece = np.argsort(codes)
        self.codes = codes[self.piece]
        self.longest = max(map(len, pieces), default=1)
        self.size = len(pieces)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[codes >> np.uint64(64 - FILTER_BITS)] = True

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Steps of all segmentations of the marked words, ordered by where in its word a step ends.

        Returns the nodes a step leaves and reaches, its piece (``size``: one letter outside the vocabulary),
        the border of each end place in that order, and each word's first node.  A word of n
        letters has n + 2 nodes.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        points = _points("".join([MARK + w for w in words]))
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        offset = np.arange(len(points)) - first[word]
        sources, ends, pieces = [np.arange(len(points))], [np.ones(len(points), np.int64)], [np.full(len(points), self.size)]
        for n in range(1, min(self.longest, int(sizes.max(initial=0))) + 1):
            h = _hashes(points, n)
            at = np.flatnonzero(self.filter[h >> np.uint64(64 - FILTER_BITS)] & (offset[: len(h)] + n <= sizes[word[: len(h)]]))
            place = np.searchsorted(self.codes, h[at])
            place[place == self.size] = 0
            real = self.codes[place] == h[at]
            sources.append(at[real])
            ends.append(np.full(int(real.sum()), n))
            pieces.append(self.piece[place[real]])
        source, length, piece = np.concatenate(sources), np.concatenate(ends), np.concatenate(pieces)
        reached = offset[source] + length
        node = source + word[source]
        order = np.argsort(reached * np.int64(len(points) + len(words) + 1) + node + length, kind="stable")
        borders = np.searchsorted(reached[order], np.arange(1, int(sizes.max(initial=0)) + 2))
        return node[order], (node + length)[order], piece[order], borders, first + np.arange(len(words))


def _sum_to(total: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """Add rows to ``total``; equal places follow each other."""
    begin = np.flatnonzero(np.diff(at, prepend=-1))
    total[at[begin]] += np.add.reduceat(value, begin, axis=0)


def forward(edges: tuple, words: int, chance: np.ndarray, letters: int) -> np.ndarray:
    """Probability mass of reaching each node, in every language (the columns)."""
    source, target, piece, borders, first = edges
    mass = np.zeros((letters + 2 * words, chance.shape[1]))
    mass[first] = 1.0
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        if b > a:
            _sum_to(mass, target[a:b], mass[source[a:b]] * chance[piece[a:b]])
    return mass


def _log_forward(edges: tuple, words: int, log_chance: np.ndarray, letters: int) -> np.ndarray:
    """Logarithms of ``forward``, for words of any length."""
    source, target, piece, borders, first = edges
    mass = np.full((letters + 2 * words, log_chance.shape[1]), -np.inf)
    mass[first] = 0.0
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        if b > a:
            begin = np.flatnonzero(np.diff(target[a:b], prepend=-1))
            mass[target[a:b][begin]] = np.logaddexp.reduceat(mass[source[a:b]] + log_chance[piece[a:b]], begin, axis=0)
    return mass


def _log_backward(edges: tuple, last: np.ndarray, mass: np.ndarray, log_chance: np.ndarray) -> np.ndarray:
    source, target, piece, borders, _ = edges
    rest = np.full_like(mass, -np.inf)
    rest[last] = 0.0
    for a, b in zip(borders[-2::-1], borders[:0:-1], strict=True):
        if b > a:
            np.logaddexp.at(rest, source[a:b], rest[target[a:b]] + log_chance[piece[a:b]])
    return rest


def _backward(edges: tuple, last: np.ndarray, mass: np.ndarray, chance: np.ndarray) -> np.ndarray:
    source, target, piece, borders, _ = edges
    rest = np.zeros_like(mass)
    rest[last] = 1.0
    for a, b in zip(borders[-2::-1], borders[:0:-1], strict=True):
        if b > a:
            np.add.at(rest, source[a:b], rest[target[a:b]] * chance[piece[a:b]])
    return rest


def _nodes(words: list[str], edges: tuple) -> tuple[int, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return int(sizes.sum()), edges[4] + sizes + 1


def _chunks(words: list[str]) -> Iterator[tuple[list[int], bool]]:
    """Numbers of words to be segmented side by side, and whether they are long."""
    short = [i for i, w in enumerate(words) if len(w) <= SHORT]
    for i in range(0, len(short), CHUNK):
        yield short[i : i + CHUNK], False
    some: list[int] = []
    letters = 0
    for i in sorted((i for i, w in enumerate(words) if len(w) > SHORT), key=lambda i: len(words[i])):
        if some and letters + len(words[i]) > LETTERS_AT_ONCE:
            yield some, True
            some, letters = [], 0
        some.append(i)
        letters += len(words[i])
    if some:
        yield some, True


def log_likelihoods(lattice: Lattice, chance: np.ndarray, words: list[str]) -> np.ndarray:
    """Log of the summed probability of all segmentations of each word, in every language."""
    out = np.zeros((len(words), chance.shape[1]))
    for numbers, long in _chunks(words):
        some = [words[i] for i in numbers]
        edges = lattice.edges(some)
        letters, last = _nodes(some, edges)
        if long:
            out[numbers] = _log_forward(edges, len(some), np.log(chance), letters)[last]
        else:
            out[numbers] = np.log(forward(edges, len(some), chance, letters)[last])
    return out


def train(rows: list[tuple[str, str]], settings: Settings = Settings()) -> dict:
    """Piece probabilities per language from (text, language) rows, by expectation maximisation.

    Runs on the driver over a bounded sample.  The vocabulary is fixed; only probabilities are learned.
    """
    pieces = load_pieces(settings.vocabulary)
    lattice = Lattice(pieces)
    languages = sorted({lang for _, lang in rows})
    counts: dict[str, Counter] = {lang: Counter() for lang in languages}
    for text, lang in rows:
        counts[lang].update(letter_runs(text))
    words = sorted(set().union(*counts.values())) if languages else []
    weight = np.array([[counts[lang][w] for lang in languages] for w in words], float).reshape(len(words), len(languages))
    chance = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    chance[-1] = STRANGE
    for _ in range(settings.rounds):
        used = np.zeros((len(pieces) + 1, len(languages)))
        for numbers, long in _chunks(words):
            some = [words[i] for i in numbers]
            edges = lattice.edges(some)
            letters, last = _nodes(some, edges)
            source, target, piece = edges[:3]
            sizes = np.diff(np.append(edges[4], letters + 2 * len(some)))
            if long:
                log_chance = np.log(chance)
                mass = _log_forward(edges, len(some), log_chance, letters)
                rest = _log_backward(edges, last, mass, log_chance)
                whole, share = np.repeat(mass[last], sizes, axis=0), np.repeat(weight[numbers], sizes, axis=0)
            else:
                mass = forward(edges, len(some), chance, letters)
                rest = _backward(edges, last, mass, chance)
                share = np.repeat(weight[numbers] / mass[last], sizes, axis=0)
            for n in range(len(languages)):
                if long:
                    value = np.exp(mass[source, n] + log_chance[piece, n] + rest[target, n] - whole[source, n]) * share[source, n]
                else:
                    value = mass[source, n] * chance[piece, n] * rest[target, n] * share[source, n]
                used[:, n] += np.bincount(piece, weights=value, minlength=len(pieces) + 1)
        seen = used[:-1] + settings.smoothing
        chance[:-1] = seen / seen.sum(axis=0)
    return {"pieces": pieces, "chance": chance, "languages": languages}


def sample_labelled(docs: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """Texts and languages to learn from: about ``sample`` rows of each language, picked by a hash of the key.

    The languages are few (the model has a column for each), so their counts go to the driver and come back as
    constants: no text is moved.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    chance = F.lit(0.0)
    for name, n in sorted(tuple(r) for r in known.groupBy(lang).count().collect()):
        chance = F.when(F.col(lang) == name, F.lit(min(1.0, settings.sample / n))).otherwise(chance)
    taken = known.where(hash60(F.lit(settings.seed), F.col(key)) < chance * F.lit(float(1 << 60)))
    return sorted((r[0], r[1]) for r in taken.select(text, lang).collect())


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the probability of that language given the whole text (even priors).

    A null text and one without a letter are ``und`` with score 0; so is every text where the model knows no language.
    Columns named like an output column are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[c for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        lattice, languages = Lattice(m["pieces"]), m["languages"]
        table = WordRows(lambda new: log_likelihoods(lattice, m["chance"], new))
        for piece in text_batches(batches, text):
            names, scores = predict(piece.column(text).to_pylist(), languages, table)
            columns = [*piece.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, "lang_pred", "score"])

    found = kept.mapInArrow(run, schema)
    return replace_columns(found, lang_pred=F.col("lang_pred"), score=F.col("score"))


def predict(texts: list[str | None], languages: list[str], table: WordRows) -> tuple[list[str], np.ndarray]:
    table.begin()
    words_of = [letter_runs(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, words_of), np.int64, len(words_of))
    names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    some = np.flatnonzero(counts)
    if len(some) and languages:
        flat = table.ids([w for ws in words_of for w in ws])
        begin = (np.cumsum(counts) - counts)[some]
        total = np.stack([np.add.reduceat(table.rows[flat, n], begin) for n in range(len(languages))], axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        best = odds.argmax(axis=1)
        names[some] = np.array(languages, object)[best]
        scores[some] = odds.max(axis=1) / odds.sum(axis=1)
    return names.tolist(), scores
