"""Words of any length in training and scoring."""

import numpy as np
import pytest

from terrapath.llm import language
from terrapath.llm.words import WordRows

STRANGE = "ሀለሐመሠረሰ"


def test_logarithms_equal_products(monkeypatch):
    pieces = ["the", "▁the", "▁t", "he", "t", "h", "e", "▁", "th", "▁la", "la", "l", "a"]
    lattice = language.Lattice(pieces)
    chance = np.random.default_rng(0).random((len(pieces) + 1, 3))
    words = ["the", "la", "x", "thela", "hethe", "e", "thela" * 5]
    want = language.log_likelihoods(lattice, chance, words)
    rows = [("the cat and the dog", "en"), ("le chat et la souris", "fr")]
    model = language.train(rows)["chance"]
    monkeypatch.setattr(language, "SHORT", 0)
    monkeypatch.setattr(language, "LETTERS_AT_ONCE", 6)
    assert np.allclose(language.log_likelihoods(lattice, chance, words), want)
    assert np.allclose(language.train(rows)["chance"], model)


def test_whole_word_is_segmented():
    """A piece that lies across the 40th letter counts."""
    lattice = language.Lattice(["▁", "a", "bc"])
    chance = np.array([[0.2], [0.3], [0.4], [1e-9]])
    got = language.log_likelihoods(lattice, chance, ["a" * 39 + "bc" + "a" * 9])
    assert got[0, 0] == pytest.approx(np.log(0.2) + 48 * np.log(0.3) + np.log(0.4))


@pytest.mark.parametrize("letters", [36, 41, 3000])
def test_letters_outside_the_vocabulary(letters):
    word = (STRANGE * 500)[:letters]
    rows = [("the cat and the dog " * 3, "en"), ("le chat et la souris " * 3, "fr")]
    model = language.train([*rows, (f"the {word} cat", "en")])
    assert np.isfinite(model["chance"]).all() and np.allclose(model["chance"][:-1].sum(axis=0), 1)
    lattice = language.Lattice(model["pieces"])
    table = WordRows(lambda new: language.log_likelihoods(lattice, model["chance"], new))
    texts = ["le chat et la souris", f"le chat et {word} la souris", f"the cat {word} and the dog", word]
    names, scores = language.predict(texts, model["languages"], table)
    assert names[:3] == ["fr", "fr", "en"] and np.isfinite(scores).all()
    assert np.isfinite(language.log_likelihoods(lattice, model["chance"], [word])).all()


def test_number_signs_are_no_letters():
    assert language.letter_runs("½ ² Ⅷ ①5 _ 12") == []
    assert language.letter_runs("Ab½cd É² 東京") == ["ab", "cd", "é", "東京"]
