"""Benchmark passages in capitals of any script."""

import pytest

from terrapath.llm import decontaminate

ITEMS = [
    "Élève à l'école, où été et forêt révèlent la beauté cachée des pâturages enneigés près du château",
    "El niño pequeño soñó con la montaña, añoró las mañanas de otoño y bañó su caña en la ría más fría",
    "Größere Straßen führen über die Äcker, müde Füße grüßen schöne Höhlen und süße Früchte außer Haus",
    "Ο δρόμος του βουνού είναι μακρύς και οι δρόμοι του κάμπου είναι εύκολοι για όλους τους ανθρώπους",
]


@pytest.mark.parametrize("item", ITEMS)
def test_capitals_are_no_edits(item):
    index = decontaminate.Index([decontaminate.fold(item)], 0.06)
    # the letters before the passage get longer and shorter when folded
    for before in ("", "abc ", "İİ ẞẞ K Å ", "Ⱥ ŉ "):
        for body in (item, item.upper()):
            text = f"{before}{body} ÉTÉ"
            ((n, i, begin, end, edits),) = decontaminate.find(index, [text])
            assert (n, i, edits) == (0, 0, 0)
            assert text.encode()[begin:end].decode() == body


def test_capitals_in_a_table(spark):
    docs = spark.createDataFrame([(n, f"avant {t.upper()} après") for n, t in enumerate(ITEMS)], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.find_items(docs, bench).collect())
    assert got == [(n, n, 0) for n in range(len(ITEMS))]
