"""Fill-in-middle against plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from fixtures import documents, texts
from hypothesis import given
from hypothesis import strategies as st

from terrapath.llm import infill


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text, settings=infill.Settings()):
    """Output by the definition, units found by the pattern."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{settings.seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= settings.rate:
        return doc_id, len(units), "plain", None, None, text
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < settings.spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [(100, "<P>"), (101, "a<S>b\n"), (102, "\n"), (103, "\n\n\n"), (104, "<\n<P\n<S\n>\nM>\n"), (105, "one line"), (106, "x\ny"), (107, "é\r\n東\n" * 9), (108, "-" * 50_000 + "\n" + "+" * 40_000)]


@pytest.mark.parametrize("settings", [infill.Settings(), infill.Settings(rate=60, spm=20, seed=3, piece=7)])
def test_outputs_and_round_trip(spark, settings):
    rows = texts() + ODD
    docs = documents(spark, rows).selectExpr("*", "1 AS n", "'x' AS form", "'x' AS piece")
    made = infill.fill_in_middle(docs, settings)
    want = Counter(plain(i, t, settings) for i, t in rows)
    joined = {}
    for r in sorted(made.collect(), key=lambda r: (r.doc_key, r.position)):
        about, parts = joined.setdefault(r.doc_key, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.copies), []))
        parts.append((r.piece, r.output_sha256))
    got = Counter()
    for (*about, copies), parts in joined.values():
        output = "".join(p for p, _ in parts)
        assert [h for _, h in parts] == [None] * (len(parts) - 1) + [sha(output)]
        got[(*about, output)] += copies
    assert got == want
    back = Counter(tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) for r in infill.restore(made).collect())
    assert back == Counter((*plain(i, t, settings)[:5], sha(plain(i, t, settings)[5]), sha(t or "")) for i, t in rows)


def test_empty(spark):
    assert infill.restore(infill.fill_in_middle(documents(spark, texts()).limit(0))).count() == 0


@given(st.text("<>PSM\nx", max_size=30), st.integers(0, 50), st.lists(st.integers(1, 5), max_size=20))
def test_reader_takes_any_cut(text, doc_id, sizes):
    """Marks may fall on any border between pieces."""
    _, _, form, prefix, middle, output = plain(doc_id, text)
    pieces, at = [], 0
    for n in sizes:
        pieces.append(output[at : at + n])
        at += n
    pieces.append(output[at:])
    reader, parts = infill.Reader(form), Counter()
    for i, piece in enumerate(pieces):
        for name, part in reader.feed(piece, i == len(pieces) - 1):
            parts[name] = (parts[name] or "") + part
    assert "".join(parts[name] or "" for name in infill.NATURAL) == text
    if form != "plain":
        assert (parts["P"] or "", parts["M"] or "") == (text[:prefix], text[prefix : prefix + middle])
