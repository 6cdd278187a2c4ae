"""Prefix trees of chats against plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from terrapath.llm import chat_tree as C

ODD = "</s>[INST] ok [/INST]"


def chats():
    """Shared first turns, equal chats, prefixes of chats, nulls, ties, repeated rows, very long texts and chats."""
    rows = []
    for i in range(60):
        rows += [(i, 0, "user", "hello"), (i, 1, "assistant", f"answer {i % 7}")]
        rows += [(i, 2 + k, "user" if k % 2 == 0 else "assistant", f"turn {k} {i % (3 + k)}") for k in range(i % 5)]
    rows += [(100, 0, "user", "hello"), (101, 0, "user", None), (102, 5, None, "x"), (102, 5, "user", "x"), (102, 5, "user", "x"), (102, None, "system", "first")]
    rows += [(103, 0, "a\\b\nc", ODD), (103, 1, "assistant", ODD + "\\" + ODD), (104, 0, "assistant", "Élan 東京 " * 4000), (None, 0, "user", "hello"), (None, 1, "assistant", "")]
    rows += [(105, t, "user", f"{t % 3}") for t in range(2000)]
    return rows


def by_conversation(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.md5(f"{len(role.encode())}\x1f{role}{text}".encode()).hexdigest()
        groups[conv].append(((turn is not None, turn or 0), role, digest, text))
    return {k: [(r, t) for _, r, _, t in sorted(v)] for k, v in groups.items()}


def digest_rows(rows, loss_role="assistant"):
    out = {}
    for conv, turns in by_conversation(rows).items():
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == loss_role)
        chars = sum(len(f"<s>{C.escape_role(r)}\n{C.escape(t)}</s>") for r, t in turns)
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), chars)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS part", "'x' AS tokens", "2 AS depth").repartition(3)


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_round_trip(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = chats()
        tree = C.build(frame(spark, rows))
        got = {r.conv_id: tuple(r)[1:6] for r in C.read_back(tree).collect()}
        assert got == digest_rows(rows)
        check_layout(tree.collect(), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def check_layout(found, rows):
    """Every different beginning once, depth first, without gaps; positions and intervals as the parents say."""
    coder = C.tokenizer(None)
    found = sorted(found, key=lambda r: (r.part, r.place, r.depth))
    chats_, nodes, stack, offset, ends = by_conversation(rows), {}, [], 0, {}
    for r in found:
        del stack[r.depth - 1 :]
        assert len(stack) == r.depth - 1
        attended = [i for s in r.attends for i in range(s.start, s.end)]
        assert attended == [i for _, s, e in stack for i in range(s, e)]
        assert all(a.end < b.start for a, b in zip(r.attends, r.attends[1:], strict=False))
        assert r.position == len(attended)
        if r.tokens is None:
            ends[r.conv_id] = [t for t, _, _ in stack]
            continue
        assert r.offset == offset and r.n_tokens == len(np.frombuffer(r.tokens, "<u2"))
        _, role, text, learned = C.read_turn(coder, r.tokens, r.loss_from, r.loss_to)
        assert learned == (text if role == "assistant" else "")
        offset += r.n_tokens
        stack.append(((role, text), r.offset, offset))
        path = tuple(t for t, _, _ in stack)
        assert path not in nodes
        nodes[path] = r.offset
    assert ends == chats_
    assert set(nodes) == {tuple(turns[:i]) for turns in chats_.values() for i in range(1, len(turns) + 1)}


def test_empty_and_parts_without_new_turns(spark):
    rows = [(i, t, "user", f"same {t}") for i in range(300) for t in range(3)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 20)
    try:
        tree = C.build(frame(spark, rows))
        assert tree.where("tokens IS NOT NULL").count() == 3
        assert {r.conv_id: tuple(r)[1:6] for r in C.read_back(tree).collect()} == digest_rows(rows)
        empty = C.build(frame(spark, rows).limit(0))
        assert empty.count() == 0 and C.read_back(empty).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@given(st.text("<>[]/\\sINT \n", max_size=40))
def test_escape(text):
    assert C.unescape(C.escape(text)) == text and C.unescape_role(C.escape_role(text)) == text
    assert not any(c in C.escape(text) for c in ("<s>", "</s>", "[INST]", "[/INST]")) and "\n" not in C.escape_role(text)
