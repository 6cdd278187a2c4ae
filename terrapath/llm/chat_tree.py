"""Chats in token form: a prefix tree of turns, laid out depth first, with positions and attention intervals."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapath.llm.common import keep

#: Control strings of the template; their ids follow those of the vocabulary.
BEGIN, END = "<s>", "</s>"
#: What looks like a control string (of this template or of a common one), with the backslashes that escape it.
CONTROL = re.compile(r"(<|\[)(\\*)(/?s>|/?INST\])")
LOSS_ROLE = "assistant"
DIGEST = 16
#: More turns than a conversation can have.
NO_CUT = (1 << 31) - 1
#: Rows of an Arrow batch that leaves a task.
ROWS = 512


@dataclass(frozen=True)
class Settings:
    """``vocabulary``: path of a byte-level rank file, or None for the installed public one; ``loss_role``: the turns that are learned."""

    vocabulary: str | None = None
    loss_role: str = LOSS_ROLE


def escape(text: str) -> str:
    """One backslash more inside everything that looks like a control string."""
    return CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1]}{m[2][1:]}{m[3]}", text)


def escape_role(role: str) -> str:
    """A role is one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


_LOADED: dict = {}


def tokenizer(path: str | None) -> object:
    """Byte-level encoding with the two control strings; loaded once in a Python worker."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        control = {BEGIN: len(ranks), END: len(ranks) + 1}
        _LOADED[path] = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=control)
    return _LOADED[path]


def id_type(coder: object) -> str:
    """Two bytes an id where the vocabulary allows it, little-endian."""
    return "<u2" if coder.n_vocab <= 1 << 16 else "<u4"


def format_turn(coder: object, role: str, text: str) -> tuple[bytes, int, int]:
    """Token ids of ``<s>role\\ntext</s>`` and where the text's tokens begin and end."""
    head = [coder._special_tokens[BEGIN], *coder.encode_ordinary(escape_role(role) + "\n")]
    body = coder.encode_ordinary(escape(text))
    ids = np.array([*head, *body, coder._special_tokens[END]], id_type(coder))
    return ids.tobytes(), len(head), len(head) + len(body)


def read_turn(coder: object, tokens: bytes, start: int, end: int) -> tuple[str, str, str, str]:
    """Formatted text, role, text, and the text under the token interval ``start`` to ``end``, from the ids alone."""
    ids = np.frombuffer(tokens, id_type(coder)).tolist()
    shown = coder.decode(ids)
    role, text = shown[len(BEGIN) : len(shown) - len(END)].split("\n", 1)
    return shown, unescape_role(role), unescape(text), unescape(coder.decode(ids[start:end]))


def _schema(kind: T.DataType, ddl: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(ddl).fields])


def _streamed(rows: Iterator[tuple], schema: T.StructType) -> Iterator:
    """Arrow batches of ``ROWS`` rows."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held = to_arrow_schema(schema), []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def _rows(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


ORDER = ["conv_id", "kind", "turn", "role", "digest"]


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows of conversations: nulls filled, a digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit("\x1f"), role, text).cast("binary")))
    return conversations.select("conv_id", F.lit(1).alias("kind"), "turn", role.alias("role"), digest.alias("digest"), text.alias("text"))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _paths(turns: DataFrame, kind: T.DataType) -> DataFrame:
    """The digests of a conversation's turns, one after the other; only digests are shuffled."""
    schema = _schema(kind, "path binary")
    ordered = turns.select(*ORDER).repartition(_partitions(turns), "conv_id").sortWithinPartitions(*ORDER)

    def run(batches: Iterator) -> Iterator:
        def rows() -> Iterator[tuple]:
            held, last = bytearray(), None
            for conv, _, _, _, digest in _rows(batches):
                if held and conv != last:
                    yield last, bytes(held)
                    held = bytearray()
                last = conv
                held += digest
            if held:
                yield last, bytes(held)

        yield from _streamed(rows(), schema)

    return ordered.mapInArrow(run, schema)


def _shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(p, f"V{DIGEST}", n) for p in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else n


def _placed(paths: DataFrame, kind: T.DataType) -> DataFrame:
    """``conv_id, part, place, shared, size``: conversations in depth-first order, and how many turns each shares with the one before.

    Conversations are range-partitioned by path, so a common first turn or a conversation with many copies is cut over
    partitions.  The last path of a partition goes to the next one; one path per partition passes the driver.
    """
    ranges = paths.repartitionByRange(_partitions(paths), "path", "conv_id").sortWithinPartitions("path", "conv_id")
    sorted_ = keep(ranges.withColumn("part", F.spark_partition_id()))
    ends = sorted_.groupBy("part").agg(F.max("path").alias("path")).collect()
    known = sorted((r.part, bytes(r.path)) for r in ends)
    numbers = [n for n, _ in known]
    schema = _schema(kind, "part int, place long, shared int, size int")

    def run(batches: Iterator) -> Iterator:
        def rows() -> Iterator[tuple]:
            last = None
            for place, (conv, path, part) in enumerate(_rows(batches)):
                if last is None:
                    before = bisect_left(numbers, part)
                    last = known[before - 1][1] if before else b""
                yield conv, part, place, _shared_turns(last, path), len(path) // DIGEST
                last = path

        yield from _streamed(rows(), schema)

    return sorted_.mapInArrow(run, schema)


NODES = "part int, place long, depth int, tokens binary, n_tokens int, loss_from int, loss_to int"


def _new_turns(turns: DataFrame, placed: DataFrame, settings: Settings, kind: T.DataType) -> DataFrame:
    """A row for every turn that the conversation before does not share, tokenised, and one for every conversation's end.

    The place of a conversation is sorted before its turns, so they meet in one stream.
    """
    about = placed.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), "part", "place", "shared", "size",
    )
    met = turns.select("*", *[F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in ("part", "place", "shared", "size")]).unionByName(about)
    schema = _schema(kind, NODES)
    ordered = met.repartition(_partitions(turns), "conv_id").sortWithinPartitions(*ORDER)

    def run(batches: Iterator) -> Iterator:
        def rows() -> Iterator[tuple]:
            coder, part, place, shared, depth = tokenizer(settings.vocabulary), 0, 0, 0, 0
            for conv, is_turn, _, role, _, text, new_part, new_place, new_shared, size in _rows(batches):
                if not is_turn:
                    part, place, shared, depth = new_part, new_place, new_shared, 0
                    yield conv, part, place, size + 1, None, None, None, None
                    continue
                depth += 1
                if depth > shared:
                    tokens, start, end = format_turn(coder, role, text)
                    n_tokens = len(tokens) // np.dtype(id_type(coder)).itemsize
                    yield conv, part, place, depth, tokens, n_tokens, *((start, end) if role == settings.loss_role else (0, 0))

        yield from _streamed(rows(), schema)

    return ordered.mapInArrow(run, schema)


def _extend(spans: list[list[int]], start: int, end: int) -> list[list[int]]:
    """Intervals with one more, joined to the last where they touch."""
    if spans and spans[-1][1] == start:
        return [*spans[:-1], [spans[-1][0], end]]
    return [*spans, [start, end]]


def _stacks(summaries: list) -> tuple[dict, dict]:
    """First offset and open path (start and end of its nodes) of every partition, from the partitions' own sums.

    A partition's summary has its tokens, the fewest turns it shared with the path that came in, and its last path as
    offsets of its own; the path that is open at a border is its own part behind what stays of the one before.
    """
    base, open_, offset, path = {}, {}, 0, []
    for r in sorted(summaries, key=lambda r: r.part):
        base[r.part], open_[r.part] = offset, path
        own = [[offset + s, offset + e] for s, e in zip(r.starts, r.ends, strict=True)]
        path = path[: r.kept] + own
        offset += r.total
    return base, open_


def build(conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Prefix tree of all conversations, depth first: turns that conversations begin with alike are there once.

    ``conversations``: conv_id, turn, role, text; ``turn`` orders the rows of a conversation (equal turns: by role, then by a
    digest).  A turn becomes the tokens of ``<s>role\\ntext</s>``; what looks like a control string inside a role or
    text is escaped, so the ids of ``<s>`` and ``</s>`` are never those of a text.

    Two kinds of rows come back, ordered by ``part, place, depth``.  A turn has ``tokens`` (``n_tokens`` ids, see ``id_type``), the ``offset`` of its first one in the
    stream of all tokens, the ``position`` of its first one in the conversations it belongs to, ``loss_from`` and ``loss_to`` (the tokens
    of it that are learned) and ``attends``: the intervals of the stream that hold its ancestors; a token attends to those and to the tokens before it in
    its own turn.  Neighbouring ancestors are one interval.  The end of a conversation has null ``tokens``, its
    ``conv_id``, and in ``attends`` the intervals of all its tokens; conversations with equal turns end at one node.

    Depth-first order is the order of the turn digests, found by a range sort of conversations; texts are shuffled by conversation
    once, tokens by partition once.  A conversation is one unit (16 bytes a turn are held), its texts are streamed.

    Null role and text count as empty, a null turn comes first, rows with a null conv_id are one conversation; repeated rows are turns
    of their own; an empty table gives an empty result; other columns are not used.
    """
    kind = conversations.schema["conv_id"].dataType
    turns = _turns(conversations)
    placed = _placed(_paths(turns, kind), kind)
    # the partition of a node is known, so its rows go there as they are
    new = keep(_new_turns(turns, placed, settings, kind).repartitionById(_partitions(turns), "part").sortWithinPartitions("part", "place", "depth"))
    summary = T.StructType.fromDDL("part int, total long, kept int, starts array<long>, ends array<long>")

    def sums(batches: Iterator) -> Iterator:
        def rows() -> Iterator[tuple]:
            part, total, kept, stack = None, 0, None, []
            for number, depth, size in _rows(batches):
                part = number
                if size is None:
                    continue
                kept = depth - 1 if kept is None else min(kept, depth - 1)
                del stack[depth - 1 - kept :]
                stack.append([total, total + size])
                total += size
            if part is not None:  # without a new turn the whole path stays open
                yield part, total, NO_CUT if kept is None else kept, [s for s, _ in stack], [e for _, e in stack]

        yield from _streamed(rows(), summary)

    base, open_ = _stacks(new.select("part", "depth", "n_tokens").mapInArrow(sums, summary).collect())
    schema = _schema(kind, NODES.replace("tokens binary", "offset long, position long, tokens binary") + ", attends array<struct<start:long,end:long>>")

    def lay_out(batches: Iterator) -> Iterator:
        def rows() -> Iterator[tuple]:
            # spans, and tokens so far, of the open path up to each depth
            offset, path, begun = 0, [([], 0)], False
            for conv, part, place, depth, tokens, size, start, end in _rows(batches):
                if not begun:
                    begun, offset = True, base.get(part, 0)
                    for s, e in open_.get(part, []):
                        path.append((_extend(path[-1][0], s, e), path[-1][1] + e - s))
                spans, position = path[depth - 1]
                attends = [{"start": s, "end": e} for s, e in spans]
                if tokens is None:
                    yield conv, part, place, depth, None, position, None, None, None, None, attends
                    continue
                yield None, part, place, depth, offset, position, tokens, size, start, end, attends
                del path[depth:]
                path.append((_extend(spans, offset, offset + size), position + size))
                offset += size

        yield from _streamed(rows(), schema)

    return new.mapInArrow(lay_out, schema)


def read_back(tree: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Conversations read from the token stream of ``build``: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens``.

    Each partition of the tree is read in order with a stack of running digests, so a shared turn is decoded once in it.
    The turns that are open where a partition begins lie in earlier ones: the first row of each partition names their intervals, and
    they are lent to it.
    """
    kind = tree.schema["conv_id"].dataType
    tree = tree.select("conv_id", "part", "place", "depth", "offset", "tokens", "n_tokens", "loss_from", "loss_to", "attends")
    first = tree.groupBy("part").agg(F.min_by("attends", F.struct("place", "depth")).alias("attends")).collect()
    wanted = sorted((s["start"], s["end"], r.part) for r in first for s in r.attends)
    points = sorted({x for s, e, _ in wanted for x in (s, e)})
    # readers of each stretch between two borders
    readers: list[list[int]] = [[] for _ in points]
    for s, e, part in wanted:
        for i in range(bisect_right(points, s) - 1, bisect_right(points, e - 1)):
            readers[i].append(part)

    @F.pandas_udf("array<int>")
    def lent_to(offset):
        import pandas as pd

        found = np.searchsorted(points, offset.fillna(-1).to_numpy(), side="right") - 1
        return pd.Series([readers[i] if i >= 0 else [] for i in found])

    own = tree.drop("offset", "attends")
    lent = tree.where("tokens IS NOT NULL").withColumn("part", F.explode(lent_to("offset"))).withColumn("place", F.lit(-1).cast("long"))
    parts = _partitions(tree)
    met = own.unionByName(lent.select(*own.columns)).repartitionById(parts, "part").sortWithinPartitions("part", "place", "depth")
    schema = _schema(kind, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")

    def run(batches: Iterator) -> Iterator:
        def rows() -> Iterator[tuple]:
            coder = tokenizer(settings.vocabulary)
            path = [(hashlib.sha256(), hashlib.sha256(), 0, 0, 0)]
            for conv, _, _, depth, tokens, n, start, end in _rows(batches):
                turns, loss, loss_chars, chars, size = path[depth - 1]
                if tokens is None:
                    yield conv, depth - 1, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, size
                    continue
                shown, role, text, learned = read_turn(coder, tokens, start, end)
                turns, loss = turns.copy(), loss.copy()
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(learned.encode())
                del path[depth:]
                path.append((turns, loss, loss_chars + len(learned), chars + len(shown), size + n))

        yield from _streamed(rows(), schema)

    return met.mapInArrow(run, schema)
