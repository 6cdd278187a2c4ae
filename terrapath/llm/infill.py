"""Fill-in-middle: texts cut into prefix, middle and suffix, rearranged by a secondary sort of bounded pieces, and rebuilt."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapath.llm.common import text_batches

#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Order of the parts in a form's output; a plain text is one part.
LAYOUTS = {"psm": "PSM", "spm": "SPM", "plain": "T"}
NATURAL = "PMST"
#: Rows of an Arrow batch that leaves a task.
ROWS = 256


@dataclass(frozen=True)
class Settings:
    """``rate``: texts of 100 that are rearranged; ``spm``: those of 100 of them that begin with the suffix; ``seed``: goes before the id in the hash; ``piece``: characters of a piece, longer parts are cut."""

    rate: int = 100
    spm: int = 50
    seed: int = 7
    piece: int = 16_384


PIECES = "doc_key binary, doc_id {id}, n long, form string, prefix_chars long, middle_chars long, position int, piece string, output_sha256 string"


def lines(text: str) -> int:
    """Units of a text: lines with their line feed, the last one perhaps without."""
    return text.count("\n") + (text[-1:] not in ("", "\n"))


def line_end(text: str, count: int) -> int:
    """Characters of the first ``count`` units."""
    at = 0
    for _ in range(count):
        at = text.find("\n", at) + 1
        if not at:
            return len(text)
    return at


def divide(doc_id: object, text: str, settings: Settings) -> tuple[int, str, int, int]:
    """Units, form, and where prefix and middle end; decided by SHA-256 of the seed and the id."""
    digest = hashlib.sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = lines(text)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= settings.rate:
        return n, "plain", 0, 0
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first = line_end(text, low)
    return n, "spm" if h[3] % 100 < settings.spm else "psm", first, first + line_end(text[first:], high - low)


def _send(rows: list[tuple], schema: object) -> Iterator:
    import pyarrow as pa

    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _streamed(rows: Iterator[tuple], schema: object) -> Iterator:
    """Batches of at most ``ROWS`` rows, so some 16 MB of pieces at most."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield from _send(held, schema)
            held = []
    yield from _send(held, schema)


def _arrow(schema: T.StructType) -> object:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def cut_pieces(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every text with their position in the output; no order yet.

    ``doc_key`` names the row: a digest of id, text and input partition.  Repeated rows of a partition
    share a key; their pieces come together and are counted as copies.
    """
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    schema = T.StructType([f for f in T.StructType.fromDDL(PIECES.format(id="string")).fields if f.name != "output_sha256"])
    schema["doc_id"].dataType = kind

    def run(batches: Iterator) -> Iterator:
        def pieces() -> Iterator[tuple]:
            for batch in text_batches(batches):
                for i, t, part in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "part")], strict=True):
                    key = hashlib.md5(f"{part}\x1f{i is None}\x1f{i}\x1f{t}".encode("utf-8", "surrogatepass")).digest()
                    n, form, first, second = divide(i, t, settings)
                    whole = {"P": t[:first], "M": t[first:second], "S": t[second:], "T": t}
                    sizes = (None, None) if form == "plain" else (first, second - first)
                    out = [x for name in LAYOUTS[form] for x in ("" if name == "T" else f"<{name}>", *_chunks(whole[name], settings.piece)) if x]
                    for position, piece in enumerate(out or [""]):
                        yield key, i, n, form, *sizes, position, piece

        yield from _streamed(pieces(), _arrow(schema))

    return rows.mapInArrow(run, schema)


def _chunks(part: str, size: int) -> Iterator[str]:
    """A part in pieces of whole lines where lines are short enough; a long line is cut."""
    at = 0
    while at < len(part):
        end = at + size
        if end < len(part):
            end = part.rfind("\n", at, end) + 1 or end
        yield part[at:end]
        at = end


def assemble(pieces: DataFrame) -> DataFrame:
    """Outputs as streams: the pieces of a document in output order, ``output_sha256`` on its last one.

    One shuffle by document, sorted by document and position inside the partitions (Spark spills
    what does not fit); a task holds one piece and one running digest.  Equal rows that came from one
    partition are one stream; ``copies`` says how many they are.
    """
    fields = [*pieces.schema.fields, T.StructField("copies", T.LongType()), T.StructField("output_sha256", T.StringType())]
    schema = T.StructType(fields)
    partitions = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.repartition(partitions, "doc_key").sortWithinPartitions("doc_key", "position")

    def run(batches: Iterator) -> Iterator:
        def stream() -> Iterator[tuple]:
            last, copies, digest = None, 0, None
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if last is not None and (row[0], row[-2]) == (last[0], last[-2]):
                        copies += 1  # the same piece of an equal row
                        continue
                    if last is not None:
                        digest.update(last[-1].encode("utf-8", "surrogatepass"))
                        yield *last, copies, digest.hexdigest() if row[0] != last[0] else None
                    if last is None or row[0] != last[0]:
                        digest = hashlib.sha256()
                    last, copies = row, 1
            if last is not None:
                digest.update(last[-1].encode("utf-8", "surrogatepass"))
                yield *last, copies, digest.hexdigest()

        yield from _streamed(stream(), _arrow(schema))

    return ordered.mapInArrow(run, schema)


class Reader:
    """Reads one output as it streams by and says which part every character belongs to.

    Only the form and the characters are used.  A mark may begin in one piece and end in the next:
    the last two characters wait until the next piece has come.
    """

    def __init__(self, form: str):
        self.layout, self.at, self.rest = LAYOUTS[form], 0, ""
        if form != "plain":
            self.at = -1  # the first mark is still to come

    def feed(self, piece: str, last: bool) -> Iterator[tuple[str, str]]:
        text = self.rest + piece
        while self.at + 1 < len(self.layout):
            mark = f"<{self.layout[self.at + 1]}>"
            found = text.find(mark)
            if found < 0:
                break
            if found:
                yield self.layout[self.at], text[:found]
            text = text[found + len(mark) :]
            self.at += 1
        wait = 0 if last or self.at + 1 == len(self.layout) else min(2, len(text))
        self.rest = text[len(text) - wait :]
        if len(text) > wait:
            yield self.layout[self.at], text[: len(text) - wait]


def restore(outputs: DataFrame) -> DataFrame:
    """The texts behind the outputs: one row per document with ``restored_sha256`` and the other columns.

    The streams of ``assemble`` are read where they are; their parts are sorted once more, now by
    document and place in the text, inside the partitions (no second shuffle), and pass a running digest.
    """
    about = [f for f in outputs.schema.fields if f.name not in ("position", "piece")]
    read = T.StructType([*about, T.StructField("part", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("piece", T.StringType())])
    done = T.StructType([*about[1:], T.StructField("restored_sha256", T.StringType())])
    at = {f.name: i for i, f in enumerate(outputs.schema.fields)}
    keep = [at[f.name] for f in about]

    def parse(batches: Iterator) -> Iterator:
        def parts() -> Iterator[tuple]:
            reader, place = None, 0
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if reader is None:
                        reader, place = Reader(row[at["form"]]), 0
                    own = [row[i] for i in keep]
                    end = row[at["output_sha256"]] is not None
                    found = list(reader.feed(row[at["piece"]], end))
                    for name, text in found or ([("T", "")] if end else []):
                        yield *own, NATURAL.index(name), place, text
                        place += 1
                    if end:
                        reader = None

        yield from _streamed(parts(), _arrow(read))

    def finish(batches: Iterator) -> Iterator:
        def rows() -> Iterator[tuple]:
            last, digest, sha = None, None, None
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if last is None or row[0] != last[0]:
                        if last is not None:
                            yield from [(*last[1:-4], sha, digest.hexdigest())] * last[-5]
                        digest, sha = hashlib.sha256(), None
                    digest.update(row[-1].encode("utf-8", "surrogatepass"))
                    sha = row[-4] or sha
                    last = row
            if last is not None:
                yield from [(*last[1:-4], sha, digest.hexdigest())] * last[-5]

        yield from _streamed(rows(), _arrow(done))

    return outputs.mapInArrow(parse, read).sortWithinPartitions("doc_key", "part", "place").mapInArrow(finish, done)


def fill_in_middle(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fill-in-middle outputs of all texts as ordered pieces.

    ``doc_key, doc_id, n, form, prefix_chars, middle_chars, position, piece, copies, output_sha256``: the pieces
    of a document, joined in the order of ``position``, are its output; ``n`` counts its lines.
    Prefix, middle and suffix are whole lines; the cuts and the form depend on id and seed alone.  psm is
    ``<P>prefix<S>suffix<M>middle``, spm ``<S>suffix<P>prefix<M>middle``.  A text that is empty or holds a mark, and
    the share beyond ``rate``, stays plain.

    A null text counts as empty, a null id as the empty text in the hash; equal rows of an input partition share one
    stream with their number in ``copies`` (``restore`` returns a row each); a very long text or line is cut into pieces of
    ``piece`` characters; an empty table gives an empty result; other columns are not used.
    """
    return assemble(cut_pieces(docs, settings, doc_id, text))
