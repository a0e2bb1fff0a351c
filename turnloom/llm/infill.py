"""Fill-in-middle by secondary sort: pieces of documents in output order, digested as they stream by.

A text is cut into units (a word and the blanks before it), and chunks of units become
pieces keyed by document and output position. One exchange by document with a sort by
position inside the partitions (what an RDD calls repartitionAndSortWithinPartitions; the
DataFrame form sorts and spills in the JVM) brings the pieces of an output in order past an
incremental digest. The output is read as it streams: its marks tell the section of each
piece, and a second sort inside the same partitions, without an exchange, brings the
pieces back into text order. No task holds more than one piece of a document at a time.

The key of a document is a digest of its id and text, so it depends on neither partitions
nor retries. Rows that repeat make equal pieces: a task emits them once with a count, the
streams pass over those of other tasks, and every row is answered.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Units and characters of a piece at most; a longer unit is cut.
UNITS, CHARS = 512, 8192
#: Characters whose units are found at a time, and rows and characters of a batch that is passed on.
BLOCK, ROWS, BATCH = 1 << 20, 1024, 1 << 22
#: Documents a task remembers to count those that repeat; beyond, it starts anew.
SEEN = 1 << 16
#: The marks, and the sections of a text that follow them, in text order.
MARKS = {"<P>": 0, "<M>": 1, "<S>": 2}
ORDERS = {"psm": ("<P>", "<S>", "<M>"), "spm": ("<S>", "<P>", "<M>")}
PLAIN = "plain"


def unit_ends(text: str) -> np.ndarray:
    """Where each unit ends: after a word, and after blanks that end the text."""
    found = [np.empty(0, dtype=np.int64)]
    for start in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[start : start + BLOCK + 1].encode("utf-32-le"), dtype="<u4")
        blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
        here = min(BLOCK, len(text) - start)
        followed = np.append(blank[1:], True)[:here]
        found.append(np.flatnonzero(~blank[:here] & followed) + (start + 1))
    if text and text[-1] in " \t\n\v\f\r":
        found.append(np.array([len(text)]))
    return np.concatenate(found)


def draws(seed: int, key) -> list[int]:
    """Four numbers that depend on the seed and the document's id; NULL counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def plan(text: str, key, seed: int, rate: int, spm: int) -> tuple[int, str, list[int], np.ndarray]:
    """Number of units, form, the borders of prefix, middle and suffix, and where units end."""
    ends = unit_ends(text)
    first, second, chance, order = draws(seed, key)
    n = len(ends)
    if not text or chance % 100 >= rate or any(mark in text for mark in MARKS):
        return n, PLAIN, [0, len(text)], ends
    low, high = sorted((first % (n + 1), second % (n + 1)))
    cut = lambda units: int(ends[units - 1]) if units else 0
    form = "spm" if order % 100 < spm else "psm"
    return n, form, [0, cut(low), cut(high), len(text)], ends


def cut_pieces(text: str, start: int, end: int, steps: np.ndarray) -> Iterator[str]:
    """A section in chunks of units; ``steps`` are the ends of every so many units."""
    inside = steps[(steps > start) & (steps < end)].tolist()
    for low, high in zip([start, *inside], [*inside, end]):
        for at in range(low, high, CHARS):
            yield text[at : min(at + CHARS, high)]


def output_pieces(text: str, form: str, borders: list[int], ends: np.ndarray) -> Iterator[str]:
    """The output of a document, marks among the pieces."""
    steps = ends[UNITS - 1 :: UNITS]
    if form == PLAIN:
        yield from cut_pieces(text, 0, len(text), steps)
        return
    for mark in ORDERS[form]:
        yield mark
        section = MARKS[mark]
        yield from cut_pieces(text, borders[section], borders[section + 1], steps)


class Batches:
    """Rows collected into Arrow batches of a bounded size."""

    def __init__(self, schema: T.StructType) -> None:
        self.arrow = to_arrow_schema(schema)
        self.rows: list[tuple] = []
        self.chars = 0

    def add(self, row: tuple, chars: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.chars += chars
        if len(self.rows) >= ROWS or self.chars >= BATCH:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            arrays = [pa.array(values, f.type) for values, f in zip(zip(*self.rows), self.arrow)]
            self.rows, self.chars = [], 0
            yield pa.RecordBatch.from_arrays(arrays, schema=self.arrow)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from zip(*(column.to_pylist() for column in batch.slice(at, ROWS).columns))


def _schema(key: T.StructField, more: str = "") -> T.StructType:
    """Rows of pieces; the head of a document, at -1, has its facts and no piece."""
    own = "mark binary, section int, at long, piece string, copies long, n long, form string, prefix_chars long, middle_chars long"
    return T.StructType([*T.StructType.fromDDL(own + more).fields, T.StructField("key", key.dataType)])


def pieces(df: DataFrame, key: str, text: str, seed: int, rate: int, spm: int) -> DataFrame:
    """``mark, at, piece`` for each piece in output order, and a head for each document."""
    source = df.select(key, text)
    schema = _schema(source.schema[0])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)
        seen: dict[bytes, tuple] = {}
        again: Counter[bytes] = Counter()

        def repeated() -> Iterator[pa.RecordBatch]:
            for mark, copies in again.items():
                yield from out.add((mark, -1, -1, None, copies, *seen[mark]))
            seen.clear()
            again.clear()

        for doc, body in _read(batches):
            body = body or ""
            named = f"{'-' if doc is None else doc}:".encode() + body.encode()
            mark = hashlib.blake2b(named, digest_size=16).digest()
            if mark in seen:
                again[mark] += 1
                continue
            n, form, borders, ends = plan(body, doc, seed, rate, spm)
            sizes = (None, None) if form == PLAIN else (borders[1], borders[2] - borders[1])
            head = (n, form, *sizes, doc)
            yield from out.add((mark, -1, -1, None, 1, *head))
            for at, piece in enumerate(output_pieces(body, form, borders, ends)):
                yield from out.add((mark, 0, at, piece, *[None] * 6), len(piece))
            seen[mark] = head
            if len(seen) >= SEEN:
                yield from repeated()
        yield from repeated()
        yield from out.rest()

    return source.mapInArrow(emit, schema)


def in_output_order(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """The pieces of every document, next to each other and in output order."""
    return pieces(df, key, text, seed, rate, spm).repartition("mark").sortWithinPartitions("mark", "at")


def _documents(rows: Iterator[tuple]) -> Iterator[tuple]:
    """``(first of document, row)`` in order; the pieces that a repeated row made again are left out, its
    heads are not."""
    mark = section = at = None
    for row in rows:
        first = row[0] != mark
        if not first and row[2] >= 0 and (row[1], row[2]) == (section, at):
            continue
        mark, section, at = row[:3]
        yield first, row


def with_output(ordered: DataFrame, whole: bool) -> DataFrame:
    """The output's digest added to the head of each document, and its pieces with their section;
    with ``whole`` the output itself instead of the pieces.

    The section is read off the output: the marks that stand in it, unless its form is plain.
    """
    schema = _schema(ordered.schema["key"], ", output_sha256 string, output string")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)
        head = digest = None
        copies, section, kept = 0, 0, []

        def ended() -> Iterator[pa.RecordBatch]:
            if head is not None:
                facts = (*head[5:9], digest.hexdigest(), "".join(kept) if whole else None, head[9])
                yield from out.add((head[0], -1, -1, None, copies, *facts), sum(map(len, kept)))

        for first, row in _documents(_read(batches)):
            if first:
                yield from ended()
                head, digest, copies, section, kept = row, hashlib.sha256(), 0, 0, []
            mark, _, at, piece = row[:4]
            if at < 0:
                copies += row[4]
                continue
            digest.update(piece.encode())
            if whole:
                kept.append(piece)
                continue
            if head[6] != PLAIN and piece in MARKS:
                section = MARKS[piece]
            else:
                yield from out.add((mark, section, at, piece, *[None] * 8), len(piece))
        yield from ended()
        yield from out.rest()

    return ordered.mapInArrow(stream, schema)


def with_restored(outputs: DataFrame, key: str) -> DataFrame:
    """One row for each row of the documents, with the digest of the text rebuilt from its output."""
    ordered = outputs.drop("output").sortWithinPartitions("mark", "section", "at")
    facts = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    schema = T.StructType([T.StructField(key, outputs.schema["key"].dataType), *T.StructType.fromDDL(facts).fields])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)
        head = digest = None

        def ended() -> Iterator[pa.RecordBatch]:
            if head is not None:
                for _ in range(head[4]):
                    yield from out.add((head[10], *head[5:10], digest.hexdigest()))

        for first, row in _documents(_read(batches)):
            if first:
                yield from ended()
                head, digest = row, hashlib.sha256()
            if row[2] >= 0:
                digest.update(row[3].encode())
        yield from ended()
        yield from out.rest()

    return ordered.mapInArrow(stream, schema)


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output``: each row's text with its middle moved to the end.

    A text of n units is cut after two numbers of units drawn from ``seed`` and the key. Of
    100 texts ``rate`` are moved, ``spm`` of these 100 with the suffix first. An empty or
    NULL text, and one that holds a mark, stays as it is (``plain``; sizes NULL). A NULL key
    draws as one without digits. Rows that repeat are answered each; other columns are not
    read; an empty table gives none.
    """
    heads = with_output(in_output_order(df, key, text, **options), whole=True)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return heads.select(F.col("key").alias(key), "n", "form", "prefix_chars", "middle_chars", "output", each.alias("_copy")).drop("_copy")


def infill_digests(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``: as
    ``fill_in_middle``, with digests of the output and of the text rebuilt from it, neither of
    which is ever held whole."""
    return with_restored(with_output(in_output_order(df, key, text, **options), whole=False), key)


def restore(output: str, form: str) -> str:
    """The text an output was made of."""
    if form == PLAIN:
        return output
    marks = ORDERS[form]
    starts = [output.index(mark) for mark in marks]
    ends = [*starts[1:], len(output)]
    parts = {mark: output[s + len(mark) : e] for mark, s, e in zip(marks, starts, ends)}
    return "".join(parts[mark] for mark in MARKS)
