"""Token counts without tokens: a compiled transducer whose transitions carry counts.

The BPE vocabulary becomes a machine (``transducer.Machine``) whose transitions are
annotated with the number of tokens they emit. It falls back to its start state at
every symbol that no piece joins to what came before: before a space that follows
another character, and around characters that no piece holds, such as line ends. So
the effect of a chunk of text is known whatever state it is entered in, but for its
open first and last word. Such chunk maps compose associatively, so they are taken
chunk by chunk and put together by a prefix scan in pairs; a text of any length is
counted in chunks. Words seen before are one transition, from start to start.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark import Broadcast
from pyspark.sql import DataFrame

from turnloom.llm.pieces import SPACE, Pieces, read_pieces
from turnloom.llm.texts import kept, map_texts
from turnloom.llm.transducer import Machine, Memo

#: Characters of a chunk, and words whose counts a worker keeps.
CHUNK, WORDS = 1 << 20, 200_000


class ChunkMap(NamedTuple):
    """What a chunk does to any text around it: its open words and the tokens between."""

    open: tuple[str, ...]
    count: int


class Counter:
    """Counts by a model file; words begin with a space or follow a line end."""

    def __init__(self, model: bytes) -> None:
        pieces: Pieces = read_pieces(model)
        spelling = {number: text for text, number in pieces.ids.items()}
        scores, ids = pieces.scores, pieces.ids

        def rank(left: int, right: int):
            merged = ids.get(spelling[left] + spelling[right])
            return None if merged is None else (-scores[merged], merged)

        self.machine = Machine(
            spelling, rank, lambda c: tuple(pieces.bytes[b] for b in c.encode())
        )
        if any("\n" in text for text in ids):
            raise ValueError("pieces that hold a line end are not supported")
        self.tokens = Memo(self.machine.count, WORDS)
        self.tokens[""] = 0
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def sum(self, words: list[str]) -> int:
        return sum(map(self.tokens.__getitem__, words))

    def chunk(self, marked: str) -> ChunkMap:
        words = self.words.findall(marked)
        return ChunkMap((*words[:1], *words[1:][-1:]), self.sum(words[1:-1]))

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``; associative, so any bracketing gives the same."""
        if not a.open or not b.open:
            return b if not a.open else a
        words = (*a.open[:-1], *self.words.findall(a.open[-1] + b.open[0]), *b.open[1:])
        return ChunkMap((*words[:1], *words[1:][-1:]), a.count + b.count + self.sum(words[1:-1]))

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if not text:
            return 0
        if len(text) <= chunk and "  " not in text and SPACE not in text and text[0] != " ":
            # A space opens a word, a line end is one alone; splits give no empty word but "".
            marked = SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")
            return self.sum(marked.split(" "))
        marked = SPACE + text.replace(" ", SPACE)
        maps = [self.chunk(marked[k : k + chunk]) for k in range(0, len(marked), chunk)]
        while len(maps) > 1:
            pairs = [self.compose(*maps[k : k + 2]) for k in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[2 * len(pairs) :]
        return maps[0].count + self.sum(list(maps[0].open))


def counter(model: bytes) -> Counter:
    return kept((Counter, model), lambda: Counter(model))


def _worker(shared: Broadcast):
    return counter(shared.value)


def count_tokens(
    df: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for each row, by the BPE model file ``model``.

    Counts are those of SentencePiece's ``encode`` with its defaults. NULL counts as the
    empty text: no bytes, no tokens. Repeated rows are counted each; an empty table gives
    none; other columns are not read, whatever their names. The driver reads the model file
    (a vocabulary's size) and sends it to the tasks. No shuffle.
    """
    with open(model, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def make():
        count = _worker(shared).count

        def work(texts: list[str | None]) -> list:
            n = [count(t) for t in texts]
            return [[len((t or "").encode()) for t in texts], n, [x > limit for x in n]]

        return work

    return map_texts(df, [key], text, make, "n_bytes long, n_tokens long, over_limit boolean", keeps=True)
