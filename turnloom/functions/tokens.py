"""Tokenizers as column builders.

``one`` and ``many`` turn a text, or an array of texts, into token arrays; ``size_of``
counts the tokens of a literal at plan time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions.arrays import pieces_under_mask
from turnloom.functions.template import END, START
from turnloom.functions.text import SPACE, quote


@dataclass(frozen=True)
class PieceTokenizer:
    """Lossless pieces: a special mark, one whitespace character, or a run of other text.

    Concatenating the pieces gives the text back, and marks never join their
    neighbours, so the parts of a rendered conversation can be split separately.
    """

    specials: tuple[str, ...] = (START, END)

    #: Whether a token may hold parts of two turns.
    @property
    def crosses_turns(self) -> bool:
        return False

    def _pattern(self, escape: Callable[[str], str]) -> str:
        heads = "".join(sorted({escape(s[0]) for s in self.specials}))
        branches = [escape(s) for s in self.specials]
        branches += [SPACE, f"[^\\s\\x1C-\\x1F{heads}]+"]
        branches += [f"[{heads}]"] if heads else []
        return "|".join(branches)

    def one(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit("(?U)" + self._pattern(quote)), F.lit(0))

    def many(self, texts: Column) -> Column:
        return F.transform(texts, self.one)

    def size_of(self, text: str) -> int:
        return len(re.findall(self._pattern(re.escape), text))

    def has_token(self, token: str) -> bool:
        return token in self.specials

    def text(self, tokens: Column) -> Column:
        return F.array_join(tokens, "")

    def texts_under_mask(self, tokens: Column, mask: Column) -> Column:
        """The text of every maximal run of ones."""
        return F.transform(pieces_under_mask(tokens, mask), self.text)


@dataclass(frozen=True)
class FunctionTokenizer:
    """A tokenizer given as a Python function, run in Arrow batches.

    ``load`` is called once per Python worker and returns ``(encode, decode)``, which map
    a list of texts to a list of id lists and back; heavy models stay out of the plan.
    ``crosses_turns`` says whether a token may hold parts of two turns, or depend on what
    stands beside; loss masks then look at messages beside others.
    """

    load: Callable[[], tuple[Callable, Callable]]
    added_tokens: tuple[str, ...] = ()
    crosses_turns: bool = True

    def _worker(self) -> Callable[[], tuple[Callable, Callable]]:
        load, held = self.load, []

        def get() -> tuple[Callable, Callable]:
            if not held:
                held.append(load())
            return held[0]

        return get

    def one(self, text: Column) -> Column:
        get = self._worker()

        @F.pandas_udf("array<int>")
        def encode(texts: pd.Series) -> pd.Series:
            known = texts[texts.notna()]
            ids = pd.Series(list(get()[0](known.tolist())), index=known.index, dtype=object)
            return ids.reindex(texts.index).where(texts.notna(), None)

        return encode(text)

    def many(self, texts: Column) -> Column:
        get = self._worker()

        @F.pandas_udf("array<array<int>>")
        def encode(batch: pd.Series) -> pd.Series:
            lists = [[] if row is None else list(row) for row in batch]
            flat = iter(get()[0]([text for row in lists for text in row]))
            return pd.Series([[next(flat) for _ in row] for row in lists], dtype=object)

        return encode(texts)

    def size_of(self, text: str) -> int:
        return len(self.load()[0]([text])[0])

    def has_token(self, token: str) -> bool:
        return token in self.added_tokens

    def text(self, tokens: Column) -> Column:
        get = self._worker()

        @F.pandas_udf("string")
        def decode(batch: pd.Series) -> pd.Series:
            lists: Sequence = [[] if row is None else [int(i) for i in row] for row in batch]
            return pd.Series(get()[1](lists), dtype=object)

        return decode(tokens)

    def texts_under_mask(self, tokens: Column, mask: Column) -> Column:
        get = self._worker()

        @F.pandas_udf("array<string>")
        def decode(batch: pd.Series, masks: pd.Series) -> pd.Series:
            rows = []
            for ids, bits in zip(batch, masks):
                runs = groupby(zip(ids, bits), key=lambda pair: pair[1] == 1)
                rows.append([[int(i) for i, _ in run] for on, run in runs if on])
            flat = iter(get()[1]([ids for row in rows for ids in row]))
            return pd.Series([[next(flat) for _ in row] for row in rows], dtype=object)

        return decode(tokens, mask)


PIECES = PieceTokenizer()


def template_overhead(template, tokenizer) -> tuple[int, int]:
    """Tokens of the template's own system prefix, and of the generation header.

    One and two copies of a dummy turn differ by exactly one bare turn, which leaves the
    prefix as the remainder.
    """
    dummy = ("user", "FOR TESTING ONLY")
    once = tokenizer.size_of(template.render_text([dummy]))
    twice = tokenizer.size_of(template.render_text([dummy, dummy]))
    opened = tokenizer.size_of(template.render_text([dummy], generation=True))
    return 2 * once - twice, opened - once
