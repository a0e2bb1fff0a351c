"""Patterns that arrive as data, run by automata.

A pattern of a constraint row must not be able to stop a job. Arrow's string kernels compile a
pattern to an automaton that reads a text once: no back-references, no look-around, time in
proportion to the text and memory that is bounded. Patterns that are not of this kind, or that
would make too large an automaton, match nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: The kind whose argument is a pattern.
MATCHES = "matches"


def any_match(texts: pa.Array, pattern: str) -> list[bool]:
    """Whether the pattern matches somewhere in each text; NULL and bad patterns match nothing."""
    try:
        found = pc.match_substring_regex(texts, pattern=pattern)
    except pa.ArrowInvalid:
        return [False] * len(texts)
    return [hit is True for hit in found.to_pylist()]


@F.arrow_udf(BooleanType())
def all_match(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Do all patterns of a row match its text? The rows of a batch that share a pattern are
    searched together; a row without a list asks for nothing and holds."""
    for texts, lists in batches:
        wanted: dict[str | None, list[int]] = defaultdict(list)
        for row, patterns in enumerate(lists.to_pylist()):
            for pattern in set(patterns or ()):
                wanted[pattern].append(row)
        held = [True] * len(texts)
        for pattern, rows in wanted.items():
            hits = [False] * len(rows) if pattern is None else any_match(texts.take(pa.array(rows)), pattern)
            for row, hit in zip(rows, hits):
                held[row] &= hit
        yield pa.array(held, pa.bool_())


def patterns_match(text: Column, patterns: Column) -> Column:
    """Whether every pattern (an array) matches somewhere in the text."""
    return all_match(text, patterns)
