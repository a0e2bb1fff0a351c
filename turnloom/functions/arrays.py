"""Array columns: mask lengths, tails, runs and sublist search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column used inside a lambda is evaluated for every element; binding it as a
    lambda variable keeps array expressions linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat(value: int | float, times: Column) -> Column:
    return F.array_repeat(F.lit(value), times.cast("int"))


def response_length(mask: Column) -> Column:
    """Elements from the first 1 to the end of the mask; 0 where no 1 occurs."""

    def measure(bits: Column) -> Column:
        first = F.array_position(bits, F.lit(1))
        return F.when(first > 0, F.size(bits) - first + 1).otherwise(F.lit(0).cast("long"))

    return let(mask, measure)


def tail(values: Column, length: Column) -> Column:
    """The last ``length`` elements; an empty array for length 0."""

    def cut(pair: Column) -> Column:
        size = F.size(pair["values"])
        return F.slice(pair["values"], F.greatest(size - pair["length"] + 1, F.lit(1)), pair["length"])

    return let(F.struct(values.alias("values"), length.cast("int").alias("length")), cut)


def indexes(size: Column) -> Column:
    """``0 .. size-1``, empty for size 0 (``sequence`` alone would count down)."""
    return F.when(size > 0, F.sequence(F.lit(0), size.cast("int") - 1)).otherwise(
        F.array().cast("array<int>")
    )


def sublist_positions(values: Column, part: Column) -> Column:
    """Every start index (0-based) at which ``part`` occurs in ``values``, overlaps included."""

    def search(pair: Column) -> Column:
        span = F.size(pair["part"])
        head = F.get(pair["part"], F.lit(0))

        def matches(i: Column) -> Column:
            # The first element decides most places; only then is a slice compared.
            first = F.get(pair["values"], i).eqNullSafe(head) | (span == 0)
            return first & (F.slice(pair["values"], i + 1, span) == pair["part"])

        return F.filter(indexes(F.size(pair["values"]) - span + 1), matches)

    return let(F.struct(values.alias("values"), part.alias("part")), search)


def _run_bounds(bits: Column) -> tuple[Column, Column]:
    """First and last index of every maximal run of ones."""
    at = indexes(F.size(bits))
    on = lambda i: F.coalesce(F.get(bits, i), F.lit(0)) == 1
    return F.filter(at, lambda i: on(i) & ~on(i - 1)), F.filter(at, lambda i: on(i) & ~on(i + 1))


def runs_of_ones(mask: Column) -> Column:
    """Each maximal run of ones as ``struct(start, length)`` with a 0-based start."""
    run = lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length"))
    return let(mask, lambda bits: F.zip_with(*_run_bounds(bits), run))


def pieces_under_mask(tokens: Column, mask: Column) -> Column:
    """The tokens of each maximal run of ones, in order, as an array of arrays."""

    def cut(pair: Column) -> Column:
        return F.zip_with(
            *_run_bounds(pair["mask"]), lambda s, e: F.slice(pair["tokens"], s + 1, e - s + 1)
        )

    return let(F.struct(tokens.alias("tokens"), mask.alias("mask")), cut)


def mask_runs(tokens: Column, mask: Column) -> Column:
    """All maximal runs of equal mask bits, in order, as ``struct(bit, tokens)``."""

    def cut(pair: Column) -> Column:
        bit = lambda i: (F.get(pair["mask"], i) == 1).cast("int")
        size = F.size(pair["mask"])
        firsts = F.filter(indexes(size), lambda i: (i == 0) | (bit(i) != bit(i - 1)))
        ends = F.concat(F.filter(firsts, lambda i: i > 0), F.array(size))
        run = lambda s, e: F.struct(bit(s).alias("bit"), F.slice(pair["tokens"], s + 1, e - s).alias("tokens"))
        return F.when(size > 0, F.zip_with(firsts, ends, run))

    return let(F.struct(tokens.alias("tokens"), mask.alias("mask")), cut)
