"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A three-letter
window is bound into one vector: the letters' vectors, permuted by their place, are
multiplied. A text bundles (adds) its windows' vectors, a language those of its training
texts; both are compared by cosine. Profiles are centred on their mean, which all
languages share. A text's own length divides all its cosines alike, so the text's vector
is never built: the dot product of its bundle with a profile is the sum of its windows'
dot products, and each distinct window's is computed once. All sums are of integers, so
results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.texts import forget, map_texts, strings

#: Dimensions, letters of a window, and characters that are worked on at a time.
SIZE, LETTERS, BLOCK = 1024, 3, 1 << 19
#: Windows that are bound at a time: 8 MB of their vectors.
BOUND = 1024
UNKNOWN = "und"
#: Profiles are scaled to this length and rounded, so that dot products are integers.
SCALE = 1 << 20


class Profiles(NamedTuple):
    languages: tuple[str, ...]
    vectors: np.ndarray  # one row per language, int64


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), dtype=np.bool_)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point: bits of a counter-based hash."""
    n = np.arange(SIZE // 64, dtype=np.uint64)
    x = points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + n * np.uint64(
        0xD1B54A32D192ED03
    )
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def bind(windows: np.ndarray) -> np.ndarray:
    """One vector per window of code points (rows of LETTERS): permuted and multiplied."""
    letters, where = np.unique(windows, return_inverse=True)
    table, where = letter_vectors(letters), where.reshape(windows.shape)
    out = table[where[:, -1]]
    for back in range(1, LETTERS):
        out = out * np.roll(table, back, axis=1)[where[:, -1 - back]]
    return out


class Windows(NamedTuple):
    """Distinct windows of a block, the number of each window in order, and each text's
    first and one past its last window."""

    distinct: np.ndarray
    order: np.ndarray
    bounds: np.ndarray


def windows_of(texts: list[str]) -> Windows:
    """Lower-case letters; whatever lies between, and at both ends, is one blank."""
    sizes, parts = [], []
    for text in texts:
        lower = f" {text.lower()} "
        sizes.append(len(lower))
        parts.append(lower)
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letter_table()[points]
    ends = np.cumsum(sizes)
    first = np.zeros(len(points), bool)
    first[ends[:-1]] = True
    first[0] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep |= first
    points = np.where(letter, points, 32)[keep]
    ends = np.cumsum(keep)[ends - 1]
    starts = np.concatenate([[0], ends[:-1]])
    # A dense code per letter, then per window.
    present = np.zeros(0x110000, np.int32)
    present[points] = 1
    alphabet = np.flatnonzero(present)
    present[alphabet] = np.arange(len(alphabet))
    code = present[points].astype(np.int64)
    k, n = len(alphabet), len(code)
    grams = code[: n - 2] * k * k + code[1 : n - 1] * k + code[2:] if n > 2 else code[:0]
    if k**LETTERS <= 1 << 22:
        seen = np.zeros(k**LETTERS, np.int32)
        seen[grams] = 1
        distinct = np.flatnonzero(seen)
        seen[distinct] = np.arange(len(distinct))
        order = seen[grams]
    else:
        distinct, order = np.unique(grams, return_inverse=True)
    rows = alphabet[np.stack([distinct // (k * k), distinct // k % k, distinct % k], axis=1)]
    bounds = np.stack([starts, np.maximum(ends - LETTERS + 1, starts)], axis=1)
    # Texts without a window at the end begin after the last one.
    return Windows(rows, order, np.minimum(bounds, len(order)))


def blocks(texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Places and texts, up to BLOCK characters at a time; a longer text in overlapping parts."""
    places, parts, size = [], [], 0
    for place, text in enumerate(texts):
        text = text or ""
        for at in range(0, max(len(text), 1), BLOCK):
            part = text[max(at - LETTERS + 1, 0) : at + BLOCK]
            if size and size + len(part) > BLOCK:
                yield places, parts
                places, parts, size = [], [], 0
            places.append(place)
            parts.append(part)
            size += len(part)
    if places:
        yield places, parts


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for places, parts in blocks(strings(batch.column(0))):
            w = windows_of(parts)
            names = [langs[p] for p in places]
            own = sorted(set(names))
            counts = np.zeros((len(own), len(w.distinct)))
            for k, name in enumerate(own):
                runs = [w.order[a:b] for n, (a, b) in zip(names, w.bounds) if n == name]
                counts[k] = np.bincount(np.concatenate(runs), minlength=len(w.distinct))
            for at in range(0, len(w.distinct), BOUND):
                made = counts[:, at : at + BOUND] @ bind(w.distinct[at : at + BOUND]).astype(float)
                for name, part in zip(own, np.rint(made).astype(np.int64)):
                    sums[name] = sums.get(name, 0) + part
    for name, total in sums.items():
        yield pa.RecordBatch.from_pydict(
            {"language": [name] * SIZE, "at": list(range(SIZE)), "value": total}
        )


def train(df: DataFrame, text: str = "text", language: str = "lang") -> Profiles:
    """Profiles from all rows with a text and a language.

    Tasks send one vector per language; the driver gets their sums, SIZE numbers each.
    """
    rows = df.select(text, language).filter(F.col(text).isNotNull() & F.col(language).isNotNull())
    parts = rows.mapInArrow(_train, "language string, at long, value long")
    summed = parts.groupBy("language", "at").agg(F.sum("value").alias("value")).collect()
    names = tuple(sorted({r["language"] for r in summed}))
    vectors = np.zeros((len(names), SIZE))
    for r in summed:
        vectors[names.index(r["language"]), r["at"]] = r["value"]

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    if len(names) > 1:
        vectors = scaled(vectors)
        vectors = vectors - vectors.mean(axis=0)
    return Profiles(names, np.rint(scaled(vectors) * SCALE).astype(np.int64))


class Judge:
    """Languages and scores of texts by fixed profiles; keeps the windows it has met."""

    MOST = 150_000

    def __init__(self, profiles: Profiles) -> None:
        self.languages = profiles.languages
        self.vectors = profiles.vectors.astype(np.float64)
        self.known = np.empty(0, np.int64)
        self.dots = np.empty((0, len(self.languages)), np.int64)

    def products(self, windows: np.ndarray) -> np.ndarray:
        """The dot product of each window with each profile."""
        keys = (windows[:, 0] << 42) | (windows[:, 1] << 21) | windows[:, 2]
        fresh = np.setdiff1d(keys, self.known)
        if len(fresh):
            if len(self.known) > self.MOST:
                self.known, self.dots, fresh = self.known[:0], self.dots[:0], np.unique(keys)
            low = (1 << 21) - 1
            rows = np.stack([fresh >> 42, fresh >> 21 & low, fresh & low], axis=1)
            made = [
                np.rint(bind(rows[k : k + BOUND]).astype(np.float64) @ self.vectors.T)
                for k in range(0, len(rows), BOUND)
            ]
            keys_all = np.concatenate([self.known, fresh])
            order = np.argsort(keys_all)
            self.known = keys_all[order]
            self.dots = np.concatenate([self.dots, np.concatenate(made).astype(np.int64)])[order]
        return self.dots[np.searchsorted(self.known, keys)]

    def totals(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for places, parts in blocks(texts):
            w = windows_of(parts)
            if not len(w.order):
                continue
            dots = self.products(w.distinct)
            for k in range(len(self.languages)):
                upto = np.concatenate([[0], np.cumsum(dots[:, k][w.order])])
                np.add.at(out[:, k], places, upto[w.bounds[:, 1]] - upto[w.bounds[:, 0]])
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        totals = self.totals(texts)
        best = totals.argmax(axis=1)
        positive = np.maximum(totals, 0).astype(np.float64)
        share = positive.max(axis=1) / np.maximum(positive.sum(axis=1), 1.0)
        known = [any(map(str.isalpha, t)) if t else False for t in texts]
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return names, [float(s) if k else 0.0 for s, k in zip(share, known)]


def identify(df: DataFrame, profiles: Profiles, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, lang_pred, score``: the language of the largest cosine, and its share of the
    positive cosines. ``und`` and 0 for NULL, empty and letterless texts, and without profiles.
    Ties go to the first language by name. No shuffle."""

    def make():
        judge = Judge(profiles)
        return lambda texts: list(judge.judge(texts))

    return map_texts(df, keys, text, make, "lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    """Rows never learned from: CRC-32 of the key as text, divisible by 5; never NULL."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_ids(
    df: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang"
) -> DataFrame:
    """``key, held_out, lang_pred, score``, learned from the rows that are not held out.

    Rows with a NULL text or language are not learned from but are answered. An empty
    table, or one without languages, teaches nothing: all answers are ``und``. Repeated
    rows count each; other columns are not read.
    """
    profiles = train(df.filter(~held_out(key)), text, language)
    marked = df.select(key, text, held_out(key).alias("_held"))
    found = identify(marked, profiles, [key, "_held"], text)
    return found.withColumnRenamed("_held", "held_out")
