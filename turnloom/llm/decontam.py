"""Benchmark decontamination by template windows.

Texts are brought to a canonical form in which numbers, units after numbers, and names
become typed placeholders; a re-parameterised question keeps its form. Windows of eight
words are hash-joined with those of the benchmark, in up to four forms: as they are but for
letter case, with placeholders for numbers and units, for names too, and for capitalised
words at the start of a sentence too, which may be names. A bitmap of fixed size, made
from the benchmark's windows, first drops nearly all windows of the documents. Matches
of a document and an item count along one alignment, and only if the placeholders agree:
each value in the item must stand for one value in the document throughout.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.bagminhash import _M1, _M2, mix
from turnloom.llm.components import written
from turnloom.llm.texts import forget, strings
from turnloom.llm.transducer import Memo

#: Canonical words of a window, and of an aligned match at least (or the whole item).
WINDOW, LEAST = 8, 13
#: Words that must agree as they are where an item is shorter than a window.
LITERAL = 5
#: Items up to which a window is joined with each; what more items share is joined once, as their stem.
COMMON = 64
#: Bits of the bitmap, as a power of two: 2 MB whatever the benchmark's size.
BITS = 24
#: Placeholders a window may have at most, else it counts in its literal form only; the
#: others pin it to its template.
MOST_SLOTS = WINDOW // 2

WORD, NUMBER, UNIT, NAME, END, SKIP = range(6)
# Unit words that count as one after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres "
    "kilometer kilometers kilometre kilometres g kg mg lb lbs oz gram grams kilogram kilograms ton tons "
    "tonne tonnes pound pounds ounce ounces l ml liter liters litre litres gallon gallons cup cups s sec "
    "secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year "
    "years usd eur dollar dollars euro euros cent cents percent pct degree degrees mph kph watt watts volt "
    "volts joule joules".split()
)
NUMERIC = re.compile(r"[^\w]*\d[\d.,:/-]*(?:st|nd|rd|th|%)?[^\w]*|[^\w]*[$€£]\d[\d.,]*[^\w]*")
NO_LETTER = re.compile(r"[\W_]+")
HOLDER = {NUMBER: np.uint64(0x1B873593A1), UNIT: np.uint64(0x2545F4914F), NAME: np.uint64(0x38495AB5C7)}
_STEP = np.uint64(0xA0761D6478BD642F)
_ALL = (1 << 64) - 1

#: Longer words, and words with characters beyond the first TABLE, are looked at one by one.
LONGEST, TABLE = 64, 0x800
#: Characters of a text that are looked at together.
PIECE = 1 << 16


class Letters:
    """What is known of the first TABLE characters, and in the last place, of all others."""

    def __init__(self) -> None:
        self.value = np.zeros(TABLE + 1, np.uint64)
        self.upper, self.mark, self.stop = np.zeros((3, TABLE + 1), bool)
        # A letter counts 1 in the lower half, and if it is none of capitals only, 1 in the upper.
        self.count = np.zeros(TABLE + 1, np.int64)
        hashes = mix(np.arange(1, TABLE + 1, dtype=np.uint64) * _STEP)
        for code, c in enumerate(map(chr, range(TABLE))):
            low = c.lower()
            # A capital sigma has two small forms; what has several letters' form stands alone.
            if c.isalpha() and c != "Σ" and len(low) == 1 and ord(low) < TABLE and low.isalpha() and low.lower() == low:
                self.value[code] = hashes[ord(low)]
                self.upper[code] = c.isupper()
                self.count[code] = 1 + ((c.islower() or (c.istitle() and not c.isupper())) << 32)
        for c in ".,;:!?":
            self.mark[ord(c)], self.stop[ord(c)] = True, c in ".!?:"
        small = [chr(k) for k in range(TABLE) if self.value[k] and chr(k).lower() == chr(k)]
        self.small = {c: int(self.value[ord(c)]) for c in small}


LETTERS = Letters()


def hashed(low: str) -> int:
    """64 bits that stand for a word in small letters: as ``Templater.pieces`` makes them of many
    words at once, where it can."""
    total = 0
    if len(low) <= LONGEST:
        for c in reversed(low):
            value = LETTERS.small.get(c)
            if value is None:
                break
            total = (total * int(_STEP) + value) & _ALL
        else:
            total = (total ^ total >> 30) * int(_M1) & _ALL
            total = (total ^ total >> 27) * int(_M2) & _ALL
            return total ^ total >> 31
    return xxhash.xxh3_64_intdigest(low)


UNIT_VALUES = frozenset(hashed(u) >> 5 for u in UNITS)


def token(raw: str) -> tuple[int, int, bool, bool]:
    """Kind, hash of the canonical word, whether it begins with a capital, and whether it ends
    a sentence."""
    if raw == "\n" or not raw:
        return (END if raw else SKIP), 0, False, True
    # Nearly all tokens are letters only, or letters and a mark; the rest take longer.
    stem = raw if raw.isalpha() else raw[:-1]
    if stem.isalpha() and (stem is raw or raw[-1] in ".,;:!?"):
        low = stem.lower()
        capital = stem[0].isupper() and (len(stem) == 1 or not stem.isupper())
        return (UNIT if low in UNITS else WORD), hashed(low), capital, raw[-1] in ".!?:"
    ends = raw.rstrip("\"')]”’»*_#$&%!|")[-1:] in ".!?:" or raw[-1] in ".!?:"
    if NUMERIC.fullmatch(raw):
        return NUMBER, xxhash.xxh3_64_intdigest(raw.strip(".,;:!?()\"'")), False, ends
    word = NO_LETTER.sub("", raw)
    if not word:
        return (END if ends else SKIP), 0, False, ends
    low = word.lower()
    # Words all in capitals are shouted, not names.
    capital = word[0].isupper() and (len(word) == 1 or not word.isupper())
    return (UNIT if low in UNITS else WORD), hashed(low), capital, ends


class Canonical(NamedTuple):
    """A text's words: hash of each one's value, its kind, and whether it is a possible name,
    as it has a capital but begins a sentence or line."""

    value: np.ndarray
    kind: np.ndarray
    first: np.ndarray


class Windows(NamedTuple):
    """Windows of one form: places, hashes, which words of the text are placeholders, and
    whether possible names are among these."""

    at: np.ndarray
    hash: np.ndarray
    slot: np.ndarray
    loose: bool


class Templater:
    def __init__(self) -> None:
        self.tokens = Memo(self._token, 120_000)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _token(raw: str) -> int:
        """The hash's upper 59 bits and five bits of what is known of the token."""
        kind, value, capital, ends = token(raw)
        return value >> 5 << 5 | kind | capital << 3 | ends << 4

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        """For each token between spaces, what ``_token`` gives for it; lines' ends are tokens, too."""
        begin = 0
        while begin < len(text):
            end = len(text)
            if end - begin > PIECE:
                cut = text.rfind(" ", begin, begin + PIECE)
                if cut < 0:
                    cut = text.find(" ", begin + PIECE)
                end = cut + 1 or end
            yield self.codes(text[begin:end])
            begin = end

    def codes(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.minimum(code, TABLE).astype(np.intp)
        line = code == ord("\n")
        inside = (code != ord(" ")) & ~line
        starts, lasts = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        lasts[:-1] &= ~inside[1:]
        start, last = np.flatnonzero(starts | line), np.flatnonzero(lasts | line)
        if not len(start):
            return np.empty(0, np.uint64)
        # Nearly all tokens are letters only, or letters and a mark; the rest take longer.
        up, down = self.powers(len(code))
        hashes = mix(np.add.reduceat(LETTERS.value[code] * up, start) * down[start])
        count = np.add.reduceat(LETTERS.count[code], start)
        letters, length, final = count & 0xFFFFFFFF, last + 1 - start, code[last]
        plain = (letters == length) | ((letters == length - 1) & LETTERS.mark[final] & (length > 1))
        plain &= length <= LONGEST
        capital = LETTERS.upper[code[start]] & ((letters == 1) | (count >> 32 > 0))
        known = capital.astype(np.uint64) << np.uint64(3) | LETTERS.stop[final].astype(np.uint64) << np.uint64(4)
        out = hashes >> np.uint64(5) << np.uint64(5) | known
        line = line[start]
        out[line] = END | 1 << 4
        others = np.flatnonzero(~plain & ~line)
        if len(others):
            raw = [text[a:b] for a, b in zip(start[others].tolist(), (last[others] + 1).tolist())]
            out[others] = np.fromiter(map(self.tokens.__getitem__, raw), np.uint64, len(raw))
        return out

    def canonical(self, text: str) -> Canonical:
        code = np.concatenate([np.empty(0, np.uint64), *self.pieces(text)])
        low = code.astype(np.uint8) & 31
        kind = low & 7
        ends = (low & 16) > 0
        # What stands before each word, blanks skipped: a sentence's end, or a number.
        keep = kind != SKIP
        code, kind, ends, capital = code[keep], kind[keep], ends[keep], (low[keep] & 8) > 0
        starts = np.ones(len(code), bool)
        starts[1:] = ends[:-1]
        real = kind != END
        after = np.zeros(len(code), bool)
        after[1:] = kind[:-1] == NUMBER
        kind = np.where((kind == UNIT) & ~after, WORD, kind)
        for k in np.flatnonzero(after & (kind == WORD)).tolist():
            if int(code[k]) >> 5 in UNIT_VALUES:
                kind[k] = UNIT
        capital &= kind == WORD
        kind = np.where(capital & ~starts, NAME, kind)
        return Canonical(code[real] >> np.uint64(5), kind[real], (capital & starts)[real])

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of _STEP and of its inverse, n of each."""
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, step, np.uint64)]))
                for step in (_STEP, np.uint64(pow(int(_STEP), -1, 1 << 64)))
            )
        return self.up[:n], self.down[:n]

    def windows(self, words: Canonical, size: int) -> Iterator[Windows]:
        """The windows in each form in which they differ from the forms before: literal, with
        numbers and units as placeholders, with names too, with possible names too."""
        n = len(words.value) - size + 1
        if n < 1:
            return
        up, down = self.powers(len(words.value))
        number = (words.kind == NUMBER) | (words.kind == UNIT)
        name = words.kind == NAME
        shape, slot = words.value.copy(), np.zeros(len(words.value), bool)
        for form, fresh in enumerate((slot, number, name, words.first)):
            if form and not fresh.any():
                continue
            slot = slot | fresh
            shape[fresh] = HOLDER[NAME]
            if form == 1:
                shape[words.kind == NUMBER] = HOLDER[NUMBER]
                shape[words.kind == UNIT] = HOLDER[UNIT]
            at = np.arange(n)
            if form:
                new, held = (np.concatenate([[0], np.cumsum(x)]) for x in (fresh, slot))
                held = held[size:] - held[:-size]
                at = np.flatnonzero((new[size:] > new[:-size]) & (held <= MOST_SLOTS * size // WINDOW))
            total = np.zeros(len(shape) + 1, np.uint64)
            np.cumsum(shape * up, out=total[1:])
            h = mix((total[at + size] - total[at]) * down[at] + np.uint64(size))
            yield Windows(at, h, slot, form == 3)

    def between(self, words: Canonical, size: int) -> Iterator[Windows]:
        """Windows with several possible names, some of them taken as names and some not."""
        up, _ = self.powers(size)
        for at in range(len(words.value) - size + 1):
            first = np.flatnonzero(words.first[at : at + size]) + at
            for some in range(1, (1 << len(first)) - 1):
                slot = words.kind != WORD
                slot[first[[some >> k & 1 > 0 for k in range(len(first))]]] = True
                if slot[at : at + size].sum() > MOST_SLOTS * size // WINDOW:
                    continue
                shape = words.value[at : at + size].copy()
                shape[slot[at : at + size]] = HOLDER[NAME]
                for which in (NUMBER, UNIT):
                    shape[words.kind[at : at + size] == which] = HOLDER[which]
                h = mix((shape * up).sum(dtype=np.uint64, keepdims=True) + np.uint64(size))
                yield Windows(np.array([at]), h, slot, True)


def _emit(df: DataFrame, key: str, text: str, sizes: list[int], bitmap, whole: bool) -> DataFrame:
    """One row per form of a window that passes the bitmap: key, copy of the text, place, hash,
    slots, and whether these hold possible names.

    With ``whole``, texts shorter than a window give one window of their own length.
    """
    key_type = df.schema[key].dataType.simpleString()
    schema = f"id {key_type}, text_hash long, n_words int, at int, window long, slots array<long>, loose boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        maker = Templater()
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            owner, digest, n_words, ats, hashes, slots, loose = [], [], [], [], [], [], []
            for row, text in enumerate(strings(batch.column(1))):
                words = maker.canonical(text or "")
                n = len(words.value)
                own, sha = sizes, None
                if whole:
                    own = [min(n, WINDOW)] if n else []
                for size in own:
                    forms = maker.windows(words, size)
                    for form in chain(forms, maker.between(words, size)) if whole else forms:
                        good = np.ones(len(form.at), bool)
                        if bits is not None:
                            place = form.hash >> np.uint64(64 - BITS)
                            good = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                        if sha is None and good.any():
                            sha = xxhash.xxh3_64_intdigest(text) >> 1
                        for at, h in zip(form.at[good].tolist(), form.hash[good]):
                            owner.append(row)
                            n_words.append(n)
                            ats.append(at)
                            hashes.append(h)
                            digest.append(sha)
                            where = np.flatnonzero(form.slot[at : at + size]) + at
                            slots.append(words.value[where].astype(np.int64).tolist())
                            loose.append(form.loose)
            if owner or whole:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner, pa.int64())),
                        pa.array(digest, pa.int64()),
                        pa.array(n_words, pa.int32()),
                        pa.array(ats, pa.int32()),
                        pa.array(np.array(hashes, np.uint64).view(np.int64)),
                        pa.array(slots, pa.list_(pa.int64())),
                        pa.array(loose, pa.bool_()),
                    ],
                    ["id", "text_hash", "n_words", "at", "window", "slots", "loose"],
                )
        batch = None
        pa.default_memory_pool().release_unused()

    return df.select(key, text).mapInArrow(run, schema)


def _bitmap(windows: DataFrame) -> bytes:
    """The windows' upper bits, as a bitmap of fixed size, whatever their number."""
    place = F.shiftrightunsigned("window", 64 - BITS)
    words = (
        windows.select((F.shiftrightunsigned(place, 3)).alias("byte"), F.pmod(place, F.lit(8)).cast("int").alias("bit"))
        .groupBy("byte")
        .agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("bits"))
    )
    out = np.zeros(1 << (BITS - 3), np.uint8)
    table = words.toArrow()
    out[table.column("byte").to_numpy()] = table.column("bits").to_numpy().astype(np.uint8)
    return out.tobytes()


def _targets(items: DataFrame, common: int) -> tuple[DataFrame, DataFrame]:
    """What documents' windows are joined with, and the items of each stem.

    A window of at most ``common`` items is joined with these. An item's windows that more items
    share are its stem, which all items with the same ones at the same distances have together: a
    stem is one target, however many items have it, and its places count from its first window.
    """
    many = items.select("window", "item", "item_words").distinct().groupBy("window").count()
    many = many.filter(F.col("count") > common).select("window", F.lit(True).alias("many"))
    marked = items.join(many, "window", "left")
    spot = F.struct("item_at", "window", "item_slots", "item_loose")
    spots = F.sort_array(F.collect_set(spot))
    # Only up to LEAST does an item's length matter to what holds it.
    length = F.least("item_words", F.lit(LEAST))
    stems = (
        marked.filter("many")
        .groupBy("item", "item_words")
        .agg(F.min("item_at").alias("begin"), spots.alias("spots"))
        .withColumn("spots", F.transform("spots", lambda x: x.withField("item_at", x["item_at"] - F.col("begin"))))
        .withColumn("stem", F.sha2(F.to_json(F.struct(length.alias("length"), "spots")), 256))
    )
    shared = stems.groupBy("stem").agg(F.first("spots").alias("spots"), F.first(length).alias("item_words"))
    shared = shared.select("stem", "item_words", F.inline("spots"))
    alone = marked.filter("many IS NULL").drop("many").withColumn("stem", F.lit(None).cast("string"))
    return alone.unionByName(shared, allowMissingColumns=True), stems.select("item", "item_words", "begin", "stem")


def _aligned(found: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per document's text, target and shift, with the matches: ``sure``, and ``all``."""
    # Copies of a window within one text and repeated rows meet here; most windows have no partner.
    # An item of few words says little: unless the document is nothing but it, five must agree.
    few = F.col("item_words") - F.size("item_slots") < LITERAL
    enough = (F.col("item_words") >= WINDOW) | ~few | (F.col("n_words") == F.col("item_words"))
    matched = found.join(targets, "window").filter(enough).select(
        "id",
        "text_hash",
        "item",
        "stem",
        "item_words",
        "item_at",
        (F.col("at") - F.col("item_at")).alias("shift"),
        F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("ours")).alias("pairs"),
        (~(F.col("loose") | F.col("item_loose"))).alias("sure"),
    )
    sure = F.when(F.col("sure"), F.struct("item_at", "pairs"))
    return matched.groupBy("id", "text_hash", "item", "stem", "item_words", "shift").agg(
        F.collect_set(sure).alias("sure"), F.collect_set(F.struct("item_at", "pairs")).alias("all")
    )


def _whole(aligned: DataFrame, stems: DataFrame) -> DataFrame:
    """Alignments with items only. A stem's matches go to the items that match elsewhere, too, and, where
    the stem alone is enough to hold an item, to all that have it: no other item can be held."""
    group = ["id", "text_hash", "item", "item_words", "shift"]
    own, shared = aligned.filter("stem IS NULL").drop("stem"), aligned.filter("stem IS NOT NULL")
    shared = shared.drop("item", "item_words")
    of = stems.select(F.col("item").alias("_item"), F.col("item_words").alias("_words"), "begin", "stem")

    def placed(matches: str):
        return F.transform(matches, lambda m: m.withField("item_at", m["item_at"] + F.col("begin"))).alias(matches)

    at = own.select(*group).join(of, F.col("item").eqNullSafe(F.col("_item")) & (F.col("item_words") == F.col("_words")))
    at = at.select(
        F.col("id").alias("_id"), "text_hash", "item", "item_words", (F.col("shift") + F.col("begin")).alias("shift"), "stem", "begin"
    )
    beside = shared.join(at, ["text_hash", "stem", "shift"]).filter(F.col("id").eqNullSafe(F.col("_id")))
    enough = _held(aligned.filter("stem IS NOT NULL").drop("item").withColumnRenamed("stem", "item"))
    enough = enough.select(F.col("id").alias("_id"), "text_hash", F.col("item").alias("stem"), "shift").distinct()
    alone = shared.join(enough, ["text_hash", "stem", "shift"]).filter(F.col("id").eqNullSafe(F.col("_id")))
    alone = alone.join(of.withColumnsRenamed({"_item": "item", "_words": "item_words"}), "stem")
    columns = ["id", "text_hash", "item", "item_words", (F.col("shift") - F.col("begin")).alias("shift"), placed("sure"), placed("all")]
    parts = own.select(*group, "sure", "all").union(beside.select(*columns)).union(alone.select(*columns))
    joined = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("sure", "all")]
    return parts.groupBy(*group).agg(*joined)


def _held(aligned: DataFrame) -> DataFrame:
    """The alignments that hold their item."""
    # Matches that need possible names may add to an alignment; if their values clash, it
    # stands or falls by the others.
    aligned = aligned.withColumn("matches", F.explode(F.array("sure", "all"))).select(
        "id",
        "text_hash",
        "item",
        "item_words",
        "shift",
        F.size(F.array_distinct(F.transform("matches", lambda m: m["item_at"]))).cast("long").alias("n_windows"),
        F.array_distinct(F.flatten(F.transform("matches", lambda m: m["pairs"]))).alias("pairs"),
    )
    theirs = F.array_distinct(F.transform("pairs", lambda p: p["theirs"]))
    covered = F.col("n_windows") + F.least("item_words", F.lit(WINDOW)) - 1
    return aligned.filter(
        (F.col("n_windows") > 0)
        & (covered >= F.least("item_words", F.lit(LEAST)))
        & (F.size("pairs") == F.size(theirs))
    ).select(
        "id", "text_hash", "item", "n_windows", covered.alias("n_words"), F.size("pairs").cast("long").alias("n_slots"), "shift"
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    common: int = COMMON,
) -> DataFrame:
    """``key, item, n_windows, n_words, n_slots``: documents that hold a benchmark item.

    A row says that one alignment of the document with the item has so many matching
    windows, which cover at least LEAST words (or the item, where it is shorter), and that
    its ``n_slots`` distinct placeholder values stand for one value each. The best
    alignment of a pair is given, the first of equals. A window may match as it is, whatever
    its letter case and however many numbers or names it holds, or by its template. An item
    shorter than a window is held only with LITERAL of its words as they are, or by a document
    that has no other words: ``yes`` does not mark every text with that word. Windows that more than
    ``common`` items share are joined once for all items that have the same ones, and their matches
    go to items only where these match elsewhere or are held by them; ``common`` changes no result. Repeated rows of a document give one
    row; the same id with several texts is one document that holds what any of them does. NULL and
    empty texts hold nothing, empty items are never held, an empty table gives none; other
    columns are not read, but keys and texts may have any name.
    """
    spark = docs.sparkSession
    items = _emit(benchmark.select(F.col(item).alias("_i"), F.col(item_text).alias("_t")), "_i", "_t", [], None, True)
    items = written(
        items.select(
            F.col("id").alias("item"),
            F.col("n_words").alias("item_words"),
            F.col("at").alias("item_at"),
            "window",
            F.col("slots").alias("item_slots"),
            F.col("loose").alias("item_loose"),
        ),
        "items",
    )
    short = [r["n"] for r in items.select(F.least("item_words", F.lit(WINDOW)).alias("n")).distinct().collect()]
    bitmap = spark.sparkContext.broadcast(_bitmap(items))
    found = _emit(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), "_k", "_t", sorted(short), bitmap, False)
    targets, stems = _targets(items, common)
    aligned = written(_aligned(found, targets), "aligned")
    held = _held(_whole(aligned, stems))
    best = held.groupBy("id", "item").agg(
        F.max(F.struct("n_windows", -F.col("shift"), F.col("n_words"), F.col("n_slots"))).alias("best")
    )
    return best.select(
        F.col("id").alias(key),
        F.col("item").alias(item),
        F.col("best.n_windows").alias("n_windows"),
        F.col("best.n_words").cast("long").alias("n_words"),
        F.col("best.n_slots").alias("n_slots"),
    )
