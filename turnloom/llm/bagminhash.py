"""Near-duplicate texts by BagMinHash: weighted-Jaccard signatures of word shingles.

A text is a multiset of runs of five words. Over each shingle's weight axis, cut into the
levels [0,1), [1,2), [2,4), [4,8) and so on, a Poisson process in time drops points; a
point counts for a text if it lies below the shingle's weight there, and names one register.
A register keeps its first point, so two texts agree in a register with a chance that is
their weighted Jaccard overlap. Points are drawn in order of time up to a limit at which
most registers are met; texts with open registers go on from there.

Bands of registers give candidates. An estimate from whole signatures drops most false
ones, and links the others into groups; in each group exact overlaps decide. In large
buckets and in groups, texts are first held against one of them, which settles most of a
large group of near copies in one pass; only those left over are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.components import components, forest, possibly, written
from turnloom.llm.texts import map_texts, strings

#: Words of a shingle and the least overlap.
WORDS, LEAST = 5, 0.8
#: Bands and registers of a band: a pair at 0.8 is missed by all bands in 1 of 10,000 cases.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Estimates below this are dropped: four standard errors under the least overlap.
ESTIMATE = 0.65
#: Texts of a block, and up to how many are compared in all registers at once.
BLOCK, FEW = 192, 16
#: Shingles whose points are drawn at a time.
BATCH = 80_000
#: Points of a text are drawn up to the time at which as many as e^-FIRST registers are open on
#: average, then in steps of NEXT; no signature depends on either.
FIRST, NEXT = 1.0, 1.5

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_STEP = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class Shingler:
    """Texts to multisets of hashed shingles; words are what white space separates."""

    def bag(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles in order, and counts. A text of fewer words is one shingle;
        one without words has none."""
        words = text.split()
        n = len(words)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        if not n:
            return h, np.empty(0, np.int64)
        size = min(n, WORDS)
        total = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            total = mix(total * _STEP + h[k : n - size + 1 + k])
        return np.unique(total, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """REGISTERS 16-bit values for each bag; no bag may be empty."""
    out = np.zeros((len(bags), REGISTERS), np.uint16)
    at = 0
    while at < len(bags):
        end, size = at, 0
        while end < len(bags) and (end == at or size + len(bags[end][0]) <= BATCH):
            size += len(bags[end][0])
            end += 1
        out[at:end] = _signatures(bags[at:end])
        at = end
    return out


def _signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    m = REGISTERS
    owner = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    shingle = np.concatenate([h for h, _ in bags])
    weight = np.concatenate([c for _, c in bags])
    totals = np.array([c.sum() for _, c in bags], np.float64)
    # Cells of the weight axis: level 0 is [0,1), level k is [2^(k-1), 2^k).
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    which = np.repeat(np.arange(len(shingle)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    base = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, base, 1.0)
    seed = mix(shingle[which] + level.astype(np.uint64) * _GOLD)
    doc, bound, rate = owner[which], weight[which], m * width
    # Only in cells that the weight ends within does it matter where a point lies.
    ends = base + width > bound
    best = np.full(len(bags) * m, np.inf)
    value = np.zeros(len(bags) * m, np.uint16)
    limit = (np.log(m) + FIRST) / totals

    def waits(point: np.ndarray, cells) -> np.ndarray:
        return np.log(((point >> np.uint64(11)) + 0.5) * 2.0**-53) / rate[cells]

    # Each cell's next point, which lies beyond the limit so far.
    number = np.ones(len(seed), np.uint64)
    point = mix(seed + _ODD)
    time = -waits(point, slice(None))
    while True:
        live = np.flatnonzero(time <= limit[doc])
        while len(live):
            x, t, d = point[live], time[live], doc[live]
            y = mix(x ^ _STEP)
            register = ((y >> np.uint64(48)) * np.uint64(m)) >> np.uint64(16)
            place, hx, ht = d * m + register.astype(np.int64), x, t
            some = np.flatnonzero(ends[live])
            if len(some):
                cells = live[some]
                position = base[cells] + (y[some] & np.uint64(0xFFFFFFFF)) * 2.0**-32 * width[cells]
                hit = np.ones(len(live), bool)
                hit[some] = position < bound[cells]
                place, hx, ht = place[hit], x[hit], t[hit]
            np.minimum.at(best, place, ht)
            won = best[place] == ht
            value[place[won]] = (mix(hx[won] + _GOLD) >> np.uint64(40)).astype(np.uint16)
            number[live] += np.uint64(1)
            x = mix(seed[live] + number[live] * _ODD)
            t = t - waits(x, live)
            point[live], time[live] = x, t
            live = live[t <= limit[d]]
        open_ = np.isinf(best.reshape(len(bags), m)).any(axis=1)
        if not open_.any():
            return value.reshape(len(bags), m)
        limit += NEXT / totals
        more = open_[doc]
        doc, seed, bound, rate, base, width, ends, number, point, time = (
            a[more] for a in (doc, seed, bound, rate, base, width, ends, number, point, time)
        )


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature, the band's number mixed in."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _GOLD, parts.shape[:2])
    for k in range(ROWS):
        keys = mix(keys * _STEP + parts[:, :, k])
    return keys


def sign(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``signature`` (binary, two bytes per register; NULL without words)."""

    def make():
        bag = Shingler().bag

        def work(texts: list[str | None]) -> list:
            bags = [bag(t or "") for t in texts]
            some = [k for k, (h, _) in enumerate(bags) if len(h)]
            out: list[bytes | None] = [None] * len(texts)
            if some:
                for k, row in zip(some, signatures([bags[k] for k in some])):
                    out[k] = row.tobytes()
            return [out]

        return work

    return map_texts(df, keys, text, make, "signature binary")


def _registers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            keys = bands_of(_registers(part.column(1))).view(np.int64)
            rows = np.repeat(np.arange(len(keys)), BANDS)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows)), pa.array(keys.ravel())], ["key", "band"]
            )


def _agreeing(sig: np.ndarray) -> np.ndarray:
    """In how many registers each two of the signatures agree."""
    if len(sig) <= FEW:
        return (sig[:, None] == sig).sum(axis=2)
    same = np.zeros((len(sig), len(sig)), np.int16)
    for k in range(REGISTERS):
        same += sig[:, k, None] == sig[None, :, k]
    return same


def _candidates(table: pa.Table) -> pa.Table:
    """Estimated links of one pair of blocks of one bucket, as links to local roots.

    Settled texts are linked with the bucket's center already, so not with each other.
    """
    keys = table.column("key").to_pylist()
    settled = table.column("settled").to_numpy(zero_copy_only=False)
    sig = _registers(table.column("signature"))
    bands = bands_of(sig).view(np.int64)
    n = len(keys)
    link = _agreeing(sig) >= ESTIMATE * REGISTERS
    # A band in common before the first that all have in common answers for the pair.
    first = int((bands == bands[0]).all(axis=0).argmax())
    if first:
        link &= (bands[:, None, :first] != bands[:, :first]).all(axis=2)
    link &= ~(settled[:, None] & settled[None, :])
    np.fill_diagonal(link, False)
    roots = forest(link)
    some = [k for k in range(n) if roots[k] != k]
    return pa.table(
        {
            "a": pa.array([keys[k] for k in some], pa.binary()),
            "b": pa.array([keys[roots[k]] for k in some], pa.binary()),
        }
    )


def _near_center(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a text's estimate with its bucket's center is high enough."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            own, center = (_registers(part.column(c)) for c in ("signature", "center_signature"))
            flags = (own == center).sum(axis=1) >= ESTIMATE * REGISTERS
            arrays = [part.column(c) for c in ("key", "band", "center")]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(flags)], ["key", "band", "center", "linked"]
            )


def _overlap(a: tuple, b: tuple) -> float:
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / max(a[1].sum() + b[1].sum() - both, 1)


def _with_center(least: float):
    """Whether a text overlaps enough with its group's first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag = Shingler().bag
        last: tuple[str | None, tuple] = (None, ())
        for batch in batches:
            flags = []
            for own, center in zip(strings(batch.column("text")), strings(batch.column("center"))):
                if last[0] != center:
                    last = (center, bag(center))
                flags.append(own == center or _overlap(bag(own), last[1]) >= least)
            arrays = [batch.column(c) for c in ("key", "root")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(flags)], ["key", "root", "linked"])

    return run


def _exact(table: pa.Table, least: float) -> pa.Table:
    """Exact links of one pair of blocks of one group, as a forest.

    A text is compared with all others of the task at once, unless one already stands
    connected with all of them.
    """
    keys = table.column("key").to_pylist()
    bag = Shingler().bag
    bags = [bag(t) for t in table.column("text").to_pylist()]
    n = len(bags)
    shingles = np.concatenate([h for h, _ in bags])
    counts = np.concatenate([c for _, c in bags])
    starts = np.cumsum([0] + [len(h) for h, _ in bags[:-1]])
    totals = np.array([c.sum() for _, c in bags])
    settled = table.column("settled").to_numpy(zero_copy_only=False)
    root = np.arange(n)
    root[settled] = np.flatnonzero(settled)[0] if settled.any() else 0
    pairs = []
    for k in np.flatnonzero(~settled):
        if (root == root[k]).all():
            break
        own, weight = bags[k]
        place = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
        both = np.where(own[place] == shingles, np.minimum(weight[place], counts), 0)
        both = np.add.reduceat(both, starts)
        for j in np.flatnonzero(both >= least * (totals + totals[k] - both)):
            if root[j] != root[k]:
                pairs.append((keys[k], keys[j]))
                root[root == root[j]] = root[k]
    return pa.table(
        {"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())}
    )


def text_key(text: str):
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _unsettled(checked: DataFrame, group: str) -> DataFrame:
    """The groups with members that their center did not settle, and into how many blocks
    both kinds go."""
    return (
        checked.groupBy(group)
        .agg(F.sum((~F.col("linked")).cast("long")).alias("open"), F.count(F.lit(1)).alias("n"))
        .filter("open > 0")
        .select(
            group,
            F.ceil(F.col("open") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("n") - F.col("open")) / BLOCK).cast("int").alias("settled_blocks"),
        )
    )


def _block_pairs(rest: DataFrame, group: str, payload: str) -> DataFrame:
    """``group, settled, low, high, key, payload``: each member of an unsettled group once for
    every pair of blocks that it is needed in: open with open, and open with settled."""
    rest = rest.withColumn("hash", F.xxhash64("key"))
    open_ = rest.filter("NOT linked").withColumn("block", F.pmod("hash", "blocks").cast("int"))
    among = open_.withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    ).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    open_side = open_.withColumn("low", F.col("block")).withColumn(
        "high", F.explode(F.sequence(F.lit(-1), -F.col("settled_blocks"), F.lit(-1)))
    )
    settled = (
        rest.filter("linked")
        .withColumn("high", (-1 - F.pmod("hash", "settled_blocks")).cast("int"))
        .withColumn("low", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    sides = [
        side.select(group, F.lit(done).alias("settled"), "low", "high", "key", payload)
        for side, done in ((among, False), (open_side, False), (settled, True))
    ]
    return sides[0].union(sides[1]).union(sides[2])


def _estimated_links(reps: DataFrame, banded: DataFrame) -> DataFrame:
    """``a, b``: links whose components are those of all estimates of ESTIMATE or more
    between texts that share a band."""
    signed = reps.select("key", "signature")
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(banded.join(sizes, "band").select("key", "band", "n"), "shared-bands")
    # Near copies share many bands: the same texts are compared once, not in each of these.
    small = (
        shared.filter(F.col("n") <= BLOCK)
        .groupBy("band")
        .agg(F.sort_array(F.collect_list("key")).alias("keys"))
        .groupBy("keys")
        .agg(F.min("band").alias("band"))
        .select("band", F.explode("keys").alias("key"))
        .join(signed, "key")
        .select("band", F.lit(False).alias("settled"), F.lit(0).alias("low"), F.lit(0).alias("high"), "key", "signature")
    )
    large = shared.filter(F.col("n") > BLOCK).select("key", "band")
    centers = large.groupBy("band").agg(F.min("key").alias("center"))
    centers = centers.join(
        signed.select(F.col("key").alias("center"), F.col("signature").alias("center_signature")), "center"
    )
    checked = written(
        large.join(signed, "key")
        .join(centers, "band")
        .select("key", "band", "center", "signature", "center_signature")
        .mapInArrow(_near_center, "key binary, band long, center binary, linked boolean"),
        "large-checked",
    )
    rest = checked.join(_unsettled(checked, "band"), "band").join(signed, "key")
    compared = (
        small.union(_block_pairs(rest, "band", "signature"))
        .groupBy("band", "low", "high")
        .applyInArrow(_candidates, "a binary, b binary")
    )
    stars = checked.filter("linked AND key <> center").select(F.col("key").alias("a"), F.col("center").alias("b"))
    return compared.union(stars)


def text_classes(df: DataFrame, key: str, text: str, least: float = LEAST) -> DataFrame:
    """``text_key, root`` of the texts that have a near-duplicate text; ``root`` is the same
    for all texts connected by overlaps of ``least`` or more."""
    rows = df.select(text_key(text).alias("key"), F.col(key).alias("id"), F.col(text).alias("text"))
    signed = sign(rows, ["key", "id"], "text").filter("signature IS NOT NULL")
    reps = written(
        signed.groupBy("key").agg(F.first("signature").alias("signature"), F.min("id").alias("id")),
        "signatures",
    )
    banded = written(reps.mapInArrow(_explode_bands, "key binary, band long"), "bands")
    groups = written(components(_estimated_links(reps, banded), "candidates"), "groups")
    # Texts of the groups, once each, from the row of the least id: copies stay apart. From
    # here on all tables are of suspects only.
    wanted = groups.join(reps.select("key", "id"), "key").select(F.col("key").alias("k"), F.col("id").alias("i"), "root")
    wanted = written(wanted, "wanted")
    asked = rows.filter(possibly(wanted, "k", "i")("key", "id"))
    suspects = asked.join(wanted, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")))
    suspects = suspects.groupBy("key", "root").agg(F.first("text").alias("text"))
    suspects = written(suspects, "suspects")
    centers = suspects.filter("key = root").select("root", F.col("text").alias("center"))
    checked = written(
        suspects.join(centers, "root")
        .select("key", "root", "text", "center")
        .mapInArrow(_with_center(least), "key binary, root binary, linked boolean"),
        "checked",
    )
    rest = suspects.join(checked.select("key", "linked"), "key").join(_unsettled(checked, "root"), "root")
    exact = (
        _block_pairs(rest, "root", "text")
        .groupBy("root", "low", "high")
        .applyInArrow(lambda table: _exact(table, least), "a binary, b binary")
    )
    stars = checked.filter("linked AND key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))
    return components(stars.union(exact), "near-texts").withColumnRenamed("key", "text_key")


def near_texts(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """``key, text_key, class_id, kept``: near-duplicate classes of all rows.

    Rows are linked if their texts are equal, or overlap in ``least`` of their five-word
    shingles, counted with multiplicity; classes are what links connect. ``class_id`` is the
    least key of the class, and only rows with that key and that key's least text are
    ``kept``; repeated rows of it alike. NULL texts and texts without words are classes of
    their own, even where equal, and kept. NULL keys count as larger than others. An empty
    table gives none; other columns are not read.
    """
    rows = df.select(
        F.col(key).alias("id"), F.when(F.coalesce(F.col(text), F.lit("")).rlike(r"\S"), text_key(text)).alias("text_key")
    )
    roots = text_classes(df.filter(F.col(text).isNotNull()), key, text, least)
    texts = written(
        rows.filter("text_key IS NOT NULL").groupBy("text_key").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n")),
        "texts",
    )
    classed = texts.join(roots, "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    heads = classed.groupBy("root").agg(
        F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "text_key")).alias("head")
    )
    answers = classed.join(heads, "root").select(
        "text_key",
        F.col("head.least_id").alias("class_id"),
        (F.col("text_key") == F.col("head.text_key")).alias("head_text"),
    )
    joined = rows.join(answers, "text_key", "left")
    return joined.select(
        F.col("id").alias(key),
        "text_key",
        F.coalesce("class_id", "id").alias("class_id"),
        F.when(F.col("head_text").isNull(), True)
        .otherwise(F.col("head_text") & F.col("class_id").eqNullSafe(F.col("id")))
        .alias("kept"),
    )
