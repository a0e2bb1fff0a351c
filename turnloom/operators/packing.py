"""Epochs of random order, and packs of samples within a token budget."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.operators.order import BUCKET_DIGITS, with_dense_index
from turnloom.operators.turns import same
from turnloom.session import stored

#: Rows that are packed together, one after the other; a pack never crosses them.
BLOCK = 256


#: Rows that are packed together by size, and units whose ranks are levelled together.
SHARD, FAN = 8192, 256


def epochs(df: DataFrame, keys: list[str], count: int, batch_size: int, seed: int = 0) -> DataFrame:
    """All rows once per epoch, each epoch in an order of its own (seed and epoch), with
    ``epoch``, ``ix`` and ``batch_id``; both start from 0 in each epoch.

    One exchange serves all epochs: rows are numbered in hash buckets of an epoch, and bucket
    counts, at most 65,536 small rows an epoch, carry the numbers on.
    """
    every = df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    drawn = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], (F.col("epoch") + seed).cast("string"))
    hashed = every.withColumn("_hash", F.md5(drawn)).withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))
    before = Window.partitionBy("epoch").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("epoch", "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("epoch", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("epoch", "_bucket").orderBy("_hash", *keys)
    numbered = hashed.withColumn("_nth", F.row_number().over(inside) - 1).join(offsets, ["epoch", "_bucket"])
    return numbered.select(
        *df.columns,
        (F.col("_nth") + F.col("_offset")).cast("long").alias("ix"),
        F.floor((F.col("_nth") + F.col("_offset")) / F.lit(batch_size)).cast("long").alias("batch_id"),
        "epoch",
    )


def packs(df: DataFrame, keys: list[str], tokens: str, budget: int, seed: int = 0) -> DataFrame:
    """Add ``pack_id``: samples in random order, as many in a pack as its budget allows.

    A sample that alone exceeds the budget is a pack by itself; NULL counts as no tokens.
    Blocks of a fixed number of rows are packed independently, so no group grows with the
    table. Only keys and sizes are shuffled. ``keys`` identify a row; NULL is a value like others.
    """
    sized = df.select(*keys, F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("_n"))
    numbered = with_dense_index(sized, keys, seed, "_ix").withColumn("_block", F.floor(F.col("_ix") / BLOCK))
    row = F.struct("_ix", *keys, "_n")
    blocks = numbered.groupBy("_block").agg(F.array_sort(F.collect_list(row)).alias("_rows"))

    def step(state: Column, sample: Column) -> Column:
        full = (state["used"] + sample["_n"] > budget) & (F.size(state["places"]) > 0)
        place = state["place"] + full.cast("long")
        used = F.when(full, sample["_n"]).otherwise(state["used"] + sample["_n"])
        places = F.concat(state["places"], F.array(place))
        return F.struct(place.alias("place"), used.alias("used"), places.alias("places"))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("place"), zero.alias("used"), F.array().cast("array<bigint>").alias("places"))
    places = F.aggregate("_rows", start, step, lambda state: state["places"])
    placed = blocks.select(
        "_block", F.explode(F.arrays_zip("_rows", places.alias("_places"))).alias("_row")
    )
    found = placed.select(
        *[F.col(f"_row._rows.{k}").alias(k) for k in keys],
        (F.col("_block") * BLOCK + F.col("_row._places")).alias("pack_id"),
    )
    return _joined(df, found, keys)


def _joined(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``found``, NULL keys meeting each other."""
    more = [c for c in found.columns if c not in keys]
    placed = found.select(same(*keys).alias("_key"), *more)
    return df.withColumn("_key", same(*keys)).join(placed, "_key").select(*df.columns, *more)


def best_fit(sizes: list[int], budget: int) -> list[int]:
    """The pack of each size, by best fit of the largest first: into the fullest pack that has room.

    Open packs are kept by the room they have, so a size finds its pack by bisection. A size
    beyond the budget is a pack by itself.
    """
    places = [0] * len(sizes)
    rooms: list[tuple[int, int]] = []  # room, pack; in order
    count = 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_left(rooms, (sizes[k], -1))
        if at < len(rooms):
            room, places[k] = rooms.pop(at)
        else:
            room, places[k] = budget, count
            count += 1
        if room >= sizes[k]:
            insort(rooms, (room - sizes[k], places[k]))
    return places


def levelled(sums: list[int], loads: list[int]) -> list[int]:
    """Which load each sum goes to, one after the other in falling order to the least load."""
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    chosen = [0] * len(sums)
    for k in sorted(range(len(sums)), key=lambda k: (-sums[k], k)):
        load, chosen[k] = heap[0]
        heapq.heapreplace(heap, (load + sums[k], chosen[k]))
    return chosen


def matched(sums: list[int], loads: list[int]) -> list[int]:
    """One load for each sum: the largest sum to the least load. If both are level to within
    some size, so are the loads after it."""
    light = sorted(range(len(loads)), key=lambda k: (loads[k], k))
    chosen = [0] * len(sums)
    for load, k in zip(light, sorted(range(len(sums)), key=lambda k: (-sums[k], k))):
        chosen[k] = load
    return chosen


def balanced_packs(df: DataFrame, keys: list[str], tokens: str, budget: int, ranks: int, seed: int = 0) -> DataFrame:
    """Add ``pack_id`` and ``rank``: full packs within the budget, dealt to ranks of about equal tokens.

    Samples are dealt at random into shards of a fixed number of rows and packed by size in
    each (best fit, largest first). A shard's packs go to as many bundles as there are ranks, the
    largest first to the least bundle; the bundles of many shards, and then of many groups of
    shards, are matched with ranks in the same way. So no task sees more than a shard or a group,
    and the tokens of any two ranks differ by no more than the largest pack. A sample that alone
    exceeds the budget is a pack by itself; NULL counts as no tokens. ``keys`` identify a row.
    """
    sized = df.select(*keys, F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("_n"))
    shards = with_dense_index(sized, keys, seed, "_ix").withColumn("_unit", F.floor(F.col("_ix") / SHARD).cast("long"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_ix")
        sizes = table.column("_n").to_pylist()
        places = best_fit(sizes, budget)
        totals = [0] * (max(places) + 1)
        for place, size in zip(places, sizes):
            totals[place] += size
        bundles = levelled(totals, [0] * ranks)
        unit = table.column("_unit")[0].as_py()
        ids = pa.array([unit * SHARD + place for place in places], pa.int64())
        table = table.append_column("pack_id", ids)
        return table.append_column("_bundle", pa.array([bundles[place] for place in places], pa.int64())).drop_columns("_ix")

    kinds = {f.name: f.dataType.simpleString() for f in sized.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "_n long, _unit long, pack_id long, _bundle long"])
    order = [*keys, "_n", "_unit", "pack_id", "_bundle"]
    packed = shards.groupBy("_unit").applyInArrow(lambda t: pack(t).select(order), schema)
    packed = stored(packed, "packs")
    found = packed.join(_ranks(packed, ranks), ["_unit", "_bundle"]).select(*keys, "pack_id", "rank")
    return _joined(df, found, keys)


def _ranks(packed: DataFrame, ranks: int) -> DataFrame:
    """``_unit, _bundle, rank``: units are matched in groups, groups in groups of groups, to one."""
    sums = packed.groupBy("_unit", "_bundle").agg(F.sum("_n").alias("_sum"))

    def match(table: pa.Table) -> pa.Table:
        loads, rows = [0] * ranks, []
        units: dict[int, list[int]] = {}
        for row in table.to_pylist():
            units.setdefault(row["_unit"], [0] * ranks)[row["_bundle"]] = row["_sum"]
        for unit in sorted(units):
            chosen = matched(units[unit], loads)
            for bundle, load in enumerate(chosen):
                loads[load] += units[unit][bundle]
                rows.append({"_unit": unit, "_bundle": bundle, "_group": unit // FAN, "_slot": load, "_sum": units[unit][bundle]})
        return pa.Table.from_pylist(rows)

    groups = sums.withColumn("_group", F.floor(F.col("_unit") / FAN).cast("long")).groupBy("_group")
    level = groups.applyInArrow(match, "_unit long, _bundle long, _group long, _slot long, _sum long")
    level = stored(level, "ranks")
    most = level.agg(F.max("_group")).first()[0]
    if not most:
        return level.select("_unit", "_bundle", F.col("_slot").alias("rank"))
    above = level.select(F.col("_group").alias("_unit"), F.col("_slot").alias("_bundle"), F.col("_sum").alias("_n"))
    higher = _ranks(above, ranks).select(F.col("_unit").alias("_group"), F.col("_bundle").alias("_slot"), "rank")
    return level.join(higher, ["_group", "_slot"]).select("_unit", "_bundle", "rank")
