"""Connected components of links between keys, with tables and aggregates only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.session import new_path

#: Bits of a filter for each row that it stands for, at least, and its size at most (16 MB).
FILTER_BITS, FILTER_LOG = 16, 27


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def possibly(table: DataFrame, *columns: str) -> Callable[..., Column]:
    """A condition on columns of the same types: true where their values are those of a row of
    ``table`` (NULLs alike), and for some one in a hundred of the others. An exact join that
    follows then moves few rows; beyond eight million rows of ``table`` it moves more."""
    log = min(max(FILTER_BITS * table.count(), 64).bit_length(), FILTER_LOG)
    mask = (1 << log) - 1

    def places(h: Column) -> list[Column]:
        return [h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(mask))]

    words = (
        table.select(F.explode(F.array(*places(F.xxhash64(*columns)))).alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(1 << (log - 6), np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = table.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def hit(hashes: pa.Array) -> pa.Array:
        h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
        bitmap, out = shared.value, np.ones(len(h), bool)
        for shift in (0, 32):
            place = ((h >> np.uint64(shift)) & np.uint64(mask)).astype(np.int64)
            out &= (bitmap[place >> 6] >> (place & 63)) & 1 == 1
        return pa.array(out)

    return lambda *values: hit(F.xxhash64(*values))


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``key, root`` for every key of ``links`` (columns ``a``, ``b``, in any direction);
    ``root`` is the least key that can be reached.

    Alternates two steps until nothing changes: tie each key's larger neighbours to its
    least one, then its smaller neighbours and itself. Both keep components as they are, and
    few rounds flatten them into stars. A round is two aggregates and two joins; a key with
    many links is one group of a minimum, never gathered.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct(),
        name,
    )
    state = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = _smallest(both).select("a", F.least("a", "low").alias("low"))
        large = (
            both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        large = large.filter("a <> b").distinct()
        low = _smallest(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = written(small.filter("a <> b").union(low.select("a", "low")).distinct(), name)
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if not now[0] or tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("b").alias("key")).distinct().select("key", F.col("key").alias("root"))
    return edges.select(F.col("a").alias("key"), F.col("b").alias("root")).union(roots)


def forest(linked) -> list[int]:
    """The least row reachable from each row of a square boolean matrix of links."""
    n = len(linked)
    root = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        low = np.where(reach, root[None, :], n).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root.tolist()
        root = low
