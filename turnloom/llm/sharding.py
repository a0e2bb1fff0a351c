"""Sharding by histogram sort: exact byte counts below candidate borders, refined, one exchange.

Rows are ordered by a key of hexadecimal digits: the hash of the text, then the hash of
the id, then the row's number. Equal texts so lie next to each other, and a group larger
than a shard can still be divided. A round counts bytes and rows by key prefix; only
prefixes that hold a border not yet met within tolerance are counted again, by longer
prefixes. Then every row is sent to its range, whole and once.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import new_path

#: Digits of the first candidates, and digits added each time they are refined.
FIRST, MORE = 3, 1
#: Ranges a shard is numbered in at least, rows and bytes of one range about, and ranges of all
#: shards at most: what the driver counts does not grow with the table beyond them.
RANGES, ROWS, BYTES, MOST = 4, 500_000, 256 << 20, 4096
#: A border may be off by this share of a shard's bytes, or by half a row; one inside a shard, which
#: only says where a task ends, by this share of a range.
TOLERANCE, INSIDE = 0.0005, 0.25


class Border(NamedTuple):
    """The first key that lies above; bytes and rows below it."""

    key: str
    bytes: int
    rows: int


class Bin(NamedTuple):
    prefix: str
    low: str
    high: str
    bytes: int
    rows: int


def _hex(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 16, "0")


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``row, size, place`` written to the shared folder, so that it stays as it is; ``row``
    holds all columns."""
    words = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.struct("*").alias("row"),
        (F.octet_length(words) + 8).cast("long").alias("size"),
        F.concat(
            _hex(F.xxhash64(words)), _hex(F.xxhash64(key)), _hex(F.monotonically_increasing_id())
        ).alias("place"),
    )
    path = new_path(df.sparkSession, "shard-keys")
    rows.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _histogram(rows: DataFrame, prefixes: list[str] | None, digits: int) -> list[Bin]:
    """Bins by the first ``digits`` digits; with ``prefixes`` (of one length) only below these."""
    if prefixes is not None:
        wanted = rows.sparkSession.createDataFrame([(p,) for p in prefixes], "wanted string")
        at = F.substring("place", 1, len(prefixes[0]))
        rows = rows.join(wanted, at == F.col("wanted"), "left_semi")
    counted = rows.groupBy(F.substring("place", 1, digits).alias("prefix")).agg(
        F.min("place"), F.max("place"), F.sum("size"), F.count(F.lit(1))
    )
    return sorted(Bin(*row) for row in counted.collect())


def borders(rows: DataFrame, shards: int, parts: int, tolerance: float) -> tuple[list[Border], Border]:
    """Borders between ``shards`` of about equal byte sums, and between ``parts`` of each; and the end.

    A round collects at most 4,096 bins, or 16 for each border that is still open.
    """
    ranges = shards * parts
    top = _histogram(rows, None, FIRST)
    total, count = sum(b.bytes for b in top), sum(b.rows for b in top)
    found: list[Border | None] = [None] * (ranges - 1)
    todo = {k: (top, 0, 0) for k in range(ranges - 1)}  # bins, bytes and rows before them
    while todo:
        again: dict[str, list[int]] = {}
        before: dict[str, tuple[int, int, Bin]] = {}
        for k, (bins, bytes_before, rows_before) in todo.items():
            target = total * (k + 1) / ranges
            for b in bins:
                if bytes_before + b.bytes >= target:
                    break
                bytes_before, rows_before = bytes_before + b.bytes, rows_before + b.rows
            else:  # no rows at all
                found[k] = Border("g", total, count)
                continue
            slack = tolerance * total / shards if (k + 1) % parts == 0 else INSIDE * total / ranges
            if b.bytes <= slack or b.rows == 1 or b.low == b.high:
                below = target - bytes_before <= b.bytes / 2
                found[k] = (
                    Border(b.low, bytes_before, rows_before)
                    if below
                    else Border(b.high + "g", bytes_before + b.bytes, rows_before + b.rows)
                )
                continue
            shared = os.path.commonprefix([b.low, b.high])
            again.setdefault(shared, []).append(k)
            before[shared] = (bytes_before, rows_before, b)
        todo = {}
        for length in sorted({len(p) for p in again}):
            some = sorted(p for p in again if len(p) == length)
            bins = _histogram(rows, some, length + MORE)
            for p in some:
                below = [b for b in bins if b.prefix.startswith(p)]
                todo |= {k: (below, *before[p][:2]) for k in again[p]}
    # A border inside a shard is only about right: it stays between those of the shard.
    for k in range(1, ranges - 1):
        if (k + 1) % parts:
            found[k] = max(found[k], found[k - 1])
    for k in range(ranges - 3, -1, -1):
        if (k + 1) % parts:
            found[k] = min(found[k], found[k + 1])
    return found, Border("g", total, count)


def sharded(
    df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE
) -> DataFrame:
    """``row, size, law, shard, slot, grown_shard``: the whole rows in their shards, by the law
    ``bytes``.

    ``row`` is a struct of all columns of ``df``. ``size`` is the text's UTF-8 bytes and 8
    (NULL as the empty text). Shards follow the key's order; their sums of sizes differ by
    the tolerance or one row at most, so a group of equal texts stays together unless a
    border falls inside it. ``slot`` numbers a shard's rows from 0 without gaps.
    ``grown_shard`` is NULL under this law. Rows that repeat are placed each; an empty table
    gives none.
    """
    spark = df.sparkSession
    rows = keyed(df, key, text)
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(RANGES, -(-count // (ROWS * shards)), -(-total // (BYTES * shards)))
    parts = min(parts, max(RANGES, MOST // shards))
    found, end = borders(rows.select("place", "size"), shards, parts, tolerance)
    starts = [Border("", 0, 0), *found]
    # Which range: borders before the key's first digits, and those among its kind.
    keys = [b.key for b in found]
    cells = []
    for digit in range(16**FIRST):
        prefix = f"{digit:0{FIRST}x}"
        low, high = bisect_left(keys, prefix), bisect_left(keys, prefix + "g")
        cells.append((prefix, low, keys[low:high]))
    cells = spark.createDataFrame(cells, "cell string, low int, inside array<string>")
    offsets = [starts[k].rows - starts[k // parts * parts].rows for k in range(len(starts))]
    offsets = spark.createDataFrame(list(enumerate(offsets)), "range int, offset long")
    placed = rows.join(F.broadcast(cells), F.substring("place", 1, FIRST) == F.col("cell")).select(
        "row",
        "size",
        "place",
        (
            F.col("low") + F.size(F.filter("inside", lambda b: b <= F.col("place")))
        ).alias("range"),
    )
    order = Window.partitionBy("range").orderBy("place")
    numbered = placed.withColumn("nth", F.row_number().over(order)).join(F.broadcast(offsets), "range")
    return numbered.select(
        "row",
        "size",
        F.lit("bytes").alias("law"),
        F.floor(F.col("range") / parts).cast("int").alias("shard"),
        (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Writes ``sharded`` rows as Parquet, a folder ``shard=k`` for each shard; a file's rows
    are in the order of their slots."""
    sharded(df, **options).sortWithinPartitions("shard", "slot").drop("grown_shard").write.partitionBy("shard").parquet(path)


def shard(
    df: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE
) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard``: digests of ``sharded`` rows,
    taken from the rows after they have been moved. Other columns are not given."""
    rows = sharded(df, shards, key, text, tolerance)
    return rows.select(
        F.col("row")[key].alias(key),
        "size",
        F.crc32(F.coalesce(F.col("row")[text], F.lit("")).cast("binary")).alias("text_crc32"),
        "law",
        "shard",
        "slot",
        "grown_shard",
    )
