"""Lookup joins whose small side is measured before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup table within both limits is copied to every executor.
MAX_ROWS = 500_000
MAX_BYTES = 64 * 1024 * 1024


def fits_broadcast(table: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Whether rows and their text size are within the limits: sums, combined map-side."""
    size = (
        table.select(F.octet_length(F.to_json(F.struct("*"))).alias("bytes"))
        .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
        .first()
    )
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def lookup(facts: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join ``facts`` to a table that is unique by ``key``; starts no job.

    Spark copies a table whose size it knows to be small. A larger one is joined by shuffle,
    where the adaptive plan splits the tasks of keys that most facts share.
    """
    return facts.join(table, key, "left")
