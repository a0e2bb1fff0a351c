"""Reproducible random order, dense numbering and fixed-size batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows are numbered inside buckets of this many leading hex digits of their hash, so the
# per-bucket counts are at most 16 ** 4 rows whatever the size of the table.
BUCKET_DIGITS = 4


def order_hash(keys: list[str], seed: int) -> Column:
    """A uniform hash of the key and the seed; depends on neither partitioning nor retries."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def shuffled(df: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """All rows in random order, reproducible by seed; ``keys`` identify a record."""
    return df.orderBy(order_hash(keys, seed), *keys)


def with_dense_index(
    df: DataFrame, keys: list[str], seed: int = 0, name: str = "ix", start: int = 0
) -> DataFrame:
    """Number the rows from ``start`` without gaps in the order of :func:`shuffled`.

    The hash spreads unique keys evenly, so each bucket is a small share of the rows and
    is numbered by its own task; only the bucket counts are summed in one place.
    """
    hashed = df.withColumn("_hash", order_hash(keys, seed)).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.select(F.substring(order_hash(keys, seed), 1, BUCKET_DIGITS).alias("_bucket"))
        .groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_bucket").orderBy("_hash", *keys)
    index = F.row_number().over(inside) - 1 + F.col("_offset") + start
    return (
        hashed.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, index.cast("long"))
        .select(*df.columns, name)
    )


def batches(df: DataFrame, keys: list[str], batch_size: int, seed: int = 0) -> DataFrame:
    """Add ``ix`` and ``batch_id``: consecutive runs of ``batch_size`` rows in random order."""
    return with_dense_index(df, keys, seed).withColumn(
        "batch_id", F.floor(F.col("ix") / F.lit(batch_size)).cast("long")
    )
