"""Turn tables: one row per message, ordered inside a conversation by a unique position.

Running totals work in blocks of positions, so that no conversation, however long, is
ordered in one task. ``gather`` makes records: a record is one conversation in one row, at
any length, and is made only where the result is such records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 12  # 4096 positions
#: The block of rows without a position, before all others.
FIRST_BLOCK = -(1 << 62)


def block_of(position: Column) -> Column:
    return F.shiftright(position.cast("long"), BLOCK_BITS)


def same(*columns: str) -> Column:
    """A key that is never NULL, so that rows whose columns are NULL meet each other in a join."""
    return F.struct(*columns)


def with_running_total(
    turns: DataFrame, key: str, position: str, value: Column, name: str
) -> DataFrame:
    """Add the sum of ``value`` over all earlier positions of the same key.

    The window runs inside blocks of positions; block totals, one small row each, are carried
    across in a join. So one plan serves conversations of any length. Every row is kept: NULL
    is a key like any other, and a NULL position comes first.
    """
    blocked = turns.withColumn("_key", same(key)).withColumn("_value", value)
    blocked = blocked.withColumn("_block", F.coalesce(block_of(F.col(position)), F.lit(FIRST_BLOCK)))
    inside = (
        Window.partitionBy("_key", "_block")
        .orderBy(F.col(position).asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = blocked.withColumn("_local", F.sum("_value").over(inside))
    across = (
        Window.partitionBy("_key")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        blocked.groupBy("_key", "_block")
        .agg(F.sum("_value").alias("_total"))
        .select("_key", "_block", F.sum("_total").over(across).alias("_carried"))
    )
    total = F.coalesce("_local", F.lit(0)) + F.coalesce("_carried", F.lit(0))
    return local.join(carried, ["_key", "_block"]).select(
        *turns.columns, total.cast("long").alias(name)
    )


def gather(turns: DataFrame, key: str, position: str, fields: list[str], name: str) -> DataFrame:
    """Conversations to one row each: ``name`` holds their turns in order."""
    ordered = F.sort_array(F.collect_list(F.struct(position, *fields)))
    return turns.groupBy(key).agg(ordered.alias("_ordered")).select(
        key,
        F.transform("_ordered", lambda m: F.struct(*[m[f].alias(f) for f in fields])).alias(name),
    )
