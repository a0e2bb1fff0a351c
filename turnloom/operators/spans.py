"""Spans of a loss mask over turn tables: gaps and islands whose islands cross turns and blocks.

Tokens of a turn are rows of equal mask bits, in order. A span begins at a row of ones that
no row of ones precedes in its conversation, and takes all rows up to the next zeros.
What precedes a block of positions, and how many spans began before it, is one small row
per block, so no conversation is ordered or held in one task. A span itself becomes a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.arrays import mask_runs
from turnloom.functions.tokens import PIECES
from turnloom.operators.turns import FIRST_BLOCK, block_of, same


def run_rows(masked: DataFrame, key: str, position: str, tokens: str = "tokens", mask: str = "loss_mask") -> DataFrame:
    """``_key, at, run, bit, tokens``: each turn's tokens in runs of equal mask bits."""
    runs = F.posexplode(mask_runs(F.col(tokens), F.col(mask))).alias("run", "_run")
    at = F.coalesce(F.col(position).cast("long"), F.lit(FIRST_BLOCK))
    return masked.select(same(key).alias("_key"), at.alias("at"), runs).select(
        "_key", "at", "run", F.col("_run.bit").alias("bit"), F.col("_run.tokens").alias("tokens")
    )


def with_spans(rows: DataFrame) -> DataFrame:
    """Rows of ones with ``span_ix``, the number of their span in its conversation."""
    blocked = rows.withColumn("_block", block_of(F.col("at")))
    inside = Window.partitionBy("_key", "_block").orderBy("at", "run")
    local = blocked.withColumn("_before", F.lag("bit").over(inside))
    starts = ((F.col("bit") == 1) & (F.col("_before") == 0)).cast("long")
    # The first row of a block begins a span, too, unless the block before ends with ones.
    opens = (F.col("bit") == 1) & F.col("_before").isNull()
    local = local.withColumn("_opens", opens).withColumn("_begun", F.sum(F.coalesce(starts, F.lit(0))).over(inside))
    order = F.struct("at", "run")
    blocks = local.groupBy("_key", "_block").agg(
        F.max_by("bit", order).alias("_last"), F.max("_begun").alias("_starts"), F.bool_or("_opens").alias("_open")
    )
    across = Window.partitionBy("_key").orderBy("_block")
    fresh = F.col("_open") & (F.coalesce(F.lag("_last").over(across), F.lit(0)) == 0)
    blocks = blocks.withColumn("_fresh", fresh.cast("long"))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum(F.col("_starts") + F.col("_fresh")).over(earlier), F.lit(0)) + F.col("_fresh")
    carried = blocks.select("_key", "_block", begun.alias("_carried"))
    numbered = local.filter("bit = 1").join(carried, ["_key", "_block"])
    return numbered.select("_key", "at", "run", "tokens", (F.col("_carried") + F.col("_begun") - 1).alias("span_ix"))


def mask_span_rows(
    masked: DataFrame,
    key: str,
    position: str,
    tokens: str = "tokens",
    mask: str = "loss_mask",
    tokenizer=PIECES,
) -> DataFrame:
    """``key, span_ix, span``: the text of every maximal run of ones of a conversation's mask,
    from a table of masked turns. Turns without tokens are passed over; a NULL key is a
    conversation like any other, and a NULL position comes first."""
    spans = with_spans(run_rows(masked, key, position, tokens, mask))
    whole = spans.groupBy("_key", "span_ix").agg(F.sort_array(F.collect_list(F.struct("at", "run", "tokens"))).alias("_rows"))
    joined = whole.withColumn("_tokens", F.flatten(F.transform("_rows", lambda row: row["tokens"])))
    return joined.select(F.col("_key")[key].alias(key), "span_ix", tokenizer.text(F.col("_tokens")).alias("span"))
