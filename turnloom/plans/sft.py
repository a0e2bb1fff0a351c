"""SFT data: filter conversations, then tokens and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.template import CHATML, ChatTemplate
from turnloom.functions.tokens import PIECES
from turnloom.operators.keep import WORD_BUDGET, keep_records
from turnloom.operators.lossmask import SIMPLE, finalise_samples, with_loss_mask
from turnloom.sources.tables import read_dataset, write_jsonl


def prepare_sft(
    spark: SparkSession,
    source: str,
    target: str,
    input_key: str = "messages",
    max_turns: int | None = None,
    budget: int = WORD_BUDGET,
    schema: str | None = None,
) -> tuple[int, int]:
    """Filter a dataset into JSON lines; returns the loaded and kept row counts.

    One pass without a shuffle: both counts are observed while the rows stream through.
    """
    loaded = Observation()
    rows = read_dataset(spark, source, schema=schema).observe(
        loaded, F.count(F.lit(1)).alias("rows")
    )
    kept = write_jsonl(keep_records(rows, input_key, max_turns, budget), target)
    return loaded.get["rows"], kept


def sft_samples(
    conversations: DataFrame,
    kind: str = SIMPLE,
    messages: str = "messages",
    template: ChatTemplate = CHATML,
    tokenizer=PIECES,
    tools: str | None = None,
    on_unsupported: str = "error",
) -> DataFrame:
    """Training samples: tokens, mask of the response, response length and reward 0."""
    return finalise_samples(
        with_loss_mask(conversations, kind, messages, template, tokenizer, tools, on_unsupported)
    )
