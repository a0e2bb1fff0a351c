"""The same filters, masks and rewards over a stream of JSON-lines files.

Conversations and samples arrive as whole rows, so no state is kept between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnloom.operators.arrayreward import array_rewards
from turnloom.operators.keep import WORD_BUDGET, keep_records
from turnloom.operators.rules import RuleBook
from turnloom.sources.tables import JSONL

COUNTS = "loaded long, kept long"


def stream_jsonl(
    spark: SparkSession, source: str, schema: str, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(source)


def stream_keep(
    conversations: DataFrame,
    target: str,
    checkpoint: str,
    messages: str = "messages",
    max_turns: int | None = None,
    budget: int = WORD_BUDGET,
    counts: str | None = None,
) -> StreamingQuery:
    """Append the conversations that pass the filters to JSON lines.

    With ``counts``, a folder, the rows loaded and kept are written beside each micro-batch;
    ``stream_counts`` sums them up. They are observed while the batch is written, and a batch
    that is run again after a failure replaces its rows and its counts.
    """
    if counts is not None:

        def write(batch: DataFrame, number: int) -> None:
            loaded, kept = Observation(), Observation()
            one = F.count(F.lit(1)).alias("rows")
            rows = keep_records(batch.observe(loaded, one), messages, max_turns, budget).observe(kept, one)
            rows.write.mode("overwrite").options(**JSONL).json(f"{target}/batch={number}")
            observed = [(loaded.get["rows"], kept.get["rows"])]
            # The batch's own session, which the query started from, may differ from the active one.
            table = batch.sparkSession.createDataFrame(observed, COUNTS)
            table.coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={number}")

        return (
            conversations.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    return (
        keep_records(conversations, messages, max_turns, budget)
        .writeStream.format("json")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .options(**JSONL)
        .trigger(availableNow=True)
        .start()
    )


def stream_counts(spark: SparkSession, counts: str) -> tuple[int, int]:
    """Rows loaded and kept by all micro-batches so far, over all runs of a stream."""
    total = spark.read.schema(COUNTS).parquet(counts).agg(F.sum("loaded"), F.sum("kept")).first()
    return total[0] or 0, total[1] or 0


def stream_rewards(
    samples: DataFrame, index: DataFrame, book: RuleBook, target: str, checkpoint: str, **options
) -> StreamingQuery:
    """Append ``sample_id, reward`` of finished samples to parquet; options as for ``array_rewards``.

    No shuffle and no state: the constraint table is a map beside each row.
    """
    return (
        array_rewards(samples, index, book, **options)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_batches(
    samples: DataFrame, job: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> StreamingQuery:
    """Run a batch job, such as the rewards of finished samples, on every micro-batch.

    Each batch overwrites its own folder, so a batch that is run again after a failure
    leaves one result.
    """

    def write(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        samples.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
