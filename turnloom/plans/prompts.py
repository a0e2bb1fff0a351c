"""Prompt data: instructions to shuffled prompt records for training and evaluation."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from turnloom.operators.order import order_hash
from turnloom.operators.records import prompt_records
from turnloom.sources.tables import read_dataset, write_jsonl


def prepare_prompts(
    spark: SparkSession,
    train: str,
    evaluation: str,
    train_target: str,
    evaluation_target: str,
    seed: int = 0,
    schema: str | None = None,
) -> dict[str, int]:
    """The same shaping and shuffle for both inputs; returns the rows written for each."""
    written = {}
    for name, source, target in (
        ("train", train, train_target),
        ("eval", evaluation, evaluation_target),
    ):
        instructions = read_dataset(spark, source, schema=schema)
        records = prompt_records(
            instructions.orderBy(order_hash(["id"], seed), F.col("id"))
        )
        written[name] = write_jsonl(records, target)
    return written
