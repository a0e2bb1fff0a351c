"""Prompt records and the split of a prompt into its first and later turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the label every prompt record carries.
LABEL = "0"


def first_and_rest(messages: Column) -> tuple[Column, Column, Column]:
    """The first message, the later ones, and the number of turns."""
    return (
        messages[0].alias("first"),
        F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0))).alias("rest"),
        F.size(messages).alias("n_turns"),
    )


def prompt_records(
    df: DataFrame,
    id: str = "id",
    prompt: str = "prompt",
    verifier: str = "verifier",
    persona: str = "persona",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Instructions to prompt records; an empty prompt is an error in ANSI mode."""
    return df.select(
        *keep,
        F.col(prompt)[0]["content"].alias("prompt"),
        F.lit(LABEL).alias("label"),
        F.struct(
            F.col(id).alias("id"),
            F.col(prompt).alias("prompt"),
            F.col(verifier).alias("verifier"),
            F.col(persona).alias("persona"),
        ).alias("metadata"),
    )


def prompt_heads(prompts: DataFrame, key: str, position: str, content: str) -> DataFrame:
    """From a turn table: the first prompt text and the number of turns per key."""
    return prompts.groupBy(key).agg(
        F.min_by(content, position).alias("prompt"),
        F.count(F.lit(1)).alias("n_turns"),
    )
