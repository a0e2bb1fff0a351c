"""The constraint table: one row per id, and lookups into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.joins import lookup

# The columns scoring reads; the scan is pruned to these.
SCORING_COLUMNS = ("id", "constraint", "verifier_type", "content_template", "rules")


def constraint_index(constraints: DataFrame, order: str) -> DataFrame:
    """One row per id as text; of rows with equal ids the last by ``order`` stays."""
    others = [c for c in constraints.columns if c not in ("id", order)]
    return (
        constraints.groupBy(F.col("id").cast("string").alias("id"))
        .agg(F.max_by(F.struct(*others), order).alias("_row"))
        .select("id", *[F.col("_row")[c].alias(c) for c in others])
    )


def with_constraints(checks: DataFrame, index: DataFrame) -> DataFrame:
    """Add the constraint of each check; ``known`` is NULL where the id is not indexed."""
    columns = index.select(*SCORING_COLUMNS).withColumn("known", F.lit(True))
    return lookup(checks, columns, "id")


def unknown_constraints(checks: DataFrame, index: DataFrame) -> DataFrame:
    """Ids that checks name and the index lacks, with the number of checks."""
    named = (
        checks.filter(F.col("id").isNotNull())
        .groupBy(F.col("id").cast("string").alias("id"))
        .agg(F.count(F.lit(1)).alias("n_checks"))
    )
    return named.join(index.select("id"), "id", "left_anti")
