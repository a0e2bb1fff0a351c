"""Read-outs of scored samples: pass rates, repeated prompts, normalised rewards, length flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.operators.turns import same


def pass_rates(scored: DataFrame, *by: str) -> DataFrame:
    """Per group of checks: how many there are, how many hold, and their share."""
    checks = scored.filter(F.col("id").isNotNull()).groupBy(*by)
    return checks.agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if("ok").alias("n_passed")
    ).withColumn("pass_rate", F.col("n_passed") / F.col("n_checks"))


def pass_rate_cube(scored: DataFrame, *by: str) -> DataFrame:
    """Pass rates of every leading run of ``by`` and of all checks together, from one aggregate.

    ``level`` is the number of columns a row is grouped by; the others are NULL in it, as may
    be a value of its own, so rows are told apart by ``level`` alone.
    """
    named = scored.filter(F.col("id").isNotNull())
    checks = named.rollup(*by).agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if("ok").alias("n_passed"), F.grouping_id().alias("_set")
    )
    # Each column that is left out sets a bit of the set's number, the last column the lowest one.
    level = F.lit(len(by)) - F.bit_count("_set")
    return checks.select(
        *by, level.cast("long").alias("level"), "n_checks", "n_passed", (F.col("n_passed") / F.col("n_checks")).alias("pass_rate")
    )


def fan_out(prompts: DataFrame, samples: int, name: str = "sample_ix") -> DataFrame:
    """Each prompt once per sample that is to be drawn for it, numbered from 0."""
    return prompts.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))))


def group_advantages(rewards: DataFrame, group: str, reward: str = "reward", floor: float = 1e-6) -> DataFrame:
    """Rewards less their group's mean, over its standard deviation; 0 in a group of equals.

    Groups are the samples of one prompt; their means come from one aggregate that combines
    map-side, so a group of any size is fine. A NULL group is a group of its own.
    """
    rewards = rewards.withColumn("_group", same(group))
    stats = rewards.groupBy("_group").agg(
        F.avg(reward).alias("_mean"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_spread")
    )
    centred = F.col(reward) - F.col("_mean")
    return (
        rewards.join(stats, "_group")
        .withColumn("advantage", centred / (F.col("_spread") + floor))
        .drop("_group", "_mean", "_spread")
    )


def over_length(length: Column, limit: int) -> Column:
    """Whether a response reached the limit; one that is missing did not."""
    return F.coalesce(length >= limit, F.lit(False))
