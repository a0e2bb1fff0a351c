"""Rewards for trajectories, from turn tables or from finished samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from turnloom.functions.template import CHATML, ChatTemplate
from turnloom.operators.reward import checks_from_records, rewards, score_checks
from turnloom.operators.rules import RuleBook
from turnloom.operators.trajectory import build_trajectories, gather_samples
from turnloom.operators.turns import gather


def recorded_trajectories(
    prompts: DataFrame, outputs: DataFrame, template: ChatTemplate = CHATML, **options
) -> DataFrame:
    """Trajectories of recorded outputs, one row per sample."""
    return build_trajectories(gather_samples(prompts, outputs), template, **options)


def output_checks(
    prompts: DataFrame, outputs: DataFrame, lists: DataFrame, template: ChatTemplate = CHATML
) -> DataFrame:
    """Checks of recorded outputs against ``lists(sample_id, turn_ix, verifier)``."""
    verifiers = gather(lists, "sample_id", "turn_ix", ["verifier"], "_lists")
    texts = build_trajectories(gather_samples(prompts, outputs), template).select(
        "sample_id", "prompt", "response"
    )
    paired = texts.join(verifiers, "sample_id", "left").selectExpr(
        "sample_id",
        "prompt",
        "response",
        "coalesce(transform(_lists, l -> l.verifier), array()) AS verifier",
    )
    return checks_from_records(paired, template)


def record_rewards(
    samples: DataFrame,
    index: DataFrame,
    book: RuleBook,
    judgements: DataFrame | None = None,
    rate: float = 0.0,
    seed: int = 0,
    template: ChatTemplate = CHATML,
    on_missing: str = "error",
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The reward of every finished sample, or whatever ``scorer`` makes of the samples."""
    if scorer is not None:
        return samples.transform(scorer)
    checks = checks_from_records(samples, template)
    return rewards(score_checks(checks, index, book, judgements, rate, seed), on_missing)
