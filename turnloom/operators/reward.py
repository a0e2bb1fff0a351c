"""Score conversations: every constraint of every turn must pass.

A check is one constraint of one turn: ``sample_id, matched, turn_ix, ver_ix, response,
id, placeholder``. A sample always has at least one row, possibly without a constraint;
``matched`` is false where responses and constraint lists do not pair up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.template import CHATML, ChatTemplate
from turnloom.operators.judge import is_hard, selected, with_verdicts
from turnloom.operators.pool import with_constraints
from turnloom.operators.rules import RuleBook


def _explode_lists(paired: DataFrame) -> DataFrame:
    return paired.select(
        "sample_id",
        "matched",
        "turn_ix",
        "response",
        F.posexplode_outer("verifier").alias("ver_ix", "_check"),
    ).select(
        "sample_id",
        "matched",
        "turn_ix",
        "ver_ix",
        "response",
        F.col("_check.id").cast("string").alias("id"),
        F.col("_check.placeholder").alias("placeholder"),
    )


def checks_from_records(samples: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """Checks of ``samples(sample_id, prompt, response, verifier)``; no shuffle.

    Responses are the assistant spans of prompt and response together, so assistant turns
    inside the prompt count too. ``verifier`` has one list per expected response.
    """
    text = F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("response", F.lit("")))
    spans = samples.select("sample_id", "verifier", template.assistant_spans(text).alias("_spans"))
    matched = F.size("_spans") == F.size("verifier")
    pairs = F.arrays_zip(F.col("_spans").alias("response"), F.col("verifier").alias("verifier"))
    return _explode_lists(
        spans.select(
            "sample_id",
            matched.alias("matched"),
            F.posexplode_outer(F.when(matched, pairs)).alias("turn_ix", "_pair"),
        ).select(
            "sample_id",
            "matched",
            F.col("turn_ix").cast("bigint").alias("turn_ix"),
            F.col("_pair.response").alias("response"),
            F.col("_pair.verifier").alias("verifier"),
        )
    )


def checks_from_turns(turns: DataFrame, silent: DataFrame) -> DataFrame:
    """The same from ``turns(sample_id, turn_ix, response, verifier)``, a response and its own
    list per row; no shuffle. ``silent(sample_id)`` adds one neutral row for each sample
    without responses.
    """
    neutral = silent.select(
        "sample_id",
        F.lit(True).alias("matched"),
        F.lit(None).cast("bigint").alias("turn_ix"),
        F.lit(None).cast("int").alias("ver_ix"),
        F.lit(None).cast("string").alias("response"),
        F.lit(None).cast("string").alias("id"),
        F.lit(None).cast("string").alias("placeholder"),
    )
    return _explode_lists(turns.withColumn("matched", F.lit(True))).unionByName(neutral)


def score_checks(
    checks: DataFrame,
    index: DataFrame,
    book: RuleBook,
    judgements: DataFrame | None = None,
    rate: float = 0.0,
    seed: int = 0,
) -> DataFrame:
    """Add ``ok`` to every check.

    Hard constraints hold when all their rules do. A share ``rate`` of them is also asked
    for helpfulness, which can only turn a pass into a fail. Other constraints take the
    judge's verdict. Missing verdicts pass, failing rules do not.
    """
    placeholder = F.when(F.col("content_template"), F.col("placeholder"))
    # Soft constraints are the judge's: their rules are not run.
    rules = F.when(is_hard(F.col("verifier_type")), F.col("rules"))
    held = book.all_hold(F.col("response"), rules, placeholder)
    # Rules run before the verdicts are joined, so the join need not carry the texts.
    named = with_constraints(checks, index).withColumn("rules_ok", held)
    if judgements is None:
        named = named.withColumn("verdict", F.lit(True))
    else:
        named = with_verdicts(named, judgements)
    hard_ok = F.col("rules_ok")
    if rate > 0:
        asked = selected(["sample_id", "turn_ix", "ver_ix"], rate, seed)
        hard_ok = hard_ok & (~asked | F.col("verdict"))
    ok = (
        F.when(F.col("id").isNull(), F.lit(True))
        .when(F.col("known").isNull(), F.lit(False))
        .when(is_hard(F.col("verifier_type")), hard_ok)
        .otherwise(F.col("verdict"))
    )
    return named.withColumn("ok", ok)


def turn_passes(scored: DataFrame) -> DataFrame:
    """Per turn: do all its constraints hold? A turn without any passes."""
    return (
        scored.filter(F.col("turn_ix").isNotNull())
        .groupBy("sample_id", "turn_ix")
        .agg(F.bool_and("ok").alias("passed"))
    )


def rewards(scored: DataFrame, on_missing: str = "error") -> DataFrame:
    """Per sample: 1.0 where everything passes, 0.0 otherwise or where turns do not pair up.

    All over rules, constraints and turns is a single conjunction, so one aggregation
    settles it. A constraint that is not in the table is an error, or a fail with
    ``on_missing="fail"``; ``unknown_constraints`` lists such ids.
    """
    unknown = F.col("id").isNotNull() & F.col("known").isNull()
    summed = scored.groupBy("sample_id").agg(
        F.bool_and("matched").alias("_matched"),
        F.bool_and("ok").alias("_ok"),
        F.bool_or(unknown).alias("_unknown"),
    )
    reward = F.when(F.col("_ok"), F.lit(1.0)).otherwise(F.lit(0.0))
    if on_missing == "error":
        message = F.lit("a sample names a constraint that is not in the table")
        reward = F.when(F.col("_unknown"), F.raise_error(message).cast("double")).otherwise(reward)
    return summed.select(
        "sample_id", F.when(F.col("_matched"), reward).otherwise(F.lit(0.0)).alias("reward")
    )
