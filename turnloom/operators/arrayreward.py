"""Rewards without a shuffle: constraints folded into a map, conjunctions nested in the row.

A sample's turns, lists and constraints stay in its row, so a stream of samples is scored
without state, and a batch in the stage that reads it. The constraint table becomes one row
with one map, copied to all tasks; its number of rows is limited, and a larger table is an
error. Rules must be columns: Python rules and patterns need ``score_checks``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrays import let
from turnloom.functions.template import CHATML, ChatTemplate
from turnloom.functions.text import judge_verdict
from turnloom.operators.judge import CONSTRAINT, HELPFULNESS, is_hard, selected
from turnloom.operators.rules import RuleBook

#: Constraints of a folded table at most; each look-up reads the map from its start.
MOST = 2048


def folded_pool(index: DataFrame, most: int = MOST) -> DataFrame:
    """The constraint index as one row: ``_pool``, a map from id to what scoring reads."""
    entry = F.struct(
        F.col("id").cast("string").alias("id"),
        F.struct("verifier_type", "content_template", "rules").alias("constraint"),
    )
    # One entry more than allowed is enough to tell.
    some = index.filter(F.col("id").isNotNull()).select(entry.alias("entry")).limit(most + 1)
    folded = some.agg(F.collect_list("entry").alias("entries"))
    message = F.lit(f"more than {most} constraints: use score_checks")
    fits = F.when(F.size("entries") > most, F.raise_error(message).cast(folded.schema["entries"].dataType))
    return folded.select(F.map_from_entries(fits.otherwise(F.col("entries"))).alias("_pool"))


def _check_holds(
    check: Column, response: Column, at: Column, nth: Column, book: RuleBook, judged: Column | None, rate: float, seed: int
) -> Column:
    key = check["id"].cast("string")

    def verdict(kind: str) -> Column:
        if judged is None:
            return F.lit(True)
        own = F.filter(judged, lambda j: (j["turn_ix"] == at) & (j["constraint_id"] == key) & (j["kind"] == kind))
        return F.coalesce(F.forall(own, lambda j: judge_verdict(j["verdict_text"])), F.lit(True))

    def decide(constraint: Column) -> Column:
        placeholder = F.when(constraint["content_template"], check["placeholder"])
        rules = F.forall(
            constraint["rules"], lambda r: book.verdict(r["kind"], response, F.coalesce(placeholder, r["arg"]))
        )
        hard = F.coalesce(rules, F.lit(True))
        if rate > 0:
            hard &= ~selected([F.col("sample_id"), at, nth], rate, seed) | verdict(HELPFULNESS)
        return (
            F.when(key.isNull(), True)
            .when(constraint.isNull(), False)
            .when(is_hard(constraint["verifier_type"]), hard)
            .otherwise(verdict(CONSTRAINT))
        )

    return let(F.try_element_at("_pool", key), decide)


def array_rewards(
    samples: DataFrame,
    index: DataFrame,
    book: RuleBook,
    judgements: str | None = None,
    rate: float = 0.0,
    seed: int = 0,
    template: ChatTemplate = CHATML,
    on_missing: str = "error",
    most: int = MOST,
) -> DataFrame:
    """``sample_id, reward`` of ``samples(sample_id, prompt, response, verifier)``, a batch or a stream.

    As ``rewards(score_checks(checks_from_records(samples), ...))``. Judge replies come with
    the sample: ``judgements`` names a column of ``array<struct<turn_ix, constraint_id, kind,
    verdict_text>>``. Responses and lists that do not pair up, and NULL lists, give 0.0; a
    sample with neither gives 1.0.
    """
    if book.python or book.patterns:
        raise ValueError("Python rules and patterns cannot be scored in the row")
    text = F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("response", F.lit("")))
    judged = [] if judgements is None else [F.col(judgements).alias("_judged")]
    rows = samples.select("sample_id", "verifier", template.assistant_spans(text).alias("_spans"), *judged)
    rows = rows.crossJoin(F.broadcast(folded_pool(index, most)))
    replies = F.col("_judged") if judged else None

    def turn_holds(pair: Column, at: Column) -> Column:
        each = F.transform(
            pair["verifier"],
            lambda check, nth: _check_holds(check, pair["response"], at, nth, book, replies, rate, seed),
        )
        return F.coalesce(F.forall(each, lambda ok: ok), F.lit(True))

    pairs = F.arrays_zip(F.col("_spans").alias("response"), F.col("verifier").alias("verifier"))
    held = F.forall(F.transform(pairs, turn_holds), lambda ok: ok)
    reward = F.when(held, 1.0).otherwise(0.0)
    if on_missing == "error":
        named = F.filter(F.flatten("verifier"), lambda check: check["id"].isNotNull())
        unknown = F.exists(named, lambda check: ~F.map_contains_key("_pool", check["id"].cast("string")))
        message = F.lit("a sample names a constraint that is not in the table")
        reward = F.when(unknown, F.raise_error(message).cast("double")).otherwise(reward)
    paired = F.coalesce(F.size("_spans") == F.size("verifier"), F.lit(False))
    return rows.select("sample_id", F.when(paired, reward).otherwise(0.0).alias("reward"))
