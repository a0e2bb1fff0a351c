"""Trajectories in rows: one row for each turn of a sample, none for the sample as a whole.

The record form puts a sample together in one row. Here a sample's run is cut by scalars: the
first output that was cut by length or aborted, and the numbers of its prompts and outputs.
A turn's place in the token sequence is a running total in blocks of turns. So a sample of
any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrays import repeat
from turnloom.functions.template import CHATML, ChatTemplate
from turnloom.functions.tokens import PIECES
from turnloom.operators.trajectory import ABORT, LENGTH, output_fields, status_of
from turnloom.operators.turns import with_running_total


def run_limits(prompts: DataFrame, outputs: DataFrame) -> DataFrame:
    """``sample_id, n_run, cut, aborted, done``: how many outputs a sample's run has, which one ended it
    early (NULL: none), whether by an abort, and whether the run came to its end. Samples
    without a prompt have none."""
    stops = F.col("finish_reason").isin(LENGTH, ABORT)
    asked = prompts.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_turns"))
    said = outputs.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_outputs"),
        F.min(F.when(stops, F.col("turn_ix"))).alias("cut"),
        F.min_by(F.when(stops, F.col("finish_reason")), F.when(stops, F.col("turn_ix"))).alias("reason"),
    )
    n_outputs = F.coalesce("n_outputs", F.lit(0))
    limits = asked.join(said, "sample_id", "left").withColumn(
        "n_run", F.least("n_turns", n_outputs, F.coalesce(F.col("cut") + 1, n_outputs))
    )
    # An end early counts only where the run reaches it.
    early = F.coalesce(F.col("cut") + 1 == F.col("n_run"), F.lit(False))
    return limits.select(
        "sample_id",
        "n_run",
        F.when(early, F.col("cut")).alias("cut"),
        (early & (F.col("reason") == ABORT)).alias("aborted"),
        (early | (F.col("n_run") == F.col("n_turns"))).alias("done"),
    )


def trajectory_rows(
    prompts: DataFrame, outputs: DataFrame, template: ChatTemplate = CHATML, tokenizer=PIECES
) -> DataFrame:
    """``sample_id, place, learned, text, tokens, logprobs, finish, offset`` for each turn of every run.

    Prompt turn k has the even place 2k and the output to it the odd one after. ``offset`` is the
    turn's place in the sample's tokens. An output's tokens are its recorded ones where present;
    they are learned. Log-probabilities are those recorded, and zeros for a prompt turn that
    follows recorded ones. ``finish`` is the reason of the output that ended the run. An aborted
    sample keeps one row without text at place -1. The rows of a sample, in order, are its
    record's fields.
    """
    limits = run_limits(prompts, outputs)
    columns = ("sample_id", "place", "learned", "text", "_own", "logprobs", "finish")
    nothing = F.lit(None).cast("string")
    known = outputs.select("sample_id", "turn_ix", *output_fields(outputs))
    answered = known.select("sample_id", (F.col("turn_ix") + 1).alias("turn_ix"), F.col("logprobs").isNotNull().alias("_recorded"))
    asked = prompts.join(limits.filter("NOT aborted"), "sample_id").filter(
        (F.col("turn_ix") <= F.col("n_run")) & ~F.coalesce(F.col("turn_ix") == F.col("cut") + 1, F.lit(False))
    )
    turn = F.when(F.col("turn_ix") == 0, template.opening(F.col("role"), F.col("content"))).otherwise(
        template.turn(F.col("role"), F.col("content"))
    )
    tokens = F.lit(None).cast(known.schema["token_ids"].dataType)
    sent = asked.join(answered, ["sample_id", "turn_ix"], "left").select(
        "sample_id",
        (F.col("turn_ix") * 2).cast("long").alias("place"),
        F.lit(0).alias("learned"),
        F.concat(turn, F.lit(template.generation_header)).alias("text"),
        tokens.alias("_own"),
        F.when((F.col("turn_ix") > 0) & F.col("_recorded"), F.array().cast("array<double>")).alias("logprobs"),
        nothing.alias("finish"),
    )
    said = known.join(limits.filter("NOT aborted"), "sample_id").filter(F.col("turn_ix") < F.col("n_run")).select(
        "sample_id",
        (F.col("turn_ix") * 2 + 1).cast("long").alias("place"),
        F.lit(1).alias("learned"),
        "text",
        F.col("token_ids").alias("_own"),
        "logprobs",
        F.when(F.col("done") & (F.col("turn_ix") + 1 == F.col("n_run")), F.col("finish_reason")).alias("finish"),
    )
    lost = limits.filter("aborted").select(
        "sample_id", F.lit(-1).cast("long").alias("place"), F.lit(0).alias("learned"), nothing.alias("text"),
        tokens.alias("_own"), F.lit(None).cast("array<double>").alias("logprobs"), F.lit(ABORT).alias("finish"),
    )
    rows = sent.select(*columns).unionByName(said.select(*columns)).unionByName(lost.select(*columns))
    split = rows.withColumn("_split", tokenizer.one(F.col("text")))
    full = F.when(F.col("text").isNotNull(), F.coalesce("_own", "_split"))
    split = split.withColumn("tokens", full).withColumn(
        "logprobs",
        F.when((F.col("learned") == 0) & F.col("logprobs").isNotNull(), repeat(0.0, F.size("tokens"))).otherwise(F.col("logprobs")),
    )
    length = F.coalesce(F.size("tokens"), F.lit(0))
    placed = with_running_total(split.drop("_own", "_split"), "sample_id", "place", length, "offset")
    return placed.select("sample_id", "place", "learned", "text", "tokens", "logprobs", "finish", "offset")


def trajectory_totals(rows: DataFrame) -> DataFrame:
    """``sample_id, prompt_length, response_length, logprobs_match, status``: scalars of each sample.

    Lengths are tokens; NULL where the sample was aborted. Log-probabilities match where every token
    of the response has one, or none is recorded.
    """
    size = F.size("tokens").cast("long")
    after = F.col("place") > 0
    sums = rows.groupBy("sample_id").agg(
        F.sum(F.when(F.col("place") == 0, size)).alias("_prompt"),
        F.sum(F.when(after, size)).alias("_response"),
        F.sum(F.when(after, F.size("logprobs"))).alias("_logprobs"),
        F.bool_or(F.col("place") < 0).alias("_aborted"),
        F.max("finish").alias("_finish"),
    )
    response = F.coalesce("_response", F.lit(0))
    return sums.select(
        "sample_id",
        F.when(~F.col("_aborted"), F.col("_prompt")).alias("prompt_length"),
        F.when(~F.col("_aborted"), response).alias("response_length"),
        F.coalesce(F.col("_logprobs") == response, F.lit(True)).alias("logprobs_match"),
        status_of(F.col("_finish")).alias("status"),
    )
