"""Multi-turn trajectories from prompts and recorded model outputs.

``prompts(sample_id, turn_ix, role, content)`` holds the turns the user side sends and
``outputs(sample_id, turn_ix, text, finish_reason [, token_ids, logprobs])`` what the
model answered to each, both numbered from 0 without gaps. A sample of any length is one
row with both lists and is put together without a further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.arrays import let, repeat
from turnloom.functions.template import CHATML, ChatTemplate, payload_flags
from turnloom.functions.tokens import PIECES

# Finish reasons and the statuses they lead to.
LENGTH, STOP, ABORT = "length", "stop", "abort"
STATUSES = {LENGTH: "TRUNCATED", ABORT: "ABORTED", STOP: "COMPLETED"}


def status_of(finish: Column) -> Column:
    """Status for the last finish reason; any other reason leaves it unset."""
    column = F.lit(None).cast("string")
    for reason, status in STATUSES.items():
        column = F.when(finish == reason, status).otherwise(column)
    return column


def output_fields(outputs: DataFrame) -> list[Column]:
    """Text, finish reason, recorded tokens and log-probabilities, absent ones as NULL."""
    tokens = (
        F.col("token_ids")
        if "token_ids" in outputs.columns
        else F.lit(None).cast("array<string>")
    )
    logprobs = (
        F.col("logprobs") if "logprobs" in outputs.columns else F.lit(None).cast("array<double>")
    )
    return [
        F.col("text"),
        F.col("finish_reason"),
        tokens.alias("token_ids"),
        logprobs.alias("logprobs"),
    ]


def gather_samples(prompts: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row per sample with the arrays ``prompt`` and ``outputs``; a single shuffle."""
    ask = F.struct("role", "content")
    answer = F.struct(*output_fields(outputs))
    asked = prompts.select("sample_id", F.struct("turn_ix", ask.alias("item")).alias("_ask"))
    said = outputs.select("sample_id", F.struct("turn_ix", answer.alias("item")).alias("_said"))
    listed = lambda name: F.transform(
        F.sort_array(F.collect_list(name)), lambda row: row["item"]
    )
    return (
        asked.unionByName(said, allowMissingColumns=True)
        .groupBy("sample_id")
        .agg(listed("_ask").alias("prompt"), listed("_said").alias("outputs"))
    )


def build_trajectories(
    samples: DataFrame,
    template: ChatTemplate = CHATML,
    tokenizer=PIECES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Trajectories of samples with the arrays ``prompt`` and ``outputs``; no shuffle.

    Turns run in order up to the first output cut by length, an abort, or the last
    prompt. After each output comes the next prompt turn, unless the run ends there.
    Output tokens are the recorded ones where present; they are learned, and those of
    prompt turns are not. An aborted sample keeps its status and nothing else.
    """
    n_turns, n_outputs = F.size("prompt"), F.size("outputs")
    stops = F.transform("outputs", lambda o: o["finish_reason"].isin(LENGTH, ABORT))
    cut = F.array_position(stops, F.lit(True)).cast("int")
    n_run = F.least(n_turns, n_outputs, F.when(F.col("_cut") > 0, F.col("_cut")).otherwise(n_outputs))

    def follow(data: Column) -> Column:
        def turn(_, k):
            more = (k + 1 < F.size(data["prompt"])) & (k + 1 != data["cut"])
            message = F.get(data["prompt"], k + 1)
            body = template.turn(message["role"], message["content"])
            return F.when(more, F.concat(body, F.lit(template.generation_header))).otherwise("")

        return F.transform(data["run"], turn)

    bound = F.struct(
        F.col("prompt"), F.col("_run").alias("run"), F.col("_cut").alias("cut")
    )
    final = F.get("_run", F.size("_run") - 1)["finish_reason"]
    done = (F.size("_run") == n_turns) | (F.size("_run") == F.col("_cut"))
    first = F.col("prompt")[0]
    opening = F.concat(
        template.opening(first["role"], first["content"]), F.lit(template.generation_header)
    )
    laid_out = (
        samples.withColumn("_cut", cut)
        .withColumn("_run", F.slice("outputs", F.lit(1), n_run))
        .withColumn("_texts", F.transform("_run", lambda o: o["text"]))
        .withColumn("_follows", let(bound, follow))
        .withColumn("_finish", F.when(done & (F.size("_run") > 0), final))
        .withColumn("_opening", opening)
        .withColumn("_tokenised", tokenizer.many(F.col("_texts")))
        .withColumn("_between", tokenizer.many(F.col("_follows")))
        .withColumn(
            "_own",
            F.zip_with(
                "_run", "_tokenised", lambda o, t: F.coalesce(o["token_ids"], t)
            ),
        )
    )
    tokens = F.flatten(F.zip_with("_own", "_between", lambda a, b: F.concat(a, b)))
    mask = F.flatten(
        F.zip_with(
            "_own",
            "_between",
            lambda a, b: F.concat(repeat(1, F.size(a)), repeat(0, F.size(b))),
        )
    )
    logprobs = F.flatten(
        F.zip_with(
            "_run",
            "_between",
            lambda o, b: F.when(
                o["logprobs"].isNotNull(), F.concat(o["logprobs"], repeat(0.0, F.size(b)))
            ).otherwise(F.array().cast("array<double>")),
        )
    )
    response = F.array_join(
        F.zip_with("_texts", "_follows", lambda text, follow: F.concat(text, follow)), ""
    )
    recorded = F.exists("_run", lambda o: o["logprobs"].isNotNull())
    run = F.coalesce(F.col("_finish") != ABORT, F.lit(True))
    payload = F.concat("_opening", "_response")
    has_system, has_tools = payload_flags(payload)
    joined = laid_out.select(
        "sample_id",
        *keep,
        "_opening",
        "_finish",
        response.alias("_response"),
        tokenizer.one(F.col("_opening")).alias("_prompt_tokens"),
        tokens.alias("_tokens"),
        mask.alias("_mask"),
        F.when(recorded, logprobs).alias("_logprobs"),
    )
    return joined.select(
        "sample_id",
        *keep,
        F.when(run, F.col("_opening")).alias("prompt"),
        F.when(run, F.col("_response")).alias("response"),
        F.when(run, F.concat("_prompt_tokens", "_tokens")).alias("tokens"),
        F.when(run, F.col("_mask")).alias("loss_mask"),
        F.when(run, F.size("_mask")).alias("response_length"),
        F.when(run, F.col("_logprobs")).alias("logprobs"),
        F.coalesce(F.size("_logprobs") == F.size("_mask"), F.col("_logprobs").isNull()).alias(
            "logprobs_match"
        ),
        status_of(F.col("_finish")).alias("status"),
        F.when(run, payload).alias("payload_text"),
        F.when(run, has_system).alias("payload_has_system"),
        F.when(run, has_tools).alias("payload_has_tools"),
    )
