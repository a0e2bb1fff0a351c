"""Every operator bound to the given tables.

Chat data comes from ``conversations(conv_id, turn, role, text)``. Verifiers, finish
reasons and judge replies are derived from its keys by arithmetic, so that they grow with
the table and an SQL statement can derive the same ones.
"""

from __future__ import annotations

import asyncio

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.arrays import response_length, sublist_positions
from turnloom.functions.template import CHATML, ChatTemplate, payload_flags
from turnloom.functions.text import judge_verdict, rule_verdict, tag_content, word_count
from turnloom.functions.tokens import PIECES
from turnloom.operators import keep, lossmask, order, pool, readouts, records, reward, spans, trajectory, trajectoryrows, vocab
from turnloom.operators.arrayreward import array_rewards
from turnloom.operators.judge import CONSTRAINT, HELPFULNESS, judge_requests
from turnloom.operators.packing import balanced_packs, epochs, packs
from turnloom.operators.rulekinds import catalogue, measures, verdicts
from turnloom.operators.rules import RuleBook
from turnloom.operators.turns import gather, with_running_total
from turnloom.plans.scoring import record_rewards
from turnloom.plans.sft import sft_samples
from turnloom.session import new_path, stored
from turnloom.sources.tables import read_dataset, read_jsonl, read_untyped, untyped_messages, write_jsonl

# The default limits reject nothing in the given table; these do.
MAX_TURNS, BUDGET = 3, 300
MESSAGES = "array<struct<role:string,content:string>>"


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def kept(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations that pass the filters, one row each: what the recipe trains on."""
    return keep.keep_turns(
        conversations(spark, sf), "conv_id", "turn", max_turns=MAX_TURNS, budget=BUDGET
    )


def whole(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations as records."""
    turns = conversations(spark, sf).withColumnRenamed("text", "content")
    return gather(turns, "conv_id", "turn", ["role", "content"], "messages")


def ranked(turns: DataFrame, role: str) -> DataFrame:
    """The turns of one role with their rank ``k`` inside the conversation."""
    only = turns.filter(F.col("role") == role)
    return with_running_total(only, "conv_id", "turn", F.lit(1), "k")


def rendered() -> Column:
    return CHATML.turn(F.col("role"), F.col("text"))


def bits(mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda b: b.cast("string")), "")


# Filters


def filter_turn_limit(spark, sf):
    measures = keep.turn_measures(conversations(spark, sf), "conv_id", "turn", wanted=("n_messages",))
    return measures.filter(F.col("n_messages") <= 2 * MAX_TURNS).select("conv_id", "n_messages")


def filter_word_budget(spark, sf):
    measures = keep.turn_measures(conversations(spark, sf), "conv_id", "turn", wanted=("n_words_before_last",))
    return measures.filter(F.col("n_words_before_last") < BUDGET).select(
        "conv_id", "n_words_before_last"
    )


def filter_role_alternation(spark, sf):
    measures = keep.turn_measures(conversations(spark, sf), "conv_id", "turn", wanted=("roles_ok",))
    return measures.filter("roles_ok").select("conv_id")


def untyped_turns(spark, sf) -> DataFrame:
    """Turns whose content is sometimes a number, a list or missing."""
    kind = F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(23))
    content = (
        F.when(kind == 0, F.parse_json(F.lit("42")))
        .when(kind == 1, F.parse_json(F.lit('["a","b"]')))
        .when(kind == 2, F.lit(None).cast("variant"))
        .otherwise(F.col("text").cast("variant"))
    )
    return conversations(spark, sf).withColumn("content", content)


def filter_content_type(spark, sf):
    wanted = ("n_messages", "content_ok")
    measures = keep.turn_measures(untyped_turns(spark, sf), "conv_id", "turn", content="content", wanted=wanted)
    return measures.filter("content_ok").select("conv_id", "n_messages")


def sft_filter_untyped(spark, sf):
    found = keep.keep_turns(
        untyped_turns(spark, sf),
        "conv_id",
        "turn",
        content="content",
        max_turns=MAX_TURNS,
        budget=BUDGET,
    )
    texts = F.transform("messages", lambda m: F.try_variant_get(m["content"], "$", "string"))
    return found.select("conv_id", F.array_join(texts, "|").alias("texts"))


def untyped_jsonl(spark, sf):
    """The untyped turns as records in JSON lines, read back without a schema and filtered."""
    message = F.struct("turn", "role", F.to_json("content").alias("content"))
    turns = untyped_turns(spark, sf).groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("m"))
    # As other programs write them: a content that is missing has no key.
    part = lambda m: F.concat(
        F.lit('{"role":'),
        F.concat(F.lit('"'), m["role"], F.lit('"')),
        F.coalesce(F.concat(F.lit(',"content":'), m["content"]), F.lit("")),
        F.lit("}"),
    )
    line = F.concat(
        F.lit('{"id":'), F.col("conv_id").cast("string"), F.lit(',"messages":['), F.array_join(F.transform("m", part), ","), F.lit("]}")
    )
    path = new_path(spark, "untyped")
    turns.select(line.alias("value")).write.text(path)
    records = read_untyped(spark, path)
    found = keep.keep_records(
        records.withColumn("messages", untyped_messages(F.col("record"))), max_turns=MAX_TURNS, budget=BUDGET
    )
    texts = F.transform("messages", lambda m: F.try_variant_get(m["content"], "$", "string"))
    return found.select(
        F.try_variant_get("record", "$.id", "bigint").alias("conv_id"), F.array_join(texts, "|").alias("texts")
    )


def sft_filter(spark, sf):
    return kept(spark, sf).select(
        "conv_id",
        "n_messages",
        "n_words_before_last",
        F.array_join(
            F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"
        ).alias("messages"),
    )


def sft_filter_counts(spark, sf):
    measures = keep.turn_measures(conversations(spark, sf), "conv_id", "turn")
    passed = (
        (F.col("n_messages") <= 2 * MAX_TURNS)
        & (F.col("n_words_before_last") < BUDGET)
        & F.col("roles_ok")
        & F.col("content_ok")
    )
    return measures.agg(
        F.count(F.lit(1)).alias("loaded"), F.count_if(passed).alias("kept")
    )


def count_words(spark, sf):
    return documents(spark, sf).select("doc_id", word_count(F.col("text")).alias("n_words"))


def running_words(spark, sf):
    turns = conversations(spark, sf)
    counted = with_running_total(
        turns, "conv_id", "turn", word_count(F.col("text")), "words_before"
    )
    return counted.select("conv_id", "turn", "words_before")


# Records, order, files


def prompt_heads(spark, sf):
    users = conversations(spark, sf).filter(F.col("role") == "user")
    heads = records.prompt_heads(users, "conv_id", "turn", "text")
    return heads.select(
        "conv_id",
        "prompt",
        F.lit(records.LABEL).alias("label"),
        F.col("n_turns"),
        (F.col("n_turns") - 1).alias("n_follow_ups"),
    )


def instructions(spark, sf) -> DataFrame:
    """User turns as prompts with one constraint per turn."""
    users = ranked(conversations(spark, sf), "user").withColumnRenamed("text", "content")
    gathered = gather(users, "conv_id", "k", ["role", "content"], "prompt")
    verifier = F.transform(
        "prompt",
        lambda m, i: F.array(
            F.struct(
                F.pmod(F.col("conv_id") + i, F.lit(4))
                .cast("string")
                .alias("id"),
                F.lit("the").alias("placeholder"),
            )
        ),
    )
    persona = F.concat(F.lit("persona "), F.pmod(F.col("conv_id"), F.lit(7)).cast("string"))
    return gathered.select(
        F.col("conv_id").cast("string").alias("id"),
        "conv_id",
        "prompt",
        verifier.alias("verifier"),
        persona.alias("persona"),
        F.when(F.pmod(F.col("conv_id"), F.lit(5)) == 0, "eval").otherwise("train").alias("split"),
    )


def prompt_records(spark, sf):
    shaped = records.prompt_records(instructions(spark, sf), keep=("conv_id",))
    first, rest, n_turns = records.first_and_rest(F.col("metadata.prompt"))
    ids = F.transform("metadata.verifier", lambda turn: turn[0]["id"])
    return shaped.select(
        "conv_id",
        "prompt",
        "label",
        F.col("metadata.id").alias("id"),
        F.col("metadata.persona").alias("persona"),
        F.array_join(ids, ",").alias("verifier_ids"),
        first["content"].alias("first_text"),
        F.array_join(F.transform(rest, lambda m: m["content"]), "|").alias("rest_text"),
        n_turns.cast("long").alias("n_turns"),
    )


RECORD = (
    "prompt string, label string, metadata struct<id:string,"
    f"prompt:{MESSAGES},verifier:array<array<struct<id:string,placeholder:string>>>,"
    "persona:string>, split string"
)


def split_roundtrip(spark, sf):
    """Both splits written as JSON lines in random order; the training split read back."""
    shaped = records.prompt_records(instructions(spark, sf), keep=("split", "conv_id"))
    path = new_path(spark, "prompts")
    write_jsonl(order.shuffled(shaped, ["conv_id"], seed=7).drop("conv_id"), path, split="split")
    back = read_dataset(spark, path, split="train", schema=RECORD)
    return back.select(
        F.col("metadata.id").alias("id"),
        "prompt",
        "label",
        F.size("metadata.prompt").cast("long").alias("n_turns"),
    )


def jsonl_roundtrip(spark, sf):
    """Kept conversations written as JSON lines and read back by key."""
    path = new_path(spark, "sft")
    note = F.lit(None).cast("string").alias("note")
    write_jsonl(kept(spark, sf).select("conv_id", "messages", note), path)
    schema = f"conv_id long, messages {MESSAGES}, note string"
    back = read_jsonl(spark, path, schema, {"id": "conv_id", "chat": "messages", "note": "note"})
    return back.select("id", CHATML.render(F.col("chat")).alias("rendered"), "note")


def shuffle_batches(spark, sf):
    ids = conversations(spark, sf).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return order.batches(ids, ["conv_id"], batch_size=16, seed=7)


# Text


def chat_render(spark, sf):
    return conversations(spark, sf).select("conv_id", "turn", rendered().alias("rendered"))


def chat_render_generation(spark, sf):
    with_system = ChatTemplate(default_system="You help.")
    text = with_system.render(F.col("messages"), generation=True)
    return whole(spark, sf).select("conv_id", text.alias("rendered"))


def payload_marks(spark, sf):
    """Do the rendered turns of a conversation hold the marks; a mark never spans turns."""
    has_system, has_tools = payload_flags(rendered())
    return (
        conversations(spark, sf)
        .select("conv_id", has_system, has_tools)
        .groupBy("conv_id")
        .agg(
            F.bool_or("payload_has_system").alias("payload_has_system"),
            F.bool_or("payload_has_tools").alias("payload_has_tools"),
        )
    )


def assistant_spans(spark, sf):
    spans = CHATML.assistant_spans(rendered())
    return conversations(spark, sf).select(
        "conv_id", "turn", F.explode(spans).alias("response")
    )


def record_spans(spark, sf):
    """The spans of whole rendered conversations."""
    spans = CHATML.assistant_spans(CHATML.render(F.col("messages")))
    return whole(spark, sf).select("conv_id", F.posexplode(spans).alias("turn_ix", "response")).select(
        "conv_id", F.col("turn_ix").cast("long").alias("turn_ix"), "response"
    )


def tag_extract(spark, sf):
    """A tag around the text, an empty tag, or no tag, by key."""
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    after = "\n </answer><answer>no</answer>"
    text = (
        F.when(kind == 0, F.concat(F.lit("so <ANSWER> \n"), F.col("text"), F.lit(after)))
        .when(kind == 1, F.concat(F.col("text"), F.lit("<answer></answer>")))
        .when(kind == 2, F.concat(F.lit("<answer>YES </Answer>"), F.col("text")))
        .otherwise(F.col("text"))
    )
    tagged = conversations(spark, sf).select("conv_id", "turn", text.alias("wrapped"))
    wrapped = F.col("wrapped")
    return tagged.select(
        "conv_id",
        "turn",
        tag_content(wrapped, "answer").alias("strict"),
        tag_content(wrapped, "answer", strict=False).alias("lenient"),
        judge_verdict(wrapped).alias("judge_passes"),
    )


def tag_pair(spark, sf):
    """The same with a pair of delimiters, and the verdict of a printed rule result."""
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    text = F.concat(F.lit("[[ "), F.col("text"), F.lit(" ]] [[later]]"))
    printed = (
        F.when(kind == 0, "<answer>True</answer>")
        .when(kind == 1, "<answer>False</answer>")
        .otherwise("<answer>1</answer>")
    )
    return conversations(spark, sf).select(
        "conv_id",
        "turn",
        tag_content(text, pair=("[[", "]]")).alias("content"),
        rule_verdict(printed).alias("rule_passes"),
    )


def tokenize(spark, sf):
    tokens = PIECES.one(rendered())
    return (
        conversations(spark, sf)
        .select("conv_id", "turn", F.col("text"), tokens.alias("tokens"))
        .select(
            "conv_id",
            "turn",
            F.size("tokens").cast("long").alias("n_tokens"),
            F.array_join("tokens", "|").alias("tokens"),
        )
    )


def _coded(spark, sf) -> tuple[DataFrame, DataFrame]:
    turns = conversations(spark, sf).withColumn("tokens", PIECES.one(rendered()))
    words = vocab.vocabulary(turns, F.col("tokens"), PIECES.specials)
    return vocab.encode(turns, "tokens", words, ["conv_id", "turn"]), words


def token_ids(spark, sf):
    coded, _ = _coded(spark, sf)
    ids = F.transform("tokens", lambda i: i.cast("string"))
    return coded.select("conv_id", "turn", F.array_join(ids, " ").alias("ids"))


def detokenize(spark, sf):
    coded, words = _coded(spark, sf)
    back = vocab.decode(coded, "tokens", words, ["conv_id", "turn"])
    return back.select("conv_id", "turn", PIECES.text(F.col("tokens")).alias("rendered"))


def sublist_search(spark, sf):
    """Where does a comma-free pattern of two tokens, the first one repeated, occur."""
    tokens = F.split("text", " ")
    part = F.slice(tokens, 1, 1)
    found = conversations(spark, sf).select(
        "conv_id", "turn", sublist_positions(tokens, part).alias("found")
    )
    return found.select(
        "conv_id",
        "turn",
        F.array_join(F.transform("found", lambda i: i.cast("string")), ",").alias("positions"),
    )


# Loss masks


def _turn_masks(spark, sf, kind: str, step: bool = False, template=CHATML) -> DataFrame:
    turns = conversations(spark, sf)
    if step:
        skip = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) == 0
        turns = turns.withColumn("step", F.when(skip, 0))
    masked = lossmask.with_turn_loss_mask(
        turns, "turn", kind, step="step" if step else None, template=template
    )
    return masked.select(
        "conv_id",
        "turn",
        F.array_join("tokens", "|").alias("tokens"),
        bits(F.col("loss_mask")).alias("loss_mask"),
        response_length(F.col("loss_mask")).alias("response_length"),
    )


def loss_mask_simple(spark, sf):
    return _turn_masks(spark, sf, lossmask.SIMPLE)


def loss_mask_qwen(spark, sf):
    """With a default system turn in the template and per-message overrides."""
    return _turn_masks(
        spark, sf, lossmask.QWEN, step=True, template=ChatTemplate(default_system="You help.")
    )


def loss_mask_qwen3(spark, sf):
    return _turn_masks(spark, sf, lossmask.QWEN3, step=True)


def loss_mask_distill(spark, sf):
    ends = lossmask.conversation_ends(conversations(spark, sf), "conv_id", "turn")
    masked = lossmask.with_loss_mask(ends, lossmask.DISTILL)
    return masked.select(
        "conv_id",
        F.array_join("tokens", "|").alias("tokens"),
        bits(F.col("loss_mask")).alias("loss_mask"),
    )


def mask_lengths(spark, sf):
    masked = lossmask.with_turn_loss_mask(conversations(spark, sf), "turn", lossmask.SIMPLE)
    return lossmask.mask_totals(masked, "conv_id", "turn")


def samples(spark, sf):
    return sft_samples(kept(spark, sf)).select(
        "conv_id",
        F.array_join("tokens", "|").alias("tokens"),
        bits(F.col("loss_mask")).alias("loss_mask"),
        F.col("response_length").cast("long").alias("response_length"),
        "reward",
    )


def mask_text_spans(spark, sf):
    masked = lossmask.with_loss_mask(whole(spark, sf))
    texts = lossmask.texts_under_mask(F.col("tokens"), F.col("loss_mask"))
    return masked.select("conv_id", F.posexplode(texts).alias("span_ix", "span")).select(
        "conv_id", F.col("span_ix").cast("long").alias("span_ix"), "span"
    )


def mask_span_rows(spark, sf):
    """The same from turns, without a row for a whole conversation."""
    masked = lossmask.with_turn_loss_mask(conversations(spark, sf), "turn")
    return spans.mask_span_rows(masked, "conv_id", "turn")


def token_view(spark, sf):
    rows = lossmask.token_rows(lossmask.with_loss_mask(whole(spark, sf)), ["conv_id"])
    return rows.select(
        "conv_id",
        F.col("ix").cast("long").alias("ix"),
        "token",
        F.col("mask").cast("long").alias("mask"),
    )


def multimodal_align(spark, sf):
    """Every second message as a list of parts; ids longer than the text by a few.

    Every third message carries an override that takes it out of the loss; one that is a
    list of parts loses it.
    """

    def parts(content: Column) -> Column:
        text = F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text")))
        others = F.lit(',"tail",{"type":"image"},{"type":"text"}]')
        return F.parse_json(F.concat(F.lit("["), text, others))

    mixed = F.transform(
        "messages",
        lambda m, i: F.struct(
            m["role"].alias("role"),
            F.when(i % 2 == 0, parts(m["content"]))
            .otherwise(m["content"].cast("variant"))
            .alias("content"),
            F.when(i % 3 == 0, 0).alias("step_loss_mask"),
        ),
    )
    flat = lossmask.flatten_messages(
        whole(spark, sf).select("conv_id", mixed.alias("messages"))
    )
    masked = lossmask.with_loss_mask(flat)
    extra = F.pmod(F.col("conv_id"), F.lit(5)).cast("int")
    ids = F.sequence(F.lit(1), F.size("loss_mask") + extra)
    return masked.select(
        "conv_id",
        F.array_join("tokens", "").alias("text"),
        bits(lossmask.align_mask(F.col("loss_mask"), ids)).alias("loss_mask"),
        bits(F.transform("messages", lambda m: F.coalesce(m["step_loss_mask"], F.lit(1)))).alias("learned"),
    )


# Trajectories


def drawn_finish(k: Column) -> Column:
    draw = F.pmod(F.col("conv_id") * 3 + k * 5, F.lit(13))
    return (
        F.when(draw == 0, trajectory.LENGTH)
        .when(draw == 1, trajectory.ABORT)
        .when(draw == 2, "other")
        .otherwise(trajectory.STOP)
    )


def recorded_output(k: Column, text: Column, tokens: bool) -> Column:
    """An assistant turn as a recorded output.

    Outputs cut by length lack the end mark. On request, even conversations carry recorded
    tokens and log-probabilities, some with a gap.
    """
    finish = drawn_finish(k)
    ended = F.concat(text, F.when(finish == trajectory.LENGTH, "").otherwise(CHATML.terminator))
    if not tokens:
        return F.struct(
            ended.alias("text"),
            finish.alias("finish_reason"),
            F.lit(None).cast("array<string>").alias("token_ids"),
            F.lit(None).cast("array<double>").alias("logprobs"),
        )
    known = (F.pmod(F.col("conv_id"), F.lit(2)) == 0) & ~(
        (F.pmod(F.col("conv_id"), F.lit(6)) == 0) & (k == 1)
    )
    own = F.when(known, PIECES.one(ended))
    return F.struct(
        ended.alias("text"),
        finish.alias("finish_reason"),
        own.alias("token_ids"),
        F.transform(own, lambda _: F.lit(-0.5)).alias("logprobs"),
    )


def recorded_samples(turns: DataFrame, tokens: bool) -> DataFrame:
    """User turns as prompts and assistant turns as recorded outputs, one row per sample."""
    spoken = gather(turns, "conv_id", "turn", ["role", "text"], "turns")
    users = F.filter("turns", lambda m: m["role"] == "user")
    answers = F.filter("turns", lambda m: m["role"] == "assistant")
    prompt = F.transform(
        users, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))
    )
    return spoken.select(
        "conv_id",
        F.col("conv_id").alias("sample_id"),
        prompt.alias("prompt"),
        F.transform(answers, lambda m, k: recorded_output(k, m["text"], tokens)).alias("outputs"),
    ).filter(F.size("prompt") > 0)


def trajectories(spark, sf):
    built = trajectory.build_trajectories(recorded_samples(conversations(spark, sf), tokens=True))
    total = F.aggregate("logprobs", F.lit(0.0), lambda a, b: a + b)
    return built.select(
        "sample_id",
        "prompt",
        "response",
        F.array_join("tokens", "|").alias("tokens"),
        bits(F.col("loss_mask")).alias("loss_mask"),
        F.col("response_length").cast("long").alias("response_length"),
        total.alias("logprob_sum"),
        "logprobs_match",
        "status",
        F.length("payload_text").cast("long").alias("payload_chars"),
        "payload_has_system",
        "payload_has_tools",
    )


def recorded_turns(spark, sf) -> tuple[DataFrame, DataFrame]:
    """User turns as prompts and assistant turns as recorded outputs, one row each."""
    turns = conversations(spark, sf)
    prompts = ranked(turns, "user").select(
        F.col("conv_id").alias("sample_id"), F.col("k").alias("turn_ix"), "role", F.col("text").alias("content")
    )
    said = ranked(turns, "assistant").select("conv_id", "k", recorded_output(F.col("k"), F.col("text"), True).alias("o"))
    return prompts, said.select(F.col("conv_id").alias("sample_id"), F.col("k").alias("turn_ix"), "o.*")


def trajectory_turns(spark, sf):
    """Trajectories as rows of turns with their places in the token sequence."""
    rows = trajectoryrows.trajectory_rows(*recorded_turns(spark, sf)).filter("place >= 0")
    return rows.select(
        "sample_id",
        "place",
        F.col("learned").cast("long").alias("learned"),
        "text",
        F.array_join("tokens", "|").alias("tokens"),
        F.col("offset").alias("token_offset"),
        F.coalesce(F.size("logprobs").cast("long"), F.lit(-1)).alias("n_logprobs"),
    )


def trajectory_totals(spark, sf):
    """Lengths and status of trajectories from rows of turns."""
    return trajectoryrows.trajectory_totals(trajectoryrows.trajectory_rows(*recorded_turns(spark, sf)))


# Constraints and scoring

CONSTRAINTS = (
    "id string, ord int, constraint string, verifier_type string, content_template boolean,"
    " rules array<struct<kind:string,arg:string>>"
)
ROWS = [
    ("0", 0, "Use at least 40 words.", "hard", False, [("min_words", "40")]),
    ("1", 1, "Use the word {placeholder}.", "hard", True, [("contains", "the")]),
    (
        "2",
        2,
        "Use 5 to 120 words.",
        "hard",
        False,
        [("min_words", "5"), ("max_words", "120")],
    ),
    ("3", 3, "Be kind.", "soft", False, []),
]


def rule_book() -> RuleBook:
    """Rules as the author of a job would register them."""
    words = lambda response: word_count(response)
    number = lambda arg: arg.try_cast("int")
    return (
        RuleBook()
        .column("min_words", lambda response, arg: words(response) >= number(arg))
        .column("max_words", lambda response, arg: words(response) <= number(arg))
        .column("contains", lambda response, arg: F.contains(response, arg))
    )


def constraint_table(spark) -> DataFrame:
    return pool.constraint_index(spark.createDataFrame(ROWS, CONSTRAINTS), "ord")


def verifier_list(k: Column) -> Column:
    """Two constraints for turn ``k``, or none for some turns."""
    at = F.col("conv_id") + k
    word = F.when(F.pmod(F.col("conv_id"), F.lit(2)) == 0, "the").otherwise("que")
    check = lambda shift: F.struct(
        F.pmod(at + shift, F.lit(4)).cast("string").alias("id"), word.alias("placeholder")
    )
    both = F.array(check(0), check(1))
    return F.when(F.pmod(at, F.lit(7)) == 6, F.slice(both, 1, 0)).otherwise(both)


def judgements(turns: DataFrame) -> DataFrame:
    """Recorded judge replies to both kinds of questions; some failed, some are missing."""
    draw = F.pmod(F.col("conv_id") * 7 + F.col("k") * 3, F.lit(5))
    reply = (
        F.when(draw == 0, "<answer>no</answer>")
        .when(draw == 1, F.lit(None).cast("string"))
        .when(draw == 2, "none")
        .otherwise("<answer> YES </answer>")
    )
    asked = F.array(
        F.struct(F.lit("3").alias("id"), F.lit(CONSTRAINT).alias("kind")),
        F.struct(F.lit("0").alias("id"), F.lit(HELPFULNESS).alias("kind")),
    )
    return (
        turns.filter(F.pmod(F.col("conv_id") + F.col("k"), F.lit(11)) != 0)
        .select("conv_id", "k", reply.alias("verdict_text"), F.explode(asked).alias("_asked"))
        .select(
            F.col("conv_id").alias("sample_id"),
            F.col("k").alias("turn_ix"),
            F.col("_asked.id").alias("constraint_id"),
            F.col("_asked.kind").alias("kind"),
            "verdict_text",
        )
    )


def turn_checks(spark, sf) -> DataFrame:
    """Checks of assistant turns; each turn's span and list are made in its own row."""
    turns = conversations(spark, sf)
    spoken = ranked(turns, "assistant").select(
        F.col("conv_id").alias("sample_id"),
        F.col("k").alias("turn_ix"),
        CHATML.assistant_spans(rendered())[0].alias("response"),
        verifier_list(F.col("k")).alias("verifier"),
    )
    silent = turns.groupBy(F.col("conv_id").alias("sample_id")).agg(
        F.bool_or(F.col("role") == "assistant").alias("_speaks")
    )
    return reward.checks_from_turns(spoken, silent.filter("NOT _speaks"))


def scored(spark, sf, rate: float = 0.0) -> DataFrame:
    turns = ranked(conversations(spark, sf), "assistant")
    return reward.score_checks(
        turn_checks(spark, sf),
        constraint_table(spark),
        rule_book(),
        judgements(turns),
        rate,
        seed=3,
    )


def constraint_index(spark, sf):
    """A constraint table with many rows per id, drawn from the documents."""
    rows = documents(spark, sf).select(
        F.pmod(F.col("doc_id"), F.lit(97)).alias("id"),
        F.col("doc_id").alias("ord"),
        F.col("text").alias("constraint"),
        F.when(F.pmod(F.col("doc_id"), F.lit(3)) == 0, "soft").otherwise("hard").alias("verifier_type"),
        (F.col("n_chars") > 500).alias("content_template"),
    )
    return pool.constraint_index(rows, "ord")


def constraint_lookup(spark, sf):
    checks = turn_checks(spark, sf)
    named = pool.with_constraints(
        checks.filter(F.col("id").isNotNull()), constraint_table(spark)
    )
    return named.select(
        "sample_id",
        "turn_ix",
        F.col("ver_ix").cast("long").alias("ver_ix"),
        "id",
        "constraint",
        "verifier_type",
        F.when(F.col("content_template"), F.col("placeholder")).alias("argument"),
    )


def unknown_constraints(spark, sf):
    checks = turn_checks(spark, sf)
    known = constraint_table(spark).filter(F.col("id").isin("0", "3"))
    return pool.unknown_constraints(checks, known)


def rule_results(spark, sf):
    return (
        scored(spark, sf)
        .filter(F.col("id").isNotNull())
        .select(
            "sample_id", "turn_ix", F.col("ver_ix").cast("long").alias("ver_ix"), "id", "ok"
        )
    )


def turn_pass(spark, sf):
    return reward.turn_passes(scored(spark, sf))


def judge_verdicts(spark, sf):
    return (
        scored(spark, sf)
        .filter(F.col("verifier_type") == "soft")
        .select("sample_id", "turn_ix", "id", "verdict", "ok")
    )


def helpfulness_veto(spark, sf):
    """Half of the hard constraints are also asked for helpfulness."""
    return reward.rewards(scored(spark, sf, rate=0.5))


def judge_request_table(spark, sf):
    return judge_requests(scored(spark, sf), rate=0.5, seed=3).select(
        "sample_id",
        "turn_ix",
        F.col("ver_ix").cast("long").alias("ver_ix"),
        "constraint_id",
        "kind",
        "prompt",
    )


def turn_reward(spark, sf):
    return reward.rewards(scored(spark, sf))


def conversation_reward(spark, sf):
    """The flagship: recorded outputs to trajectories, spans, checks and rewards."""
    turns = conversations(spark, sf)
    samples = recorded_samples(turns, tokens=False).withColumn(
        "verifier", F.transform("prompt", lambda m, k: verifier_list(k))
    )
    checks = reward.checks_from_records(
        trajectory.build_trajectories(samples, keep=("verifier",))
    )
    replies = judgements(ranked(turns, "user"))
    scored = reward.score_checks(checks, constraint_table(spark), rule_book(), replies)
    return reward.rewards(scored)


def record_reward(spark, sf):
    """Rewards of whole samples: rendered conversations with their verifier lists."""
    at = lambda i: F.col("conv_id") + i
    spoken = F.filter("messages", lambda m: m["role"] == "assistant")
    lists = F.transform(
        spoken,
        lambda m, i: F.array(
            F.struct(
                F.pmod(at(i), F.lit(4)).cast("string").alias("id"), F.lit("the").alias("placeholder")
            )
        ),
    )
    samples = kept(spark, sf).select(
        F.col("conv_id").alias("sample_id"),
        CHATML.render(F.slice("messages", 1, 1), generation=True).alias("prompt"),
        F.concat(
            F.get("messages", F.lit(1))["content"],
            F.lit(CHATML.terminator),
            CHATML.render(F.slice("messages", F.lit(3), F.greatest(F.size("messages") - 2, F.lit(0)))),
        ).alias("response"),
        lists.alias("verifier"),
    )
    return record_rewards(samples, constraint_table(spark), rule_book())


def array_reward(spark, sf):
    """Rewards of whole conversations in their rows, judge replies beside them; every tenth
    conversation lacks its last list."""
    spoken = F.filter("messages", lambda m: m["role"] == "assistant")
    lists = F.transform(spoken, lambda m, k: verifier_list(k))
    fewer = F.slice(lists, F.lit(1), F.greatest(F.size(lists) - 1, F.lit(0)))

    def reply(k: Column) -> Column:
        draw = F.pmod(F.col("conv_id") * 7 + k * 3, F.lit(5))
        text = F.when(draw == 0, "<answer>no</answer>").when(draw == 2, "none").when(draw > 2, "<answer> YES </answer>")
        return F.struct(
            k.cast("long").alias("turn_ix"), F.lit("3").alias("constraint_id"), F.lit(CONSTRAINT).alias("kind"), text.alias("verdict_text")
        )

    replies = F.filter(
        F.transform(spoken, lambda m, k: reply(k)), lambda j: F.pmod(F.col("conv_id") + j["turn_ix"], F.lit(11)) != 0
    )
    samples = whole(spark, sf).select(
        F.col("conv_id").alias("sample_id"),
        CHATML.render(F.slice("messages", 1, 1)).alias("prompt"),
        CHATML.render(F.slice("messages", F.lit(2), F.size("messages"))).alias("response"),
        F.when(F.pmod("conv_id", F.lit(10)) == 3, fewer).otherwise(lists).alias("verifier"),
        replies.alias("replies"),
    )
    return array_rewards(samples, constraint_table(spark), rule_book(), judgements="replies")


def pass_rate(spark, sf):
    return readouts.pass_rates(scored(spark, sf), "id", "verifier_type")


def pass_rate_rollup(spark, sf):
    """Pass rates by type of constraint, constraint and turn, and by every coarser grouping."""
    return readouts.pass_rate_cube(scored(spark, sf), "verifier_type", "id", "turn_ix")


SAMPLES = 4
LONGEST = 300


def fanout(spark, sf):
    heads = prompt_heads(spark, sf).select("conv_id", "prompt")
    return readouts.fan_out(heads, SAMPLES)


def group_advantage(spark, sf):
    """Rewards of eight neighbouring conversations as samples of one prompt."""
    rewards = turn_reward(spark, sf).withColumn("group_id", F.floor(F.col("sample_id") / 8))
    found = readouts.group_advantages(rewards, "group_id")
    return found.select("sample_id", "group_id", "reward", F.round("advantage", 6).alias("advantage"))


def length_flag(spark, sf):
    return trajectories(spark, sf).select(
        "sample_id", "status", readouts.over_length(F.col("response_length"), LONGEST).alias("too_long")
    )


EPOCHS, PACK = 3, 2000
# Arguments of the catalogue's kinds; other kinds take none.
ARGUMENTS = {
    "words": "60",
    "chars": "400",
    "sentences": "6",
    "paragraphs": "2",
    "lines": "3",
    "bullets": "2",
    "placeholders": "2",
    "capital_words": "1",
    "contains": "In",
    "forbids": "license",
    "contains_all": "a,En",
    "starts_with": "{",
    "ends_with": ".",
    "keyword_count": "an:3",
}


def argument(kind: str) -> str | None:
    return ARGUMENTS.get(kind, ARGUMENTS.get(kind.partition("_")[2]))


def epoch_batches(spark, sf):
    ids = conversations(spark, sf).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return epochs(ids, ["conv_id"], EPOCHS, batch_size=16, seed=7)


def token_packing(spark, sf):
    sizes = conversations(spark, sf).groupBy("conv_id").agg(F.sum(word_count(F.col("text"))).alias("n_tokens"))
    return packs(sizes, ["conv_id"], "n_tokens", PACK, seed=7)


RANKS = 8


def balanced_packing(spark, sf):
    """What balanced packs promise, measured: every sample once, the budget kept, ranks level to
    within a pack, and no more packs than samples packed in random order need."""
    sizes = conversations(spark, sf).groupBy("conv_id").agg(F.sum(word_count(F.col("text"))).alias("n_tokens"))
    placed = stored(balanced_packs(sizes, ["conv_id"], "n_tokens", PACK, RANKS, seed=7), "balanced")
    whole = placed.groupBy("pack_id", "rank").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n"))
    ranks = whole.groupBy("rank").agg(F.sum("size").alias("total"))
    plain = token_packing(spark, sf).agg(F.count_distinct("pack_id").alias("n_plain"))
    sides = ranks.agg((F.max("total") - F.when(F.count(F.lit(1)) == RANKS, F.min("total")).otherwise(0)).alias("apart"))
    measured = whole.agg(
        F.sum("n").alias("n_samples"),
        F.sum("size").alias("n_tokens"),
        F.bool_and((F.col("size") <= PACK) | (F.col("n") == 1)).alias("budget_kept"),
        F.max("size").alias("largest"),
        F.count(F.lit(1)).alias("n_packs"),
        F.count_distinct("pack_id").alias("n_ids"),
    )
    joined = measured.join(sides, F.lit(True)).join(plain, F.lit(True))
    return joined.select(
        "n_samples",
        "n_tokens",
        "budget_kept",
        (F.col("apart") <= F.col("largest")).alias("ranks_level"),
        (F.col("n_packs") == F.col("n_ids")).alias("pack_in_one_rank"),
        (F.col("n_packs") <= F.col("n_plain")).alias("no_more_packs"),
    )


# Fixed value: what JSON escapes in strings; the backslash comes first.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def dressed(key: Column, text: Column) -> Column:
    """The whole text, by the key with a mark around it: titles, lists, places, JSON, case."""
    escaped = text
    for mark, written in ESCAPES.items():
        escaped = F.replace(escaped, F.lit(mark), F.lit(written))
    forms = [
        text,
        F.concat(F.lit("<<A title>>\n\n"), text),
        F.upper(F.replace(text, F.lit("ß"), F.lit("ss"))),
        F.lower(text),
        F.concat(F.lit("* one\n  - two\n"), text),
        F.concat(F.lit('{"text": "'), escaped, F.lit('"}')),
        F.concat(text, F.lit("\n \nWrite to [name] at [place].")),
        F.replace(text, F.lit(","), F.lit("")),
    ]
    chosen = forms[-1]
    for k, form in enumerate(forms[:-1]):
        chosen = F.when(F.pmod(key, F.lit(len(forms))) == k, form).otherwise(chosen)
    return chosen


def rule_catalogue(spark, sf):
    """How many documents pass a rule of each kind; measures of a text are taken once."""
    responses = documents(spark, sf).select(dressed(F.col("doc_id"), F.col("text")).alias("response"))
    found = measures(F.col("response"))
    measured = responses.select("response", *[column.alias(name) for name, column in found.items()])
    held = verdicts(F.col("response"), {name: F.col(name) for name in found}, lambda kind: F.lit(argument(kind)))
    counted = measured.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(ok).alias(kind) for kind, ok in held.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n_passed")) for k in held])
    return counted.select("n_rows", F.inline(rows))


# Patterns as constraint rows bring them: by id modulo their number. The last two are none that an
# automaton can run.
PATTERNS = [r"(?i)the\b.*\bof", r"^\p{Lu}\w+", r"(a+)+$", r"[.!?]\s*$", r"\d{3}", r"(\w)\1", r"a(?=b)"]


def pattern_rules(spark, sf):
    """Constraints whose argument is a pattern, over whole documents; bad patterns fail."""
    book = catalogue("matches", "min_words")
    pattern = F.element_at(F.array(*[F.lit(p) for p in PATTERNS]), (F.pmod("doc_id", F.lit(len(PATTERNS))) + 1).cast("int"))
    rules = F.array(
        F.struct(F.lit("matches").alias("kind"), pattern.alias("arg")),
        F.struct(F.lit("min_words").alias("kind"), F.lit("20").alias("arg")),
    )
    held = book.all_hold(F.col("text"), F.col("rules"), F.lit(None).cast("string"))
    return documents(spark, sf).select("doc_id", "text", rules.alias("rules")).select("doc_id", held.alias("ok"))


def _ends_with_stop(response):
    return response.rstrip().endswith((".", "!", "?"))


async def _at_least(response, placeholder):
    await asyncio.sleep(0)
    return len(response.split(" ")) >= int(placeholder)


def registered_verifier(spark, sf):
    """Constraints whose rules are registered Python functions, one of them a coroutine; a bad argument fails."""
    book = RuleBook().function("ends", _ends_with_stop).function("at_least", _at_least)
    turns = ranked(conversations(spark, sf), "assistant")
    rules = F.array(
        F.struct(F.lit("ends").alias("kind"), F.lit(None).cast("string").alias("arg")),
        F.struct(
            F.lit("at_least").alias("kind"),
            F.when(F.pmod(F.col("conv_id"), F.lit(9)) == 0, "many").otherwise("40").alias("arg"),
        ),
    )
    wanted = F.when(F.pmod(F.col("k"), F.lit(2)) == 0, rules).otherwise(F.slice(rules, 1, 1))
    held = book.all_hold(F.col("text"), F.col("rules"), F.lit(None).cast("string"))
    return turns.withColumn("rules", wanted).select("conv_id", "turn", held.alias("ok"))


QUERIES = {
    "filter_turn_limit": filter_turn_limit,
    "filter_word_budget": filter_word_budget,
    "filter_role_alternation": filter_role_alternation,
    "filter_content_type": filter_content_type,
    "sft_filter": sft_filter,
    "sft_filter_untyped": sft_filter_untyped,
    "untyped_jsonl": untyped_jsonl,
    "sft_filter_counts": sft_filter_counts,
    "word_count": count_words,
    "running_words": running_words,
    "prompt_heads": prompt_heads,
    "prompt_records": prompt_records,
    "split_roundtrip": split_roundtrip,
    "jsonl_roundtrip": jsonl_roundtrip,
    "shuffle_batches": shuffle_batches,
    "chat_render": chat_render,
    "chat_render_generation": chat_render_generation,
    "payload_flags": payload_marks,
    "assistant_spans": assistant_spans,
    "record_spans": record_spans,
    "tag_extract": tag_extract,
    "tag_pair": tag_pair,
    "tokenize": tokenize,
    "token_ids": token_ids,
    "detokenize": detokenize,
    "sublist_search": sublist_search,
    "loss_mask_simple": loss_mask_simple,
    "loss_mask_qwen": loss_mask_qwen,
    "loss_mask_qwen3": loss_mask_qwen3,
    "loss_mask_distill": loss_mask_distill,
    "mask_lengths": mask_lengths,
    "sft_samples": samples,
    "mask_text_spans": mask_text_spans,
    "mask_span_rows": mask_span_rows,
    "token_view": token_view,
    "multimodal_align": multimodal_align,
    "trajectory": trajectories,
    "trajectory_turns": trajectory_turns,
    "trajectory_totals": trajectory_totals,
    "constraint_index": constraint_index,
    "constraint_lookup": constraint_lookup,
    "unknown_constraints": unknown_constraints,
    "rule_results": rule_results,
    "turn_pass": turn_pass,
    "turn_reward": turn_reward,
    "judge_requests": judge_request_table,
    "judge_verdicts": judge_verdicts,
    "helpfulness_veto": helpfulness_veto,
    "conversation_reward": conversation_reward,
    "record_reward": record_reward,
    "registered_verifier": registered_verifier,
    "array_reward": array_reward,
    "pass_rate": pass_rate,
    "pass_rate_rollup": pass_rate_rollup,
    "fanout": fanout,
    "group_advantage": group_advantage,
    "length_flag": length_flag,
    "epoch_batches": epoch_batches,
    "token_packing": token_packing,
    "balanced_packing": balanced_packing,
    "rule_catalogue": rule_catalogue,
    "pattern_rules": pattern_rules,
}
