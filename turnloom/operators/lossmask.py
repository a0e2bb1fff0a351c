"""Token sequences with 0/1 loss masks.

A conversation is cut into segments of rendered text. Each segment knows how many
leading tokens stay 0 and whether the rest is learned, so masks follow from token counts
alone and segments of one conversation can be worked on in different rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType, VariantType

from turnloom.functions.arrays import repeat, response_length, tail
from turnloom.functions.template import CHATML, ChatTemplate
from turnloom.functions.tokens import PIECES, template_overhead
from turnloom.operators.turns import block_of

# The mask kinds, and the token whose presence turns the second kind into
# the last.
SIMPLE = "qwen_simple"
QWEN = "qwen"
QWEN3 = "qwen3"
DISTILL = "distill_qwen"
DISTILL_TOKEN = "<｜Assistant｜>"
# The user turns that messages are rendered beside, where tokens may cross the border.
BESIDE = "FOR CALCULATING LOSS MASK ONLY"
BEFORE_ANSWER = "hello world"


def mask_kind(kind: str, tokenizer) -> str:
    """The kind that applies, given the tokenizer's vocabulary."""
    if kind not in (SIMPLE, QWEN, QWEN3, DISTILL):
        raise ValueError(f"unsupported mask kind: {kind}")
    if kind == QWEN and tokenizer.has_token(DISTILL_TOKEN):
        return DISTILL
    return kind


def _overhead(kind: str, template: ChatTemplate, tokenizer) -> tuple[int, int]:
    prefix, header = template_overhead(template, tokenizer)
    if prefix and kind in (SIMPLE, QWEN3):
        raise ValueError(f"{kind} needs a template without its own system turn")
    return prefix, header


def _segment(text: Column, lead: int, learn: Column, front: Column | int = 0, back: Column | int = 0) -> Column:
    """``front`` and ``back`` are tokens at the text's ends that are not the message's own."""
    whole = lambda n: n if isinstance(n, Column) else F.lit(n)
    return F.struct(
        text.alias("text"), F.lit(lead).alias("lead"), learn.alias("learn"), whole(front).alias("front"), whole(back).alias("back")
    )


def own_tokens(segment: Column, tokens: Column) -> Column:
    """The segment's tokens without those of the turns it was rendered beside."""
    length = F.greatest(F.size(tokens) - segment["front"] - segment["back"], F.lit(0))
    cut = F.slice(tokens, segment["front"] + 1, length)
    return F.when((segment["front"] == 0) & (segment["back"] == 0), tokens).otherwise(cut)


def message_segment(
    kind: str,
    template: ChatTemplate,
    header: int,
    position: Column,
    role: Column,
    content: Column,
    step: Column | None = None,
    tools: Column | None = None,
    tokenizer=PIECES,
) -> Column:
    """One message as ``struct(text, lead, learn, front, back)``; ``header`` is the header's token count.

    The simple kind puts the assistant header at the end of the user turn, so that an
    assistant segment is its content and terminator only. The other two render each
    message whole and keep the header's tokens at 0. ``step`` is a per-message override:
    anything but 1 masks the message.

    A tokenizer whose tokens may cross the border of two turns sees what stands beside a
    message: the message is rendered next to a dummy turn, whose tokens are cut off again.
    """
    assistant = role == "assistant"
    crosses = tokenizer.crosses_turns
    size = tokenizer.size_of
    if kind == SIMPLE:
        turn = template.turn(role, content)
        text = (
            F.when((role == "system") & (position == 0), turn)
            .when(role == "user", F.concat(turn, F.lit(template.generation_header)))
            .when(assistant, F.concat(content, F.lit(template.terminator)))
            .otherwise(
                F.raise_error(
                    F.concat(
                        F.lit("role "),
                        F.coalesce(role, F.lit("NULL")),
                        F.lit(" is not supported here; filter the data first"),
                    )
                ).cast("string")
            )
        )
        if not crosses:
            return _segment(text, 0, assistant)
        before = template.render_text([("user", BEFORE_ANSWER)], generation=True)
        text = F.when(assistant, F.concat(F.lit(before), text)).otherwise(text)
        return _segment(text, 0, assistant, F.when(assistant, size(before)).otherwise(0))
    opening = template.opening(role, content, tools)
    text = F.when(position == 0, opening).otherwise(template.turn(role, content))
    learn = assistant if step is None else assistant & (F.coalesce(step, F.lit(1)) == 1)
    first = position == 0
    if crosses and kind == QWEN3:
        beside = template.render_text([("user", BESIDE)])
        text = F.when(first, F.concat(text, F.lit(beside))).otherwise(F.concat(F.lit(beside), text))
        n = size(beside)
        return _segment(text, header, learn, F.when(first, 0).otherwise(n), F.when(first, n).otherwise(0))
    if crosses and kind == QWEN and template.prefix:
        alone = ~first & (role != "system")
        text = F.when(alone, F.concat(F.lit(template.prefix), text)).otherwise(text)
        return _segment(text, header, learn, F.when(alone, template_overhead(template, tokenizer)[0]).otherwise(0))
    return _segment(text, header, learn)


def segment_mask(segment: Column, n_tokens: Column) -> Column:
    lead = F.least(segment["lead"], n_tokens)
    learned = F.concat(repeat(0, lead), repeat(1, n_tokens - lead))
    return F.when(segment["learn"], learned).otherwise(repeat(0, n_tokens))


def supported_roles(position: Column, role: Column) -> Column:
    """Can the simple kind mask this message?"""
    return role.isin("user", "assistant") | ((role == "system") & (position == 0))


def _message_fields(df: DataFrame, messages: str) -> list[str]:
    kind = df.schema[messages].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, StructType):
        raise TypeError(f"{messages} must be an array of structs")
    return kind.elementType.fieldNames()


def with_loss_mask(
    df: DataFrame,
    kind: str = SIMPLE,
    messages: str = "messages",
    template: ChatTemplate = CHATML,
    tokenizer=PIECES,
    tools: str | None = None,
    on_unsupported: str = "error",
) -> DataFrame:
    """Add ``tokens`` and ``loss_mask`` to one row per conversation; no shuffle.

    The simple kind ignores tools. With ``on_unsupported="drop"`` it drops conversations
    it cannot mask instead of failing on them.
    """
    kind = mask_kind(kind, tokenizer)
    msgs = F.col(messages)
    has_step = "step_loss_mask" in _message_fields(df, messages)
    tool_text = F.col(tools) if tools else None
    if kind == DISTILL:
        last = F.element_at(msgs, -1)
        prompt = template.render(F.slice(msgs, 1, 1), generation=True, tools=tool_text)
        learn = (
            F.coalesce(last["step_loss_mask"], F.lit(1)) == 1 if has_step else F.lit(True)
        )
        segments = F.array(
            _segment(prompt, 0, F.lit(False)), _segment(last["content"], 0, learn)
        )
    else:
        _, header = _overhead(kind, template, tokenizer)
        segments = F.transform(
            msgs,
            lambda m, i: message_segment(
                kind,
                template,
                header,
                i,
                m["role"],
                m["content"],
                m["step_loss_mask"] if has_step else None,
                tool_text,
                tokenizer,
            ),
        )
        if kind == SIMPLE and on_unsupported == "drop":
            fits = F.transform(msgs, lambda m, i: supported_roles(i, m["role"]))
            df = df.filter(F.forall(fits, lambda ok: F.coalesce(ok, F.lit(False))))
    split = (
        df.withColumn("_segments", segments)
        .withColumn("_texts", F.transform("_segments", lambda s: s["text"]))
        .withColumn("_all", tokenizer.many(F.col("_texts")))
        .withColumn("_pieces", F.zip_with("_segments", "_all", own_tokens) if tokenizer.crosses_turns else F.col("_all"))
    )
    masks = F.zip_with("_segments", "_pieces", lambda s, p: segment_mask(s, F.size(p)))
    return split.select(
        *df.columns, F.flatten("_pieces").alias("tokens"), F.flatten(masks).alias("loss_mask")
    )


def with_turn_loss_mask(
    turns: DataFrame,
    position: str,
    kind: str = SIMPLE,
    role: str = "role",
    content: str = "text",
    template: ChatTemplate = CHATML,
    tokenizer=PIECES,
    step: str | None = None,
    tools: str | None = None,
) -> DataFrame:
    """The same per row of a turn table: a conversation's sequence is its rows in order.

    Needs no shuffle and holds for conversations of any length. The last kind looks at
    both ends of a conversation at once; see :func:`conversation_ends`.
    """
    kind = mask_kind(kind, tokenizer)
    if kind == DISTILL:
        raise ValueError(f"{kind} masks whole conversations, not single turns")
    _, header = _overhead(kind, template, tokenizer)
    segment = message_segment(
        kind,
        template,
        header,
        F.col(position),
        F.col(role),
        F.col(content),
        F.col(step) if step else None,
        F.col(tools) if tools else None,
        tokenizer,
    )
    split = turns.withColumn("_segment", segment).withColumn("tokens", tokenizer.one(F.col("_segment.text")))
    if tokenizer.crosses_turns:
        split = split.withColumn("tokens", own_tokens(F.col("_segment"), F.col("tokens")))
    return split.select(
        *turns.columns,
        "tokens",
        segment_mask(F.col("_segment"), F.size("tokens")).alias("loss_mask"),
    )


def conversation_ends(
    turns: DataFrame, key: str, position: str, role: str = "role", content: str = "text"
) -> DataFrame:
    """First and last message of each conversation, as the message list of the last kind."""
    message = F.struct(F.col(role).alias("role"), F.col(content).alias("content"))
    return turns.groupBy(key).agg(
        F.array(F.min_by(message, position), F.max_by(message, position)).alias("messages")
    )


def mask_totals(masked: DataFrame, key: str, position: str) -> DataFrame:
    """Per conversation of a masked turn table: tokens, ones and response length.

    Counts are summed inside blocks first. Whether an earlier block already holds a one
    is then settled over block rows, which are few.
    """
    counts = F.struct(
        F.col(position).alias("at"),
        F.size("tokens").cast("long").alias("n"),
        response_length(F.col("loss_mask")).alias("tail"),
        F.aggregate("loss_mask", F.lit(0).cast("long"), lambda a, b: a + b).alias("ones"),
    )
    blocks = (
        masked.select(key, block_of(F.col(position)).alias("_block"), counts.alias("_counts"))
        .groupBy(key, "_block")
        .agg(F.sort_array(F.collect_list("_counts")).alias("_rows"))
    )
    start = F.struct(
        F.lit(0).cast("long").alias("n"),
        F.lit(0).cast("long").alias("ones"),
        F.lit(0).cast("long").alias("tail"),
    )
    summed = blocks.select(
        key,
        "_block",
        F.aggregate(
            "_rows",
            start,
            lambda acc, row: F.struct(
                (acc["n"] + row["n"]).alias("n"),
                (acc["ones"] + row["ones"]).alias("ones"),
                F.when(acc["tail"] > 0, acc["tail"] + row["n"])
                .otherwise(row["tail"])
                .alias("tail"),
            ),
        ).alias("_sum"),
    )
    earlier = (
        Window.partitionBy(key)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    opened = F.coalesce(F.max(F.col("_sum.tail")).over(earlier), F.lit(0)) > 0
    length = F.when(opened, F.col("_sum.n")).otherwise(F.col("_sum.tail"))
    return (
        summed.withColumn("_length", length)
        .groupBy(key)
        .agg(
            F.sum("_sum.n").alias("n_tokens"),
            F.sum("_sum.ones").alias("n_ones"),
            F.sum("_length").alias("response_length"),
        )
    )


def finalise_samples(df: DataFrame) -> DataFrame:
    """Cut the mask to the response and add its length and the constant reward 0."""
    length = response_length(F.col("loss_mask"))
    rest = [c for c in df.columns if c != "loss_mask"]
    return (
        df.withColumn("response_length", length)
        .withColumn("reward", F.lit(0.0))
        .select(
            *rest,
            tail(F.col("loss_mask"), F.col("response_length")).alias("loss_mask"),
            "response_length",
            "reward",
        )
    )


def texts_under_mask(tokens: Column, mask: Column, tokenizer=PIECES) -> Column:
    """The text of every maximal run of ones, in order."""
    return tokenizer.texts_under_mask(tokens, mask).alias("texts")


def token_rows(
    df: DataFrame, keep: list[str], tokens: str = "tokens", mask: str = "loss_mask"
) -> DataFrame:
    """One row per token: its index, the token and its mask bit."""
    zipped = F.arrays_zip(F.col(tokens).alias("token"), F.col(mask).alias("mask"))
    return df.select(*keep, F.posexplode(zipped).alias("ix", "_row")).select(
        *keep, "ix", F.col("_row.token").alias("token"), F.col("_row.mask").alias("mask")
    )


def flatten_content(content: Column) -> Column:
    """VARIANT content to text: the text parts and bare strings of a list, space-joined."""
    items = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(
        items,
        lambda item: F.when(
            F.try_variant_get(item, "$.type", "string") == "text",
            F.coalesce(F.try_variant_get(item, "$.text", "string"), F.lit("")),
        ).when(
            F.schema_of_variant(item) == "STRING", F.try_variant_get(item, "$", "string")
        ),
    )
    joined = F.array_join(F.filter(texts, lambda t: t.isNotNull()), " ")
    return F.when(F.schema_of_variant(content).startswith("ARRAY"), joined).otherwise(
        F.try_variant_get(content, "$", "string")
    )


def flatten_messages(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Messages whose content may be a list, to messages of plain text.

    A message of plain text keeps its other fields; one that was a list keeps its role only.
    """
    kind = df.schema[messages].dataType.elementType
    if not isinstance(kind["content"].dataType, VariantType):
        return df
    more = [f.name for f in kind.fields if f.name not in ("role", "content")]

    def flat(m: Column) -> Column:
        listed = F.coalesce(F.schema_of_variant(m["content"]).startswith("ARRAY"), F.lit(False))
        return F.struct(
            m["role"].alias("role"),
            flatten_content(m["content"]).alias("content"),
            *[F.when(~listed, m[name]).alias(name) for name in more],
        )

    plain = F.transform(messages, flat)
    return df.withColumn(messages, plain)


def align_mask(mask: Column, input_ids: Column) -> Column:
    """Pad the text mask with zeros on the left to the length of the given ids."""
    missing = F.size(input_ids) - F.size(mask)
    return F.when(missing >= 0, F.concat(repeat(0, F.greatest(missing, F.lit(0))), mask)).otherwise(
        F.raise_error(F.lit("input_ids are shorter than the text mask")).cast("array<int>")
    )
