"""Conversation filters: turn limit, word budget, role order and content type.

Each filter comes in two forms: a predicate over one row per conversation, which needs
no shuffle, and an aggregate over a turn table, which combines map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType, VariantType

from turnloom.functions.arrays import let
from turnloom.functions.text import word_count
from turnloom.operators.turns import FIRST_BLOCK, block_of, same

# Fixed value: words allowed before the last message.
WORD_BUDGET = 2024


def expected_role(position: Column) -> Column:
    return F.when(position % 2 == 0, "user").otherwise("assistant")


def is_text(content: Column, variant: bool) -> Column:
    """Is the content a string; untyped content is read as VARIANT and asked for its type."""
    if variant:
        return F.schema_of_variant(content).eqNullSafe("STRING")
    return content.isNotNull()


def text_of(content: Column, variant: bool) -> Column:
    return F.try_variant_get(content, "$", "string") if variant else content


# One row per conversation


def within_turns(messages: Column, max_turns: int | None) -> Column:
    """At most ``max_turns`` user and assistant pairs; None or 0 sets no limit."""
    return F.size(messages) <= 2 * max_turns if max_turns else F.lit(True)


def words_before_last(messages: Column, variant: bool = False) -> Column:
    """Words of all messages but the last; content that is not text has none."""

    def add(total: Column, message: Column) -> Column:
        words = word_count(text_of(message["content"], variant))
        return total + F.when(is_text(message["content"], variant), words).otherwise(0)

    return let(
        messages,
        lambda m: F.aggregate(
            F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0))),
            F.lit(0).cast("long"),
            add,
        ),
    )


def within_budget(messages: Column, budget: int, variant: bool = False) -> Column:
    """The budget is not used up before the last message; no message uses nothing."""
    return (F.size(messages) == 0) | (words_before_last(messages, variant) < budget)


def roles_alternate(messages: Column) -> Column:
    fits = F.transform(messages, lambda m, i: m["role"].eqNullSafe(expected_role(i)))
    return F.forall(fits, lambda ok: ok)


def all_text(messages: Column, variant: bool = False) -> Column:
    return F.forall(messages, lambda m: is_text(m["content"], variant))


def _has_variant_content(df: DataFrame, messages: str) -> bool:
    kind = df.schema[messages].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, StructType):
        raise TypeError(f"{messages} must be an array of structs")
    return isinstance(kind.elementType["content"].dataType, VariantType)


def keep_records(
    df: DataFrame,
    messages: str = "messages",
    max_turns: int | None = None,
    budget: int = WORD_BUDGET,
) -> DataFrame:
    """Keep the conversations that pass all four filters, with all their columns."""
    variant = _has_variant_content(df, messages)
    column = F.col(messages)
    return df.filter(
        within_turns(column, max_turns)
        & roles_alternate(column)
        & all_text(column, variant)
        & within_budget(column, budget, variant)
    )


# One row per turn

#: What the filters ask of a conversation.
MEASURES = ("n_messages", "n_words_before_last", "roles_ok", "content_ok")


def turn_measures(
    turns: DataFrame,
    key: str,
    position: str,
    role: str = "role",
    content: str = "text",
    wanted: tuple[str, ...] = MEASURES,
) -> DataFrame:
    """What the filters ask of a conversation, in scalars; no text is shuffled.

    One aggregate that combines map-side gives all measures ``wanted``; only the order of
    roles needs marks of each turn. Turns with a NULL key are one conversation; a NULL position
    comes first.
    """
    variant = isinstance(turns.schema[content].dataType, VariantType)
    body = F.col(content)
    typed = is_text(body, variant)
    words = F.when(typed, word_count(text_of(body, variant))).otherwise(0)
    at = F.coalesce(F.col(position).cast("long"), F.lit(FIRST_BLOCK))
    mark = F.when(F.col(role) == "user", 0).when(F.col(role) == "assistant", 1).otherwise(2)
    by_block = "roles_ok" in wanted
    blocks = turns.groupBy(key, *[block_of(at).alias("_block")] * by_block)
    partial = {
        "n_messages": [F.count(F.lit(1)).alias("_n")],
        "n_words_before_last": [
            F.sum(words).alias("_words"),
            F.max_by(words, at).alias("_last"),
            F.max(at).alias("_at"),
        ],
        "content_ok": [F.bool_and(typed).alias("_typed")],
        "roles_ok": [F.collect_list(F.struct(at.alias("at"), mark.alias("mark"))).alias("_marks")],
    }
    found = blocks.agg(*[column for name in wanted for column in partial[name]])
    if by_block:
        return _over_blocks(found, key, wanted)
    whole = {
        "n_messages": F.col("_n"),
        "n_words_before_last": F.col("_words") - F.col("_last"),
        "content_ok": F.col("_typed"),
    }
    return found.select(key, *[whole[name].alias(name) for name in wanted])


def _over_blocks(blocks: DataFrame, key: str, wanted: tuple[str, ...]) -> DataFrame:
    """Measures of conversations from those of their blocks of positions.

    A block's marks are judged in it, once as if it began at an even rank and once at an odd
    one, and a block is one small row in its conversation. So positions may begin anywhere and
    have gaps, and a conversation may have any length.
    """

    def fits(first: int) -> Column:
        alternate = F.transform(F.sort_array("_marks"), lambda m, i: m["mark"] == (i + first) % 2)
        return F.forall(alternate, lambda ok: ok)

    part = F.struct(
        F.col("_block").alias("at"), F.size("_marks").alias("n"), fits(0).alias("even"), fits(1).alias("odd")
    )

    def step(state: Column, part: Column) -> Column:
        ok = state["ok"] & F.when(state["n"] % 2 == 0, part["even"]).otherwise(part["odd"])
        return F.struct((state["n"] + part["n"]).alias("n"), ok.alias("ok"))

    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("ok"))
    whole = {
        "n_messages": F.sum("_n"),
        "n_words_before_last": F.sum("_words") - F.max_by("_last", "_at"),
        "content_ok": F.bool_and("_typed"),
        "roles_ok": F.sort_array(F.collect_list(part)),
    }
    found = blocks.groupBy(key).agg(*[whole[name].alias(name) for name in wanted])
    return found.withColumn("roles_ok", F.aggregate("roles_ok", start, step, lambda state: state["ok"]))


def keep_turns(
    turns: DataFrame,
    key: str,
    position: str,
    role: str = "role",
    content: str = "text",
    max_turns: int | None = None,
    budget: int = WORD_BUDGET,
) -> DataFrame:
    """The filters over a turn table; returns kept conversations with all their messages.

    First the measures, in scalars; then the turns of kept conversations are gathered. A
    message has at least one word, so a kept conversation has no more messages than the
    budget has words. A NULL key is one conversation.
    """
    limit = F.col("n_messages") <= 2 * max_turns if max_turns else F.lit(True)
    turns = turns.withColumn("_key", same(key))
    kept = (
        turn_measures(turns, "_key", position, role, content)
        .filter(
            limit & F.col("roles_ok") & F.col("content_ok") & (F.col("n_words_before_last") < budget)
        )
        .select("_key", "n_messages", "n_words_before_last")
    )
    message = F.struct(
        F.col(position).alias("at"), F.col(role).alias("role"), F.col(content).alias("content")
    )
    gathered = turns.join(kept, "_key").groupBy("_key", "n_messages", "n_words_before_last")
    gathered = gathered.agg(F.collect_list(message).alias("_gathered"))
    # VARIANT has no order, so untyped content is sorted by position alone.
    if isinstance(turns.schema[content].dataType, VariantType):
        place = lambda m: F.coalesce(m["at"].cast("long"), F.lit(FIRST_BLOCK))
        ordered = F.array_sort("_gathered", lambda a, b: F.signum(place(a) - place(b)).cast("int"))
    else:
        ordered = F.sort_array("_gathered")
    return gathered.select(
        F.col("_key")[key].alias(key),
        "n_messages",
        "n_words_before_last",
        F.transform(
            ordered,
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("messages"),
    )
