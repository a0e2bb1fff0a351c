"""Spans and trajectories in rows against the record forms; masks of tokenizers that cross turns."""

import random

import pytest
from pyspark.sql import functions as F

from turnloom.functions.template import CHATML, ChatTemplate
from turnloom.functions.tokens import FunctionTokenizer
from turnloom.operators.lossmask import texts_under_mask, with_loss_mask, with_turn_loss_mask
from turnloom.operators.spans import mask_span_rows
from turnloom.operators.trajectory import build_trajectories, gather_samples
from turnloom.operators.trajectoryrows import trajectory_rows, trajectory_totals

MASKED = "conv int, turn int, tokens array<string>, loss_mask array<int>"


def plain_spans(turns):
    """Each run of ones of a conversation's tokens in order, NULL positions first."""
    found = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        bits = [(x, b) for t in own for x, b in zip(t[2], t[3])]
        spans, before = [], 0
        for token, bit in bits:
            if bit and not before:
                spans.append("")
            if bit:
                spans[-1] += token
            before = bit
        found |= {(conv, k): text for k, text in enumerate(spans)}
    return found


@pytest.mark.parametrize("share", [0.2, 0.5, 0.95])
def test_spans_cross_turns_and_blocks(spark, tiny_blocks, share):
    drawn = random.Random(7)
    turns = []
    for conv in (None, 1, 2, 3):
        for turn in drawn.sample(range(-20, 60), 30) + [None]:
            n = drawn.choice([0, 1, 2, 5])
            bit = lambda: int(drawn.random() < share)
            mask = [bit() for _ in range(n)] if drawn.random() < 0.4 else [bit()] * n
            turns.append((conv, turn, [chr(97 + drawn.randrange(26)) for _ in range(n)], mask))
    df = spark.createDataFrame(turns, MASKED).repartition(3)
    got = {(r.conv, r.span_ix): r.span for r in mask_span_rows(df, "conv", "turn").collect()}
    assert got == plain_spans(turns)


def test_spans_of_a_long_conversation(spark):
    role = F.when(F.col("id") % 3 == 0, "user").otherwise("assistant")
    turns = spark.range(9000).select(
        F.lit(1).alias("conv"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("turn "), F.col("id")).alias("text")
    )
    masked = with_turn_loss_mask(turns, "turn")
    got = [r.span for r in mask_span_rows(masked, "conv", "turn").orderBy("span_ix").collect()]
    gathered = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    records = with_loss_mask(gathered.select("conv", F.transform("m", lambda m: F.struct(m["role"], m["content"])).alias("messages")))
    assert got == records.select(texts_under_mask(F.col("tokens"), F.col("loss_mask"))).first()[0]
    assert len(got) == 3000  # two answers in a row are one span
    plan = mask_span_rows(masked, "conv", "turn")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "span_ix" in plan


PROMPTS = "sample_id int, turn_ix int, role string, content string"
OUTPUTS = "sample_id int, turn_ix int, text string, finish_reason string, token_ids array<string>, logprobs array<double>"


def test_trajectory_rows_equal_the_record_form(spark, tiny_blocks):
    drawn = random.Random(11)
    prompts, outputs = [], []
    for sample in range(80):
        for k in range(drawn.randint(1, 6)):
            prompts.append((sample, k, "system" if k == 0 and sample % 9 == 0 else "user", f"ask {k} of {sample}"))
        for k in range(drawn.randint(0, 7)):
            text = f"say {k} now"
            reason = drawn.choice(["stop"] * 6 + ["length", "abort", "odd"])
            known = drawn.random() < 0.6
            n = drawn.choice([5, 5, 5, 4])
            outputs.append((sample, k, text, reason, ["say", " ", str(k), " ", "now!"] if known else None, [-0.5] * n if known else None))
    outputs.append((999, 0, "no prompt", "stop", None, None))
    p, o = spark.createDataFrame(prompts, PROMPTS), spark.createDataFrame(outputs, OUTPUTS)
    records = {
        r.sample_id: r
        for r in build_trajectories(gather_samples(p, o).filter(F.size("prompt") > 0)).collect()
    }
    rows = trajectory_rows(p, o).repartition(4)
    found = {}
    for r in sorted(rows.collect(), key=lambda r: (r.sample_id, r.place)):
        found.setdefault(r.sample_id, []).append(r)
    totals = {r.sample_id: r for r in trajectory_totals(rows).collect()}
    assert found.keys() == records.keys() == totals.keys()
    for sample, record in records.items():
        own, total = found[sample], totals[sample]
        assert total.status == record.status
        if record.prompt is None:
            assert [r.place for r in own] == [-1] and total.response_length is None and total.prompt_length is None
            continue
        assert [r.place for r in own] == list(range(len(own)))
        assert own[0].text == record.prompt and "".join(r.text for r in own[1:]) == record.response
        assert [t for r in own for t in r.tokens] == record.tokens
        assert [r.learned for r in own[1:] for _ in r.tokens] == record.loss_mask
        assert [sum(len(x.tokens) for x in own[:k]) for k in range(len(own))] == [r.offset for r in own]
        assert total.response_length == record.response_length and total.prompt_length == len(own[0].tokens)
        assert total.logprobs_match == record.logprobs_match
        logged = [x for r in own[1:] if r.logprobs is not None for x in r.logprobs]
        assert logged == (record.logprobs or [])


WIDE = ("\n<|im_start|>assistant", "\n<|im_start|>tool", "assistant\nI", "hello", ".<|im_end|>", "Be")


def merging():
    """Characters, and a few longer tokens, two of which hold parts of two turns."""

    def encode(texts):
        def ids(text):
            found, at = [], 0
            while at < len(text):
                wide = next((k for k, w in enumerate(WIDE) if text.startswith(w, at)), None)
                found.append(ord(text[at]) if wide is None else 5000 + wide)
                at += 1 if wide is None else len(WIDE[wide])
            return found

        return [ids(t) for t in texts]

    def decode(lists):
        return ["".join(WIDE[i - 5000] if i >= 5000 else chr(i) for i in row) for row in lists]

    return encode, decode


CHAT = [("system", "Be brief."), ("user", "Hi there"), ("assistant", "Hello."), ("user", "Why?"), ("assistant", "I can"), ("tool", "x")]
DUMMY = ("user", "FOR CALCULATING LOSS MASK ONLY")


def by_definition(chat, kind, template):
    """Messages rendered beside a dummy turn, its own tokens counted off."""
    ids = lambda turns, generation=False: merging()[0]([template.render_text(turns, generation)])[0]
    header = len(ids([DUMMY], True)) - len(ids([DUMMY]))
    once, twice = ids([("user", "FOR TESTING ONLY")]), ids([("user", "FOR TESTING ONLY")] * 2)
    prefix = 2 * len(once) - len(twice)
    tokens, mask = [], []
    for k, turn in enumerate(chat):
        if kind == "qwen3":
            own = ids([turn, DUMMY])[: -len(ids([DUMMY]))] if k == 0 else ids([DUMMY, turn])[len(ids([DUMMY])) :]
            learn = [0] * header + [1] * (len(own) - header)
        elif kind == "qwen":
            own = ids([turn])
            own = own[prefix:] if k and turn[0] != "system" else own
            learn = [0] * header + [1] * (len(own) - header)
        else:
            before = [("user", "hello world")]
            if turn[0] == "assistant":
                own = ids([*before, turn])[len(ids(before, True)) :]
            else:
                own = ids([turn], turn[0] == "user")
            learn = [1] * len(own)
        tokens += own
        mask += learn if turn[0] == "assistant" else [0] * len(own)
    return tokens, mask


@pytest.mark.parametrize("kind", ["qwen3", "qwen", "qwen_simple"])
def test_tokens_that_cross_turns_are_cut_by_difference(spark, kind):
    tokenizer = FunctionTokenizer(merging)
    for template in (CHATML, ChatTemplate(default_system="You help.")):
        if template.prefix and kind != "qwen":
            continue
        for chat in (CHAT[:5], CHAT[1:5], CHAT[2:5], CHAT[1:2]) + ((CHAT,) if kind != "qwen_simple" else ()):
            df = spark.createDataFrame([(chat,)], "messages array<struct<role:string,content:string>>")
            row = with_loss_mask(df, kind, template=template, tokenizer=tokenizer).first()
            assert (row.tokens, row.loss_mask) == by_definition(chat, kind, template)
            turns = spark.createDataFrame([(1, k, *t) for k, t in enumerate(chat)], "conv int, turn int, role string, text string")
            rows = with_turn_loss_mask(turns, "turn", kind, template=template, tokenizer=tokenizer).orderBy("turn").collect()
            assert [t for r in rows for t in r.tokens] == row.tokens and [b for r in rows for b in r.loss_mask] == row.loss_mask


def test_cuts_matter_for_such_tokenizers(spark):
    closed = FunctionTokenizer(merging, crosses_turns=False)
    df = spark.createDataFrame([(CHAT[:5],)], "messages array<struct<role:string,content:string>>")
    assert with_loss_mask(df, "qwen3", tokenizer=closed).first().tokens != by_definition(CHAT[:5], "qwen3", CHATML)[0]
