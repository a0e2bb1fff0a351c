"""Recorded outputs to trajectories, against a plain loop over the same turns."""

import pytest
from pyspark.sql import functions as F

from tests.test_functions import letters
from turnloom.functions.template import CHATML
from turnloom.functions.tokens import PIECES, FunctionTokenizer
from turnloom.plans.scoring import output_checks, recorded_trajectories

END = "<|im_end|>"
PROMPTS = "sample_id int, turn_ix int, role string, content string"
OUTPUTS = (
    "sample_id int, turn_ix int, text string, finish_reason string, token_ids array<string>,"
    " logprobs array<double>"
)

# prompts, outputs as (text, finish)
SAMPLES = [
    (["Hi there", "Why?"], [(f"Hello.{END}\n", "stop"), ("Because", "length")]),
    (["Hi there", "Why?"], [(f"Hello.{END}\n", "stop"), (f"Because{END}", "stop")]),
    (["Hi there", "Why?"], [("Hello.", "stop"), (f"Because{END}", "stop")]),
    (["Hi there", "Why?"], [("Hel", "length"), (f"never{END}", "stop")]),
    (["Hi there", "Why?"], [(f"Hello.{END}\n", "stop"), ("", "abort")]),
    (["u0", "u1", "u2"], [(f"r{k}{END}", "stop") for k in range(3)]),
    (["u0", "u1"], [(f"r0{END}", "other"), (f"r1{END}", "other")]),
    (["u0", "u1"], [(f"r0{END}", "stop")]),
    (["only"], []),
    (["u0"], [(f"r0{END}", "stop"), (f"extra{END}", "stop"), ("more", "abort")]),
]


def loop(prompts, outputs):
    """Turn by turn, as the model server would be asked."""
    render = lambda text: CHATML.render_text([("user", text)], generation=True)
    response, mask, status = "", [], None
    for k in range(min(len(prompts), len(outputs))):
        text, finish = outputs[k]
        status = {"stop": "COMPLETED", "length": "TRUNCATED", "abort": "ABORTED"}.get(finish)
        if finish == "abort":
            return None, None, None, status
        response += text
        mask += [1] * PIECES.size_of(text)
        if finish == "length":
            break
        if k < len(prompts) - 1:
            response += render(prompts[k + 1])
            mask += [0] * PIECES.size_of(render(prompts[k + 1]))
            status = None
    return render(prompts[0]), response, mask, status


def tables(spark, samples=SAMPLES):
    prompts = [
        (i, k, "user", text) for i, (texts, _) in enumerate(samples) for k, text in enumerate(texts)
    ]
    outputs = [
        (i, k, *output, None, None)
        for i, (_, outs) in enumerate(samples)
        for k, output in enumerate(outs)
    ]
    return spark.createDataFrame(prompts, PROMPTS), spark.createDataFrame(outputs, OUTPUTS)


def joined(rows):
    """Samples by id; each has one row."""
    whole = {r.sample_id: (r.prompt, r.response, r.loss_mask, r.status) for r in rows}
    assert len(whole) == len(rows)
    return whole


EXPECTED = {i: loop(*sample) for i, sample in enumerate(SAMPLES)}


def test_short(spark):
    rows = recorded_trajectories(*tables(spark)).collect()
    assert joined(rows) == EXPECTED
    for row in rows:
        if row.tokens is not None:
            assert "".join(row.tokens) == row.prompt + row.response == row.payload_text
            assert row.response_length == len(row.loss_mask)


def test_goldens(spark):
    rows = {r.sample_id: r for r in recorded_trajectories(*tables(spark)).collect()}
    facts = {i: (r.response_length, sum(r.loss_mask), r.status) for i, r in rows.items() if r.tokens}
    assert facts[0] == (13, 4, "TRUNCATED")
    assert facts[1] == (14, 5, "COMPLETED")
    assert facts[2] == (12, 3, "COMPLETED")
    assert facts[5] == (24, 6, "COMPLETED")
    assert len(rows[0].tokens) - 13 == 11
    assert rows[4].status == "ABORTED" and rows[4].tokens is None


def test_one_sample_of_many_turns(spark):
    n = 5000
    prompts = spark.range(n).select(
        F.lit(1).alias("sample_id"),
        F.col("id").cast("int").alias("turn_ix"),
        F.lit("user").alias("role"),
        F.concat(F.lit("u"), "id").alias("content"),
    )
    outputs = prompts.select(
        "sample_id",
        "turn_ix",
        F.concat(F.lit("r"), "turn_ix", F.lit(END)).alias("text"),
        F.when(F.col("turn_ix") == 4500, "length").otherwise("stop").alias("finish_reason"),
    )
    rows = recorded_trajectories(prompts, outputs).collect()
    expected = loop(
        [f"u{k}" for k in range(n)],
        [(f"r{k}{END}", "length" if k == 4500 else "stop") for k in range(n)],
    )
    assert joined(rows) == {1: expected}


def test_recorded_tokens_and_logprobs(spark):
    prompts, _ = tables(spark, [(["a", "b", "c"], [])] * 3)
    known = lambda k: (["x", "y"], [-1.0, -2.0])
    outputs = []
    for sample in range(3):
        for k in range(3):
            ids, logprobs = known(k) if sample == 0 or (sample == 1 and k != 1) else (None, None)
            outputs.append((sample, k, f"xy{END}", "stop", ids, logprobs))
    rows = recorded_trajectories(prompts, spark.createDataFrame(outputs, OUTPUTS)).collect()
    follow = PIECES.size_of(CHATML.render_text([("user", "b")], generation=True))
    first = [r for r in rows if r.sample_id == 0]
    logprobs = [p for r in first for p in r.logprobs]
    assert logprobs == ([-1.0, -2.0] + [0.0] * follow) * 2 + [-1.0, -2.0]
    assert all(r.logprobs_match for r in first)
    assert not all(r.logprobs_match for r in rows if r.sample_id == 1)
    assert all(r.logprobs is None and r.logprobs_match for r in rows if r.sample_id == 2)


def test_function_tokenizer(spark):
    prompts, outputs = tables(spark)
    outputs = outputs.drop("token_ids").withColumn("token_ids", F.lit(None).cast("array<int>"))
    tokenizer = FunctionTokenizer(letters)
    short = recorded_trajectories(prompts, outputs, tokenizer=tokenizer).collect()
    assert all("".join(map(chr, r.tokens)) == r.payload_text for r in short if r.tokens)


@pytest.mark.parametrize("blocks", [12, 1])
def test_responses_pair_with_lists(spark, monkeypatch, blocks):
    """Samples whose spans and lists differ in number are not matched."""
    monkeypatch.setattr("turnloom.operators.turns.BLOCK_BITS", blocks)
    prompts, outputs = tables(spark)
    lists = prompts.select(
        "sample_id",
        "turn_ix",
        F.array(
            F.struct(F.lit("c").alias("id"), F.lit(None).cast("string").alias("placeholder"))
        ).alias("verifier"),
    )
    checks = output_checks(prompts, outputs, lists).collect()
    matched = {}
    for row in checks:
        matched[row.sample_id] = matched.get(row.sample_id, True) and row.matched
    assert [i for i, ok in sorted(matched.items()) if ok] == [1, 2, 5, 6, 9]
    found = {(r.sample_id, r.turn_ix): r.response for r in checks if r.sample_id in (2, 5)}
    found = {k: v for k, v in found.items() if k[1] is not None}
    assert found == {
        (2, 0): "Hello.<|im_start|>user\nWhy?",
        (2, 1): "Because",
        (5, 0): "r0",
        (5, 1): "r1",
        (5, 2): "r2",
    }
