"""Constraint index, rules, verdicts and rewards."""

import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.test_functions import QUICK
from turnloom.functions.template import CHATML
from turnloom.functions.text import word_count
from turnloom.operators.judge import (
    CONSTRAINT,
    CONSTRAINT_PROMPT,
    HELPFULNESS,
    HELPFULNESS_PROMPT,
    judge_requests,
    selected,
)
from turnloom.operators.joins import fits_broadcast, lookup
from turnloom.operators.pool import constraint_index, unknown_constraints
from turnloom.operators.reward import checks_from_records, rewards, score_checks, turn_passes
from turnloom.operators.rules import RuleBook, rule_passes
from turnloom.plans.scoring import record_rewards

CONSTRAINTS = (
    "id string, ord int, constraint string, verifier_type string, content_template boolean,"
    " rules array<struct<kind:string,arg:string>>"
)
SAMPLES = (
    "sample_id int, prompt string, response string,"
    " verifier array<array<struct<id:string,placeholder:string>>>"
)
POOL = [
    ("short", 0, "c0 {response}", "hard", False, [("max_words", "3")]),
    ("has", 1, "c1", "hard", True, [("contains", "zzz")]),
    ("soft", 2, "c2", "soft", False, []),
    ("none", 3, "c3", "hard", False, []),
    ("odd", 4, "c4", "hard", False, [("no such rule", None)]),
    ("bad", 5, "c5", "hard", False, [("max_words", "many")]),
    ("both", 6, "c6", "hard", False, [("max_words", "3"), ("contains", "a")]),
]
BOOK = (
    RuleBook()
    .column("max_words", lambda response, arg: word_count(response) <= arg.try_cast("int"))
    .column("contains", lambda response, arg: F.contains(response, arg))
)


def index(spark, rows=POOL):
    return constraint_index(spark.createDataFrame(rows, CONSTRAINTS), "ord")


def sample(sample_id, texts, lists):
    """Texts as assistant turns after one user turn."""
    prompt = CHATML.render_text([("user", "q")], generation=True)
    turns = f"{CHATML.terminator}{CHATML.generation_header}".join(texts)
    response = turns + CHATML.terminator if texts else None
    return (sample_id, prompt if texts else None, response, lists)


def reward_of(spark, texts, lists, **options):
    df = spark.createDataFrame([sample(1, texts, lists)], SAMPLES)
    return record_rewards(df, index(spark), BOOK, **options).first().reward


@pytest.mark.parametrize(
    "texts,lists,expected",
    [
        (["a b"], [[("short", None)]], 1.0),
        (["a b c d"], [[("short", None)]], 0.0),
        (["a b"], [[("short", None), ("has", "b")]], 1.0),
        (["a b"], [[("has", "q")]], 0.0),
        (["a zzz"], [[("has", None)]], 1.0),
        (["a"], [[("none", None)]], 1.0),
        (["a"], [[]], 1.0),
        ([], [], 1.0),
        ([], [[]], 0.0),
        (["a", "b"], [[]], 0.0),
        (["a", "b"], [[("short", None)], []], 1.0),
        (["a", "b c d e"], [[("short", None)], [("short", None)]], 0.0),
        (["a"], [[("odd", None)]], 0.0),
        (["a"], [[("bad", None)]], 0.0),
        (["a"], [[("both", None)]], 1.0),
        (["b"], [[("both", None)]], 0.0),
        (["a"], [[("soft", None)]], 1.0),
        (["a"], [[("gone", None)], []], 0.0),
    ],
)
def test_rewards(spark, texts, lists, expected):
    assert reward_of(spark, texts, lists) == expected


def test_unknown_constraint(spark):
    lists = [[("gone", None), ("short", None)]]
    with pytest.raises(PySparkException, match="not in the table"):
        reward_of(spark, ["a"], lists)
    assert reward_of(spark, ["a"], lists, on_missing="fail") == 0.0
    checks = checks_from_records(spark.createDataFrame([sample(1, ["a"], lists)], SAMPLES))
    assert [tuple(r) for r in unknown_constraints(checks, index(spark)).collect()] == [("gone", 1)]


def test_assistant_turns_in_the_prompt_count(spark):
    prompt = CHATML.render_text([("user", "q"), ("assistant", "a b c d")], generation=True)
    df = spark.createDataFrame(
        [(1, prompt, "a<|im_end|>", [[("short", None)], []])], SAMPLES
    )
    assert record_rewards(df, index(spark), BOOK).first().reward == 0.0


def test_scorer_hook(spark):
    df = spark.createDataFrame([sample(1, ["a"], [[]])], SAMPLES)
    scorer = lambda samples: samples.select("sample_id", F.lit(0.5).alias("reward"))
    assert record_rewards(df, index(spark), BOOK, scorer=scorer).first().reward == 0.5


@QUICK
@given(st.lists(st.sampled_from(["short", "has", "none", "odd"]), max_size=4))
def test_more_constraints_never_raise_the_reward(spark, ids):
    lists = [[(i, "b") for i in ids[:cut]] for cut in range(len(ids) + 1)]
    df = spark.createDataFrame([sample(n, ["a b"], [ids]) for n, ids in enumerate(lists)], SAMPLES)
    found = {r.sample_id: r.reward for r in record_rewards(df, index(spark), BOOK).collect()}
    values = [found[n] for n in range(len(lists))]
    assert values == sorted(values, reverse=True) and set(values) <= {0.0, 1.0}


def test_last_row_of_an_id_wins(spark):
    rows = [(1, 0, "a"), (2, 1, "b"), (1, 2, "c")]
    table = spark.createDataFrame(rows, "id int, ord int, constraint string")
    assert {(r.id, r.constraint) for r in constraint_index(table, "ord").collect()} == {
        ("1", "c"),
        ("2", "b"),
    }


def judgements(spark, *rows):
    return spark.createDataFrame(
        [(1, *row) for row in rows],
        "sample_id int, turn_ix bigint, constraint_id string, kind string, verdict_text string",
    )


YES, NO = "<answer>Yes</answer>", "<answer>no</answer>"


@pytest.mark.parametrize(
    "replies,rate,expected",
    [
        ([], 1.0, 1.0),
        ([(0, "soft", CONSTRAINT, YES)], 0.0, 1.0),
        ([(0, "soft", CONSTRAINT, NO)], 0.0, 0.0),
        ([(0, "soft", CONSTRAINT, "maybe")], 0.0, 0.0),
        ([(0, "soft", CONSTRAINT, None)], 0.0, 1.0),
        ([(0, "soft", CONSTRAINT, YES), (0, "soft", CONSTRAINT, NO)], 0.0, 0.0),
        ([(0, "soft", HELPFULNESS, NO)], 1.0, 1.0),
        ([(0, "short", HELPFULNESS, NO)], 1.0, 0.0),
        ([(0, "short", HELPFULNESS, NO)], 0.0, 1.0),
        ([(1, "soft", CONSTRAINT, NO)], 0.0, 1.0),
    ],
)
def test_judgements(spark, replies, rate, expected):
    lists = [[("short", None), ("soft", None)]]
    table = judgements(spark, *replies)
    assert reward_of(spark, ["a b"], lists, judgements=table, rate=rate) == expected


def test_helpful_never_turns_fail_into_pass(spark):
    table = judgements(spark, (0, "short", HELPFULNESS, YES))
    assert reward_of(spark, ["a b c d"], [[("short", None)]], judgements=table, rate=1.0) == 0.0


def test_judge_requests(spark):
    df = spark.createDataFrame([sample(1, ["a {constraint}"], [[("short", None), ("soft", None)]])], SAMPLES)
    scored = score_checks(checks_from_records(df), index(spark), BOOK)
    assert [r.kind for r in judge_requests(scored).collect()] == [CONSTRAINT]
    rows = {r.kind: r.prompt for r in judge_requests(scored, rate=1.0).collect()}
    for kind, text, constraint in (
        (CONSTRAINT, CONSTRAINT_PROMPT, "c2"),
        (HELPFULNESS, HELPFULNESS_PROMPT, "c0 {response}"),
    ):
        assert rows[kind] == text.format(constraint=constraint, response="a {constraint}")
    assert scored.filter("ok IS NULL").count() == 0
    assert [r.passed for r in turn_passes(scored).collect()] == [True]


def test_selection_rate(spark):
    df = spark.range(20_000).select("id")
    drawn = lambda rate, parts=4: {
        r.id for r in df.repartition(parts).filter(selected(["id"], rate, 5)).collect()
    }
    assert drawn(0.0) == set() and len(drawn(1.0)) == 20_000
    assert 5_600 < len(drawn(0.3)) < 6_400
    assert drawn(0.3) == drawn(0.3, 7) and drawn(0.3) < drawn(0.6)


def needs_placeholder(response, placeholder):
    return placeholder in response


def slow(response):
    time.sleep(5)
    return True


def test_rule_passes():
    assert rule_passes(lambda response: response == "a", "a", None)
    assert rule_passes(lambda response: "TRUE", "a", "x")
    assert not rule_passes(lambda response: 1, "a", None)
    assert not rule_passes(lambda response: 1 / 0, "a", None)
    assert not rule_passes(needs_placeholder, "a", None)
    assert rule_passes(needs_placeholder, "ab", "b")
    assert not rule_passes(lambda other: True, "a", None)
    started = time.time()
    assert not rule_passes(slow, "a", None, seconds=0.2)
    assert time.time() - started < 2


def test_function_rules_in_tasks(spark):
    book = RuleBook(seconds=0.3).function("needs", needs_placeholder).function("slow", slow)
    book.column("max_words", lambda response, arg: word_count(response) <= arg.try_cast("int"))
    rows = [
        ("ab", [("needs", "b")], None),
        ("ab", [("needs", "b")], "c"),
        ("ab", [("needs", None)], None),
        ("ab", [("slow", None)], None),
        ("ab", [("needs", "a"), ("max_words", "1")], None),
        ("a b", [("needs", "a"), ("max_words", "1")], None),
        ("ab", [], None),
        ("ab", None, None),
    ]
    df = spark.createDataFrame(
        rows, "t string, rules array<struct<kind:string,arg:string>>, p string"
    )
    held = df.select(book.all_hold(F.col("t"), F.col("rules"), F.col("p")).alias("ok"))
    assert [r.ok for r in held.collect()] == [True, False, False, False, True, False, True, True]


def test_lookup_beyond_the_limit(spark):
    """A key that most facts share may be joined either way; the result is the same."""
    facts = spark.range(2000).select("id", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("key"))
    table = spark.range(0, 900).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    assert fits_broadcast(table) and not fits_broadcast(table, max_rows=899)
    assert not fits_broadcast(table, max_bytes=100)
    small = lookup(facts, F.broadcast(table), "key")
    large = lookup(facts, table.hint("merge"), "key")
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "key", "value").collect())
    assert rows(small) == rows(large) and len(rows(small)) == 2000
