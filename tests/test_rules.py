"""Rule kinds against plain patterns, hostile texts and patterns, and rules that hang or await."""

import asyncio
import os
import random
import re
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from turnloom.operators.rulekinds import KINDS, MEASURES, catalogue, measures, verdicts
from turnloom.operators.rules import RuleBook, rule_passes
from turnloom.operators.verifiers import HELPER

# What each measure counts, as one plain pattern; slow on hostile texts.
PLAIN = {
    "words": r"[^ \t\n\r]+",
    "sentences": r"[^.!?]+[.!?]",
    "bullets": r"(?m)^[ \t\x0b\f\r\n]*[*-] ",
    "placeholders": r"\[[^\]\n]+\]",
}


def odd_texts():
    drawn = random.Random(3)
    marks = ["a", "B", " ", "\n", "\r", "\t", "\x0b", "*", "-", "* ", "\n- ", "[", "]", "[a]", "<<", ">>", ">", "<", ".", "!", "?", "ß", "É"]
    texts = ["".join(drawn.choice(marks) for _ in range(drawn.randint(0, 40))) for _ in range(1500)]
    return [t.replace("\r\n", "\n") for t in texts] + ["", "[]", "[", "]", "[[a]", "<<a>>", "<<>>", "<<>>>", "<<\n>>"]


def test_measures_equal_plain_patterns(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {name: measure(F.col("t")) for name, measure in MEASURES.items()}
    rows = df.select("k", "t", *[c.alias(n) for n, c in found.items()], KINDS["title"](F.col("t"), F.lit("")).alias("title")).collect()
    for r in rows:
        for name, pattern in PLAIN.items():
            assert r[name] == len(re.findall(pattern, r["t"])), (name, r["t"])
        assert r["title"] == bool(re.search(r"<<[^\n]+>>", r["t"])), r["t"]
        assert r["lines"] == len([x for x in r["t"].split("\n") if x.strip(" ")])


@pytest.mark.parametrize("mark", ["a", "[", "[a", "<<", "<<a>", "\n", " \n", "\n\n ", "* ", "\t", ".", "aB ", "(", '{"a":'])
def test_kinds_take_time_in_proportion(spark, mark):
    text = (mark * (1_000_000 // len(mark)))[:1_000_000]
    df = spark.createDataFrame([(text,)], "t string")
    held = [rule(F.col("t"), F.lit("1")).alias(kind) for kind, rule in KINDS.items()]
    started = time.time()
    df.select(*held).collect()
    assert time.time() - started < 30  # all 35 kinds; a search that starts anew takes hours


def test_measures_taken_once_give_the_same_verdicts(spark):
    df = spark.createDataFrame([(t,) for t in [*odd_texts(), None]], "t string")
    found = measures(F.col("t"))
    once = df.select("t", *[c.alias(n) for n, c in found.items()])
    shared = verdicts(F.col("t"), {n: F.col(n) for n in found}, lambda kind: F.lit("2"))
    alone = {k: F.coalesce(rule(F.col("t"), F.lit("2")), F.lit(False)) for k, rule in KINDS.items()}
    assert set(shared) == set(alone)
    a = once.select(*[c.alias(k) for k, c in shared.items()]).collect()
    b = df.select(*[alone[k].alias(k) for k in shared]).collect()
    assert a == b


RULES = "t string, rules array<struct<kind:string,arg:string>>, p string"


def held(spark, book, rows):
    df = spark.createDataFrame(rows, RULES).coalesce(1)
    return [r.ok for r in df.select(book.all_hold(F.col("t"), F.col("rules"), F.col("p")).alias("ok")).collect()]


def test_patterns_from_data(spark):
    rows = [
        ("abc", [("matches", "b")], None),
        ("abc", [("matches", "^b")], None),
        ("abc", [("matches", "b"), ("matches", "c$")], None),
        ("abc", [("matches", "b"), ("matches", "d")], None),
        ("abc", [("matches", r"(\w)\1")], None),
        ("aa", [("matches", r"(a)\1")], None),
        ("ab", [("matches", "a(?=b)")], None),
        ("ab", [("matches", "[")], None),
        ("ab", [("matches", "(((a{1,99}){1,99}){1,99}){1,99}")], None),
        ("ab", [("matches", None)], None),
        (None, [("matches", "a")], None),
        ("ab", [("matches", "x")], "a"),
        ("ab", [("matches", "a"), ("min_words", "2")], None),
        ("ab", [], None),
        ("ab", None, None),
    ]
    expected = [True, False, True, False, False, False, False, False, False, False, False, True, False, True, True]
    assert held(spark, catalogue("matches", "min_words"), rows) == expected


def test_hostile_patterns_run_in_linear_time(spark):
    text = "a" * 1_000_000 + "b"
    rows = [(text, [("matches", p)], None) for p in ("(a+)+$", "(a|aa)+$", "(.*)*c", "(a*)*b$", "a{0,500}a{0,500}$")]
    started = time.time()
    assert held(spark, catalogue("matches"), rows) == [False, False, False, True, True]
    assert time.time() - started < 20


async def awaits(response):
    await asyncio.sleep(0.3)
    return response.startswith("a")


async def awaits_for_long(response):
    await asyncio.sleep(60)
    return True


async def blocks(response):
    time.sleep(60)
    return True


async def fails(response):
    raise ValueError(response)


def exits(response):
    os._exit(1)


def prints(response):
    print("true " * 100)
    return False


def ask(seconds, *questions, **rules):
    return HELPER.verdicts(cloudpickle.dumps(rules), seconds, [(k, t, None) for k, t in questions])


def test_coroutines_wait_together():
    ask(5, ("a", "a"), a=awaits)
    started = time.time()
    assert ask(5, *[("a", "ab"[k % 2]) for k in range(100)], a=awaits) == [True, False] * 50
    assert time.time() - started < 3


def test_each_rule_has_its_own_limit():
    questions = [("a", "a"), ("long", "a"), ("plain", "x"), ("bad", "a"), ("a", "b"), ("plain", "y")]
    rules = {"a": awaits, "long": awaits_for_long, "bad": fails, "plain": lambda response: response == "x"}
    assert ask(1.0, *questions, **rules) == [True, False, True, False, False, False]


def test_a_stuck_loop_fails_only_its_own_rule():
    questions = [("a", "a"), ("blocks", "a"), ("a", "a"), ("plain", "x"), ("exits", "x"), ("plain", "x")]
    rules = {"a": awaits, "blocks": blocks, "exits": exits, "plain": lambda response: True}
    assert ask(0.6, *questions, **rules) == [True, False, True, True, False, True]


def test_what_rules_print_is_no_answer():
    assert ask(5, ("p", "x"), ("q", "x"), p=prints, q=lambda response: True) == [False, True]


def test_the_helper_is_kept_for_the_next_batch():
    ask(5, ("q", "x"), q=lambda response: True)
    first = HELPER.process.pid
    assert rule_passes(lambda response: response == "a", "a", None)
    assert HELPER.process.pid == first


def test_coroutines_in_tasks(spark):
    book = RuleBook(seconds=2).function("a", awaits).function("long", awaits_for_long)
    rows = [("ab", [("a", None)], None), ("b", [("a", None)], None), ("a", [("a", None), ("long", None)], None), ("x", [], None)]
    assert held(spark, book, rows) == [True, False, False, True]
