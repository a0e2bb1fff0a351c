import json

import duckdb
import pytest
from pyspark.sql import functions as F

from turnloom.operators.keep import MEASURES, keep_records, keep_turns, turn_measures
from turnloom.operators.readouts import group_advantages, pass_rate_cube
from turnloom.operators.turns import with_running_total
from turnloom.plans.sft import prepare_sft

SCHEMA = "id int, messages array<struct<role:string,content:variant>>, note string"


def chat(*contents, first="user"):
    roles = ["user", "assistant"] if first == "user" else ["assistant", "user"]
    return [{"role": roles[i % 2], "content": c} for i, c in enumerate(contents)]


CASES = [
    (chat(*"abcdefgh"), True),
    (chat(*"abcdefghi"), False),
    (chat("a", "b", "c"), True),
    ([{"role": "system", "content": "s"}] + chat("a", "b"), False),
    (chat("w " * 2023 + "w", "b"), False),
    (chat("w " * 2022 + "w", "v " * 5000), True),
    (chat("w " * 5000), True),
    (chat("a", ["list"]), False),
    (chat("a", 5), False),
    (chat("a", None), False),
    ([{"role": "user"}], False),
    ([{"content": "a"}], False),
    ([], True),
]


def test_keep_goldens(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text(
        "".join(
            json.dumps({"id": i, "messages": m, "note": None}) + "\n"
            for i, (m, _) in enumerate(CASES)
        )
    )
    target = str(tmp_path / "out")
    counts = prepare_sft(spark, str(source), target, max_turns=4, schema=SCHEMA)
    expected = [i for i, (_, kept) in enumerate(CASES) if kept]
    assert counts == (len(CASES), len(expected))
    lines = [line for file in (tmp_path / "out").glob("*.json") for line in file.open()]
    records = sorted((json.loads(line) for line in lines), key=lambda r: r["id"])
    assert [r["id"] for r in records] == expected
    assert [r["messages"] for r in records] == [CASES[i][0] for i in expected]
    assert all("note" in r and r["note"] is None for r in records)


def test_no_turn_limit(spark):
    df = spark.createDataFrame(
        [([("user", "a"), ("assistant", "b")] * 20,)],
        "messages array<struct<role:string,content:string>>",
    )
    assert keep_records(df).count() == 1
    assert keep_records(df, max_turns=19).count() == 0
    assert keep_records(df, max_turns=0).count() == 1


@pytest.mark.parametrize("max_turns,budget", [(None, 6), (2, 100), (3, 5), (1, 1), (None, 0)])
def test_turn_form_equals_record_form(spark, max_turns, budget):
    rows = []
    for conv in range(60):
        for turn in range(conv % 8 + 1):
            role = "user" if (turn + (conv % 7 == 0)) % 2 == 0 else "assistant"
            rows.append((conv, turn, role, None if (conv + turn) % 31 == 0 else "w " * (conv % 3)))
    turns = spark.createDataFrame(rows, "conv int, turn int, role string, text string")
    records = turns.groupBy("conv").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("messages")
    )
    from_records = keep_records(records, max_turns=max_turns, budget=budget)
    from_turns = keep_turns(turns, "conv", "turn", max_turns=max_turns, budget=budget)
    as_set = lambda df: {(r.conv, str(r.messages)) for r in df.collect()}
    assert as_set(from_turns) == as_set(from_records)


def test_one_conversation_holds_most_rows(spark):
    """Its rows are counted map-side; only those below the bound are gathered."""
    hot = spark.range(200_000).select(
        F.lit(7).alias("conv"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.lit("a b").alias("text"),
    )
    rest = spark.range(300).select(
        (100 + F.col("id") / 2).cast("int").alias("conv"),
        (F.col("id") % 2).alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.lit("a b").alias("text"),
    )
    kept = keep_turns(hot.unionByName(rest), "conv", "turn", max_turns=4)
    assert {r.conv for r in kept.collect()} == set(range(100, 250))


NULLS = [
    (None, 0, "user", "a b"),
    (None, 1, "assistant", "c"),
    (1, None, "user", "x y z"),
    (1, 5, "assistant", "d"),
    (1, 9, "user", "e f"),
    (2, 3, "assistant", "g"),
    (2, None, "system", "h"),
    (3, 4, "user", None),
]


def test_null_keys_and_positions_count(spark):
    """As SQL that groups by the key and orders NULL positions first."""
    turns = spark.createDataFrame(NULLS, "conv long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (conv BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", NULLS)
    measured = con.execute("""
      WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST) - 1 AS k,
        CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, ' ')) END AS words FROM t)
      SELECT conv, count(*), sum(words) - max_by(words, k), bool_and(role = CASE WHEN k % 2 = 0 THEN 'user' ELSE 'assistant' END),
        bool_and(text IS NOT NULL) FROM r GROUP BY conv""").fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(turn_measures(turns, "conv", "turn").collect()) == order(measured)
    for wanted in (("n_messages",), ("n_words_before_last", "content_ok"), ("roles_ok",)):
        got = turn_measures(turns, "conv", "turn", wanted=wanted).collect()
        assert order(got) == order([(m[0], *(m[1 + MEASURES.index(w)] for w in wanted)) for m in measured])
    kept = {r.conv: len(r.messages) for r in keep_turns(turns, "conv", "turn").collect()}
    assert kept == {m[0]: m[1] for m in measured if m[3] and m[4]} == {None: 2, 1: 3}
    running = con.execute("""SELECT conv, turn, role, text, CAST(coalesce(count(*) OVER (PARTITION BY conv ORDER BY turn NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) FROM t""").fetchall()
    assert order(with_running_total(turns, "conv", "turn", F.lit(1), "n").collect()) == order(running)
    assert len(running) == len(NULLS)


def test_conversations_with_gaps_across_blocks(spark, tiny_blocks):
    rows = [(c, t * 7 + 3, "user" if (k + (c == 2)) % 2 == 0 else "assistant", "w") for c in (1, 2, 3) for k, t in enumerate(range(-40, 60, c))]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(3)
    assert {r.conv: r.roles_ok for r in turn_measures(turns, "conv", "turn").collect()} == {1: True, 2: False, 3: True}


def test_null_groups_keep_their_rows(spark):
    rewards = spark.createDataFrame([(1, None, 1.0), (2, None, 0.0), (3, 7, 1.0), (4, 7, None)], "s int, g int, reward double")
    got = {r.s: r.advantage for r in group_advantages(rewards, "g").collect()}
    assert got.keys() == {1, 2, 3, 4} and got[1] == -got[2] > 0.7 and got[3] == 0 and got[4] is None


def test_rollup_tells_null_values_from_totals(spark):
    rows = [(None, "a", True), ("x", "a", False), ("x", "b", True), (None, "a", True)]
    scored = spark.createDataFrame(rows, "kind string, id string, ok boolean")
    got = sorted((tuple(r) for r in pass_rate_cube(scored, "kind", "id").collect()), key=repr)
    assert got == sorted(
        [(None, None, 0, 4, 3, 0.75), (None, None, 1, 2, 2, 1.0), ("x", None, 1, 2, 1, 0.5), (None, "a", 2, 2, 2, 1.0), ("x", "a", 2, 1, 0, 0.0), ("x", "b", 2, 1, 1, 1.0)],
        key=repr,
    )
