"""Rewards in the row against the exploded form, in batches and on streams; counts on streams."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_keep import CASES, SCHEMA
from tests.test_scoring import BOOK, SAMPLES, index, sample
from turnloom.operators.arrayreward import array_rewards
from turnloom.operators.judge import CONSTRAINT, HELPFULNESS
from turnloom.operators.keep import keep_records
from turnloom.operators.reward import checks_from_records, rewards, score_checks
from turnloom.operators.rules import RuleBook
from turnloom.plans.scoring import record_rewards
from turnloom.sources.tables import write_jsonl
from turnloom.streaming.files import stream_counts, stream_jsonl, stream_keep, stream_rewards

YES, NO = "<answer>yes</answer>", "<answer>no</answer>"
ROWS = [
    sample(1, ["a b"], [[("short", None)]]),
    sample(2, ["a b c d"], [[("short", None)]]),
    sample(3, ["a"], [[], []]),
    sample(4, [], []),
    sample(5, ["a b", "c"], [[("short", None), ("soft", None)], []]),
    sample(6, ["a b", "c"], [[("soft", None)], [("soft", None), ("short", None)]]),
    sample(7, ["a b", "c"], [[("short", None)]]),
    sample(8, ["x"] * 30, [[("soft", "p"), ("short", "1")]] * 30),
    sample(9, ["a"], [None]),
    (*sample(10, ["a"], [[]])[:-1], None),
]
REPLIES = [
    (5, 0, "soft", CONSTRAINT, YES),
    (6, 0, "soft", CONSTRAINT, None),
    (6, 1, "soft", CONSTRAINT, YES),
    (6, 1, "soft", CONSTRAINT, NO),
    (8, 29, "short", HELPFULNESS, NO),
    (1, 0, "short", HELPFULNESS, NO),
]
KEYS = "sample_id long, turn_ix long, constraint_id string, kind string, verdict_text string"


def with_replies(spark, samples):
    table = spark.createDataFrame(REPLIES, KEYS)
    own = table.groupBy("sample_id").agg(F.collect_list(F.struct("turn_ix", "constraint_id", "kind", "verdict_text")).alias("replies"))
    return samples.join(own, "sample_id", "left"), table


def as_map(df):
    return {r.sample_id: r.reward for r in df.collect()}


@pytest.mark.parametrize("rate", [0.0, 0.5, 1.0])
def test_equals_the_exploded_form(spark, rate):
    samples, table = with_replies(spark, spark.createDataFrame(ROWS, SAMPLES))
    expected = as_map(rewards(score_checks(checks_from_records(samples), index(spark), BOOK, table, rate, seed=4)))
    found = as_map(array_rewards(samples, index(spark), BOOK, "replies", rate, seed=4))
    assert found == expected and set(found.values()) == {0.0, 1.0}
    if rate == 0:
        assert found == {1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 1.0, 6: 0.0, 7: 0.0, 8: 1.0, 9: 1.0, 10: 0.0}


def test_unknown_constraints(spark):
    samples = spark.createDataFrame([sample(1, ["a"], [[("missing", None)]]), sample(2, [], [[("missing", None)]])], SAMPLES)
    assert as_map(array_rewards(samples, index(spark), BOOK, on_missing="fail")) == {1: 0.0, 2: 0.0}
    with pytest.raises(Exception, match="not in the table"):
        array_rewards(samples, index(spark), BOOK).collect()
    assert as_map(array_rewards(samples.filter("sample_id = 2"), index(spark), BOOK)) == {2: 0.0}


def test_large_tables_and_python_rules_are_refused(spark):
    samples = spark.createDataFrame(ROWS, SAMPLES)
    with pytest.raises(Exception, match="use score_checks"):
        array_rewards(samples, index(spark), BOOK, most=1).collect()
    with pytest.raises(ValueError):
        array_rewards(samples, index(spark), RuleBook().function("f", lambda response: True))


def test_no_shuffle_of_samples(spark):
    samples = spark.createDataFrame(ROWS, SAMPLES)
    text = array_rewards(samples, index(spark), BOOK)._jdf.queryExecution().executedPlan().toString()
    above = text[: text.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in above and "SortMergeJoin" not in text


def test_stream_equals_batch(spark, tmp_path):
    samples, _ = with_replies(spark, spark.createDataFrame(ROWS, SAMPLES))
    schema = f"{SAMPLES}, replies array<struct<turn_ix:bigint,constraint_id:string,kind:string,verdict_text:string>>"
    write_jsonl(samples.select(*spark.createDataFrame([], schema).columns).repartition(4), str(tmp_path / "in"))
    stream = stream_jsonl(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    query = stream_rewards(stream, index(spark), BOOK, str(tmp_path / "out"), str(tmp_path / "cp"), judgements="replies")
    assert query.awaitTermination(180)
    assert all(not p["stateOperators"] for p in query.recentProgress)
    assert as_map(spark.read.parquet(str(tmp_path / "out"))) == as_map(array_rewards(samples, index(spark), BOOK, "replies"))
    assert as_map(record_rewards(samples, index(spark), BOOK)).keys() == {r[0] for r in ROWS}


def test_counts_over_restarts(spark, tmp_path):
    source, out, counts = tmp_path / "in", tmp_path / "out", str(tmp_path / "counts")
    source.mkdir()

    def run():
        stream = stream_jsonl(spark, str(source), SCHEMA, files_per_batch=3)
        assert stream_keep(stream, str(out), str(tmp_path / "cp"), max_turns=4, counts=counts).awaitTermination(180)
        batch = spark.read.schema(SCHEMA).json(str(source))
        assert stream_counts(spark, counts) == (batch.count(), keep_records(batch, max_turns=4).count())
        found = [json.loads(line)["id"] for file in out.glob("batch=*/*.json") for line in file.open()]
        assert sorted(found) == sorted(r.id for r in keep_records(batch, max_turns=4).collect())

    for part in (CASES[:7], CASES[7:], []):
        for messages, _ in part:
            n = len(list(source.iterdir()))
            (source / f"{n}.json").write_text(json.dumps({"id": n, "messages": messages}) + "\n")
        run()
