"""Every query against its SQL, with ordinary and with tiny blocks; and its plan."""

import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.oracle import connect, differences
from turnloom.plans.oracles import ORACLES
from turnloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
# By nature these write a table before they read it.
WRITE = {"split_roundtrip", "jsonl_roundtrip", "token_ids", "detokenize", "untyped_jsonl", "balanced_packing"}
# Users' rules and patterns, and ids.
PYTHON = {"token_ids", "detokenize", "registered_verifier", "pattern_rules"}
LONG = [
    "prompt_records",
    "split_roundtrip",
    "trajectory",
    "running_words",
    "turn_pass",
    "turn_reward",
    "conversation_reward",
    "constraint_lookup",
    "sft_filter",
    "record_spans",
    "mask_span_rows",
    "trajectory_turns",
    "trajectory_totals",
    "array_reward",
]
ORDERED = [
    "running_words",
    "rule_results",
    "turn_reward",
    "conversation_reward",
    "mask_lengths",
    "helpfulness_veto",
    "mask_span_rows",
    "trajectory_turns",
    "filter_role_alternation",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    assert set(contract.queries()) >= set(QUERIES)
    assert set(contract.oracle_sql()) >= set(ORACLES) == set(QUERIES)
    assert contract.entry(spark).columns == ["sample_id", "reward"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(spark, con, SF, name) is None


@pytest.mark.parametrize("name", sorted(ORDERED))
def test_query_with_long_conversations(spark, con, tiny_blocks, name):
    assert differences(spark, con, SF, name) is None


@pytest.fixture(scope="module")
def long_tables(spark, tmp_path_factory):
    """The tables with one conversation of 9000 turns, and one of 5000 without user turns."""
    folder = str(tmp_path_factory.mktemp("long"))
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    text = F.concat_ws(" ", F.lit("the words of turn"), F.col("id"), F.lit("end."))
    more = [
        spark.range(9000).select(F.lit(900007).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), text.alias("text")),
        spark.range(5000).select(F.lit(900008).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), text.alias("text")),
    ]
    turns.union(more[0]).union(more[1]).coalesce(1).write.parquet(f"{folder}/long")
    part = next(Path(f"{folder}/long").glob("part-*.parquet"))
    os.rename(part, f"{folder}/conversations.parquet")
    os.symlink(f"{SF}/documents.parquet", f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(LONG))
def test_query_with_a_conversation_of_9000_turns(spark, long_tables, name):
    assert differences(spark, connect(long_tables), long_tables, name) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITE))
def test_building_a_query_starts_no_job(spark, name):
    group = f"build {name}"
    spark.sparkContext.setJobGroup(group, group)
    QUERIES[name](spark, SF)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")
    # Reading a table's schema is one job of its own each time.
    scans = {j for j in jobs if spark.sparkContext.statusTracker().getJobInfo(j) is not None}
    assert len(scans) <= 3


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["chat_render", "assistant_spans", "tokenize", "loss_mask_simple", "tag_extract", "word_count"]
)
def test_row_local_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON - WRITE))
def test_no_python_in_plans(spark, name):
    assert not re.search("EvalPython|MapInPandas|PythonUDF", plan(spark, name))


def test_epochs_are_one_exchange(spark):
    text = plan(spark, "epoch_batches")
    assert text.count("FileScan parquet") == 2  # rows, and their counts


def test_turn_filters_are_one_exchange(spark):
    for name in ("filter_turn_limit", "filter_word_budget", "filter_content_type"):
        assert plan(spark, name).count("Exchange") == 1


def test_flagship_shuffles_texts_once(spark):
    text = plan(spark, "conversation_reward")
    assert text.count("FileScan parquet") <= 3
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    columns = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sum("text" in c for c in columns) == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_whole_tables(name):
    assert not re.search(r"\bLIMIT\b|USING SAMPLE", ORACLES[name], re.I)
