"""Files, order, batches, vocabulary and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_keep import CASES, SCHEMA
from tests.test_scoring import BOOK, SAMPLES, index, sample
from turnloom.functions.tokens import PIECES
from turnloom.operators.keep import keep_records
from turnloom.operators.order import batches, shuffled
from turnloom.operators.records import first_and_rest, prompt_records
from turnloom.operators.vocab import _asked, _common, decode, encode, vocabulary
from turnloom.plans.prompts import prepare_prompts
from turnloom.plans.scoring import record_rewards
from turnloom.session import new_path, shared_dir
from turnloom.sources.tables import read_dataset, read_jsonl, write_jsonl
from turnloom.streaming.files import stream_batches, stream_jsonl, stream_keep

INSTRUCTIONS = (
    "id string, prompt array<struct<role:string,content:string>>,"
    " verifier array<array<struct<id:string,placeholder:string>>>, persona string"
)


def lines(folder):
    return [json.loads(line) for file in folder.glob("**/*.json") for line in file.open()]


def test_jsonl_sink(spark, tmp_path):
    df = spark.createDataFrame([("é 中", None), ("b", 1)], "text string, n int")
    target = tmp_path / "deep" / "out"
    assert write_jsonl(df, str(target)) == 2
    assert write_jsonl(df, str(target)) == 2
    raw = [line for file in target.glob("*.json") for line in file.open("rb")]
    assert len(raw) == 2 and all(max(line) < 128 for line in raw)
    assert sorted(lines(target), key=str) == [{"text": "b", "n": 1}, {"text": "é 中", "n": None}]
    back = read_jsonl(spark, str(target), "text string, n int", {"label": "n", "input": "text"})
    assert back.columns == ["label", "input"]
    assert sorted(r.input for r in back.collect()) == ["b", "é 中"]


def test_split_is_pruned(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train").otherwise("eval"))
    path = str(tmp_path / "data")
    df.write.partitionBy("split").parquet(path)
    train = read_dataset(spark, path)
    assert train.columns == ["id"] and train.count() == 7
    assert read_dataset(spark, path, split="eval").count() == 3
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().toString()


def test_prompt_files(spark, tmp_path):
    rows = [
        (str(i), [("user", f"p{i}"), ("user", "more")], [[("c", "x")], []], f"who {i}")
        for i in range(40)
    ]
    sources = []
    for name, part in (("train", rows[:30]), ("eval", rows[30:])):
        sources.append(str(tmp_path / f"{name}.parquet"))
        spark.createDataFrame(part, INSTRUCTIONS).write.parquet(sources[-1])
    targets = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert prepare_prompts(spark, *sources, *targets, seed=1) == {"train": 30, "eval": 10}
    records = {r["metadata"]["id"]: r for r in lines(tmp_path / "a")}
    assert records["3"] == {
        "prompt": "p3",
        "label": "0",
        "metadata": {
            "id": "3",
            "prompt": [{"role": "user", "content": "p3"}, {"role": "user", "content": "more"}],
            "verifier": [[{"id": "c", "placeholder": "x"}], []],
            "persona": "who 3",
        },
    }
    assert len(records) == 30 and [r["metadata"]["id"] for r in lines(tmp_path / "b")] != sorted(
        r[0] for r in rows[30:]
    )


def test_empty_prompt_is_an_error(spark):
    df = spark.createDataFrame([("1", [], [], "w")], INSTRUCTIONS)
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        prompt_records(df).collect()


def test_first_and_rest(spark):
    df = spark.createDataFrame([("1", [("user", "a"), ("user", "b")], [], "w")], INSTRUCTIONS)
    row = df.select(*first_and_rest(F.col("prompt"))).first()
    assert (row.first.content, [m.content for m in row.rest], row.n_turns) == ("a", ["b"], 2)


def test_order_does_not_depend_on_partitioning(spark):
    df = spark.range(500)
    order = [r.id for r in shuffled(df, ["id"], seed=3).collect()]
    assert order == [r.id for r in shuffled(df.repartition(7), ["id"], seed=3).collect()]
    assert order != [r.id for r in shuffled(df, ["id"], seed=4).collect()]
    assert sorted(order) == list(range(500)) != order
    rows = batches(df.repartition(5), ["id"], batch_size=64, seed=3).orderBy("ix").collect()
    assert [r.id for r in rows] == order
    assert [r.ix for r in rows] == list(range(500))
    assert [r.batch_id for r in rows] == [i // 64 for i in range(500)]


def test_vocabulary_round_trip(spark):
    texts = ["<|im_start|>user\na a b<|im_end|>\n", "", "c <  é", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn(
        "tokens", PIECES.one(F.col("text"))
    )
    words = vocabulary(df, F.col("tokens"), PIECES.specials)
    ids = {r.token: r.id for r in words.collect()}
    distinct = {t for r in df.collect() for t in r.tokens or []} | set(PIECES.specials)
    assert set(ids) == distinct and sorted(ids.values()) == list(range(len(distinct)))
    assert (ids["<|im_start|>"], ids["<|im_end|>"]) == (0, 1)
    expected = {r.id: r.tokens and [ids[t] for t in r.tokens] for r in df.collect()}
    for limits in ({}, {"max_rows": 1}):
        coded = encode(df, "tokens", words, ["id"], **limits)
        assert {r.id: r.tokens for r in coded.collect()} == expected
        back = decode(coded, "tokens", words, ["id"], **limits)
        assert {r.id: r.tokens and "".join(r.tokens) for r in back.collect()} == {
            i: t and t or (None if t is None else []) for i, t in enumerate(texts)
        }
        part = words.filter("token <> 'a'")
        unknown = encode(df, "tokens", part, ["id"], unknown=-1, **limits)
        assert {r.id: r.tokens for r in unknown.collect()}[0].count(-1) == 2


def test_large_vocabulary_asks_for_rare_tokens_only(spark):
    rows = [(k % 7 if k % 5 else None, ["a", " ", "a", f"w{k // 2}", " ", f"v{k}", "<|im_end|>"]) for k in range(60)]
    rows += [rows[3], rows[3], (1, ["a", None, "w1"]), (2, []), (None, None)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    words = vocabulary(df.filter("NOT exists(tokens, t -> t IS NULL)"), F.col("tokens"), PIECES.specials)
    ids = {r.token: r.id for r in words.collect()}
    counts = {r.token: r.n for r in words.collect()}
    assert (counts["a"], counts["<|im_start|>"], counts["w1"], counts["v3"]) == (62, 0, 4, 3)

    def as_set(rows):
        return sorted((str(r[0]), str(r[1])) for r in rows)

    coded = [(i, None if t is None else [ids.get(x) for x in t]) for i, t in rows]
    missing = [(i, None if t is None else [-1 if x in ("w1", "a", None) else ids[x] for x in t]) for i, t in rows]
    for table in (words, words.drop("n")):
        counted, common = _common(table, F.col("tokens"), df, "token", 5, 10_000)
        copied = {r.token for r in counted.filter(common).collect()}
        assert {"a", " ", "<|im_end|>"} <= copied and len(copied) <= 5
        shared = spark.sparkContext.broadcast(dict.fromkeys(copied))
        asked = _asked(df, "tokens", ["id"], shared).collect()
        once = [{x for x in t or [] if x is not None} - copied for _, t in rows]
        assert len(asked) == sum(map(len, once))
        for max_rows in (0, 5, 40):
            limits = {"max_rows": max_rows}
            there = encode(df, "tokens", table, ["id"], **limits)
            assert as_set(there.collect()) == as_set(coded)
            part = table.filter("token NOT IN ('w1', 'a')")
            found = encode(df, "tokens", part, ["id"], unknown=-1, **limits)
            assert as_set(found.collect()) == as_set(missing)
        assert as_set(decode(there, "tokens", table, ["id"], **limits).collect()) == as_set(rows)


def test_shared_folder(spark):
    folder = shared_dir(spark)
    first, second = new_path(spark, "a"), new_path(spark, "a")
    assert first != second and first.startswith(folder) and folder == shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir()


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n, (messages, _) in enumerate(CASES):
        (source / f"{n}.json").write_text(json.dumps({"id": n, "messages": messages}) + "\n")
    stream = stream_jsonl(spark, str(source), SCHEMA, files_per_batch=4)
    query = stream_keep(stream, str(tmp_path / "out"), str(tmp_path / "cp"), max_turns=4)
    query.awaitTermination(120)
    batch = keep_records(spark.read.schema(SCHEMA).json(str(source)), max_turns=4)
    assert sorted(r["id"] for r in lines(tmp_path / "out")) == sorted(r.id for r in batch.collect())


def test_stream_rewards(spark, tmp_path):
    rows = [
        sample(1, ["a b"], [[("short", None)]]),
        sample(2, ["a b c d"], [[("short", None)]]),
        sample(3, ["a"], [[], []]),
        sample(4, [], []),
    ]
    df = spark.createDataFrame(rows, SAMPLES)
    write_jsonl(df.repartition(4), str(tmp_path / "in"))
    stream = stream_jsonl(spark, str(tmp_path / "in"), SAMPLES, files_per_batch=1)
    job = lambda samples: record_rewards(samples, index(spark), BOOK)
    stream_batches(stream, job, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(180)
    found = {r.sample_id: r.reward for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {r.sample_id: r.reward for r in job(df).collect()}
    assert found == {1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0}
