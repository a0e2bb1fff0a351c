"""What Python workers hold: texts sent once, a few at a time, and one operator's tables."""

import gc
import re
import tracemalloc

import public_tokenizers
import pyarrow as pa

from turnloom.llm.bpe import Bpe, encode, encode_decode
from turnloom.llm.decontam import Templater, _emit
from turnloom.llm.texts import map_texts

WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string"


def test_a_text_that_is_a_key_goes_to_the_worker_once(spark):
    df = spark.createDataFrame([(1, "a bcd", "x"), (2, None, None)], SCHEMA)
    for keys in (["doc_id", "text", "lang"], ["text"], ["lang"]):
        found = map_texts(df, keys, "text", lambda: lambda texts: [[len(t or "") for t in texts]], "n long")
        sent = re.search(r"MapInArrow.*?\n.*?Project \[(.*?)\]", found._jdf.queryExecution().analyzed().toString())
        assert sent[1].count("text#") == 1 and found.columns == [*keys, "n"]
        rows = [{"doc_id": 1, "text": "a bcd", "lang": "x", "n": 5}, {"doc_id": 2, "text": None, "lang": None, "n": 0}]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted((tuple(r[c] for c in (*keys, "n")) for r in rows), key=repr)
    got = encode_decode(df, WORDS, ("doc_id", "text")).collect()
    assert [r["text"] for r in got] == ["a bcd", None] and got[0]["ids"] and not got[1]["ids"]


def test_workers_drop_another_operators_tables(spark):
    df = spark.createDataFrame([(k, f"word{k}", "x") for k in range(16)], SCHEMA).repartition(16)
    assert encode(df, WORDS).count() == 16

    def make():
        held = sum(isinstance(x, Bpe) for x in gc.get_objects())
        return lambda texts: [[held] * len(texts)]

    encode(df, WORDS).collect()
    assert {r["held"] for r in map_texts(df, ["doc_id"], "text", make, "held int").collect()} == {0}


def test_windows_are_cut_from_a_few_texts_at_a_time(spark):
    sizes = []

    class Frame:  # gives the task's function, which Spark would pickle
        schema = spark.createDataFrame([], SCHEMA).schema

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    texts = [" ".join(f"w{k}x{j}" for j in range(9)) for k in range(1000)]
    batch = pa.RecordBatch.from_pydict({"k": list(range(1000)), "t": texts})

    class Batch:
        def column(self, k):
            return Column(batch.column(k)) if k else batch.column(k)

    class Column:
        def __init__(self, array):
            self.array = array

        def __len__(self):
            return len(self.array)

        def slice(self, at, n):
            return Column(self.array.slice(at, n))

        def to_pylist(self):
            sizes.append(len(self.array))
            return self.array.to_pylist()

    out = list(_emit(Frame(), "doc_id", "text", [], None, True)(iter([Batch()])))
    assert max(sizes) <= 256 and sum(sizes) == 1000
    rows = [r for part in out for r in part.to_pylist()]
    assert {r["id"] for r in rows} == set(range(1000)) and {r["n_words"] for r in rows} == {9}
    first = next(Templater().windows(Templater().canonical(texts[700]), 8)).hash.view("int64").tolist()
    assert set(first) <= {r["window"] for r in rows if r["id"] == 700}


def test_tables_of_merges_and_remembered_words_are_small():
    with open(WORDS, "rb") as file:
        data = file.read()
    tracemalloc.start()
    try:
        machine = Bpe(data)
        gc.collect()
        tables = tracemalloc.get_traced_memory()[0]
        words = [f"{a}{b}" for a in "stnr" for b in ("and", "ing", "able", "to")]
        kept = [machine.word(w) for w in words]
    finally:
        tracemalloc.stop()
    assert tables < 50e6  # 67 MB when each token had its own spelling, edges and leaf
    assert all(isinstance(k, bytes) for k in kept)
    assert machine.numbers(words) == [t for w in words for t in machine.machine.run(machine.symbols(w))]
    for w in words:
        tokens = machine.machine.run(machine.symbols(w))
        assert [s for t in tokens for s in machine.machine.spelled(t)] == machine.symbols(w)
        assert tokens == machine.machine.merge(machine.symbols(w))
