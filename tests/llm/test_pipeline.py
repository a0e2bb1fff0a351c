"""The five stages, in a row, against what is planted; pages as rows of a table."""

import random
from hashlib import sha256
from itertools import combinations

import public_tokenizers
import tokenizers

import corpus_pipeline
from tests.llm.test_near import bag, overlap, roots_of
from turnloom.llm.blocks import extract_text

ITEM = "seven sleepy cats watch from an old wooden fence while the quick brown fox jumps over one lazy dog nearby"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, class_id string, ids int"


def test_stages_equal_a_plain_search(spark, tmp_path):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(500)]
    texts = [" ".join(rnd.choice(words) for _ in range(90)) for _ in range(12)]
    texts += [texts[3], texts[3], texts[5].replace(texts[5].split()[40], "other", 1)]
    texts += [f"{texts[7]} {texts[8]} {ITEM} {texts[9]}", f"{ITEM} {texts[10][:80]}"]
    texts += [f"a note password = hunter22hunter {texts[1][100:]}", None, "", "12 34 !", "é one"]
    rows = [(k, t, None if k % 4 == 3 else "aa", None, k, "c", 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    lettered = [k for k, t in enumerate(texts) if any(map(str.isalpha, t or ""))]
    bags = {k: bag(texts[k]) for k in lettered}
    root = roots_of(lettered, [(a, b) for a, b in combinations(lettered, 2) if overlap(bags[a], bags[b]) >= 0.8])
    want = {k for k in lettered if root[k] == k and ITEM not in texts[k]}
    assert set(got) == want and 3 in want and not want & {12, 13, 14, 15, 16, 18, 19, 20}
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    for k, r in got.items():
        text = texts[k].replace("password = hunter22hunter", "[secret]")
        assert (r["text"], r["n_chars"], r["source"]) == (text, len(text), None)
        assert r["input_ids"] == library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(r["input_ids"]) and r["lang"] == "aa"
        assert r["decoded_sha256"] == sha256(library.decode(r["input_ids"], skip_special_tokens=False).encode()).hexdigest()


def test_one_row_of_repeated_documents_stays(spark):
    hot, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(7, hot, "aa", "s", 1)] * 5 + [(7, hot, "aa", None, 1), (9, hot, "aa", "s", 1), (None, hot, "aa", "s", 1)]
    rows += [(None, other, "bb", "s", 2)] * 4 + [(None, other.replace("v3 ", "x "), "bb", "s", 2)] * 2
    rows += [(8, "alone here", None, "s", 3), (3, None, None, None, 0), (3, None, None, None, 0)]
    schema = DOCS.replace(", class_id string, ids int", "")
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema).repartition(3), "").collect()
    assert sorted((r["doc_id"] or 0, r["lang"] or "") for r in got) == [(0, "bb"), (3, ""), (3, ""), (7, "aa"), (8, "")]
    assert {r["text"] for r in got if r["doc_id"] == 7} == {hot}
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows[6:8], schema), "").collect()
    assert [tuple(r) for r in got] == [rows[6]]


def test_unmarked_documents_are_not_shuffled(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(300)]
    rows = [(k, t, "aa", "s", 1) for k, t in enumerate([*texts, texts[5]])]
    docs = spark.createDataFrame(rows, DOCS.replace(", class_id string, ids int", ""))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = corpus_pipeline.near_duplicates(spark, docs, "")
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert {r["doc_id"] for r in found.collect()} == set(range(300))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.lstrip().startswith("Union") and "Join" not in plan.split("SortMergeJoin")[0]


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pages_as_rows(spark):
    page = "<body><nav>Menu</nav><p>Some &amp; text.</p><p>" + "long " * 20000 + "</p></body>"
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", page, "clash", 9), (1, "u", page, "clash", 9), (2, None, None, None, None), (None, "v", "", "x", 1)]
    got = extract_text(spark.createDataFrame(rows, schema)).collect()
    text = "Some & text.\n" + ("long " * 20000).strip()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, "u", text, len(text)), (1, "u", text, len(text)), (2, None, "", 0), (None, "v", "", 0)], key=repr
    )
    assert extract_text(spark.createDataFrame([], schema)).collect() == []
