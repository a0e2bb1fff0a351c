"""Row-local operators on repeated rows, NULL keys and columns named like their results."""

import public_tokenizers
import pytest

from turnloom.llm.bpe import round_trip
from turnloom.llm.langid import language_ids
from turnloom.llm.licenses import scan_licenses
from turnloom.llm.secrets import find_secrets
from turnloom.llm.sharding import shard
from turnloom.llm.token_counts import count_tokens

CLASH = "labels string, score int, words string, hits int, spans int, held_out string, lang_pred int, n_tokens string, size string, place int, range int"
OPERATORS = {
    "counts": lambda df: count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")),
    "languages": language_ids,
    "licenses": scan_licenses,
    "round_trip": lambda df: round_trip(df, public_tokenizers.path("word_bpe_49k.json")),
    "shards": lambda df: shard(df, shards=3),
    "secrets": find_secrets,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_is_answered(spark, name):
    text = "under the mit license token: hunter22 " * 2000
    own = [(1, text, "en"), (1, text, "en"), (None, "some words", None), (2, None, "de"), (3, "", None), (None, None, None)]
    rows = [(*r, None, 1, "w", 2, 3, "h", 4, "t", "s", 5, 6) for r in own]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {CLASH}").coalesce(2)
    got = OPERATORS[name](df).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 1, 1, 2, 3]
    if name != "shards":  # a row's place differs from that of its copy
        first, second = (r for r in got if r["doc_id"] == 1)
        assert first == second
