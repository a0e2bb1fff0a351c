"""Packs by size, their ranks, epochs, and records without a schema."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from turnloom.operators import packing
from turnloom.operators.keep import keep_records
from turnloom.operators.packing import balanced_packs, best_fit, epochs, levelled, matched, packs
from turnloom.sources.tables import read_untyped, untyped_messages, write_untyped


@given(st.lists(st.integers(0, 40), max_size=60), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_best_fit(sizes, budget):
    places = best_fit(sizes, budget)
    sums, members = {}, {}
    for size, place in zip(sizes, places):
        sums[place] = sums.get(place, 0) + size
        members[place] = members.get(place, 0) + 1
    assert all(total <= budget or members[p] == 1 for p, total in sums.items())
    assert sorted(sums) == list(range(len(sums)))
    fitting = sorted(total for total in sums.values() if total <= budget)
    # No two packs that fit into one, or the fuller would have been filled.
    assert len(fitting) < 2 or fitting[0] + fitting[1] > budget


@given(st.integers(1, 9), st.lists(st.lists(st.integers(0, 100), max_size=30), max_size=12))
@settings(max_examples=200, deadline=None)
def test_matching_keeps_loads_within_one_pack(ranks, shards):
    loads, largest = [0] * ranks, max((size for shard in shards for size in shard), default=0)
    for shard in shards:
        bundles = [0] * ranks
        for size, bundle in zip(shard, levelled(shard, [0] * ranks)):
            bundles[bundle] += size
        assert max(bundles) - min(bundles) <= largest
        for total, load in zip(bundles, matched(bundles, loads)):
            loads[load] += total
        assert max(loads) - min(loads) <= largest


@pytest.mark.parametrize("fan", [2, 256])
def test_balanced_packs(spark, monkeypatch, fan):
    monkeypatch.setattr(packing, "SHARD", 64)
    monkeypatch.setattr(packing, "FAN", fan)
    drawn = random.Random(1)
    rows = [(k if k else None, drawn.choice([None, 0, 3, 40, 90, 99, 500]) if k % 5 else drawn.randint(1, 100)) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, n long").repartition(5)
    got = balanced_packs(df, ["id"], "n", 100, 3, seed=2).collect()
    assert sorted((r.id or 0, r.n or 0) for r in got) == sorted((k or 0, n or 0) for k, n in rows)
    whole, ranks, members = {}, {}, {}
    for r in got:
        assert whole.setdefault(r.pack_id, [r["rank"], 0, 0])[0] == r["rank"]
        whole[r.pack_id][1] += r.n or 0
        whole[r.pack_id][2] += 1
        ranks[r["rank"]] = ranks.get(r["rank"], 0) + (r.n or 0)
    assert all(size <= 100 or n == 1 for _, size, n in whole.values())
    assert set(ranks) == {0, 1, 2} and max(ranks.values()) - min(ranks.values()) <= 500
    again = balanced_packs(df.repartition(2), ["id"], "n", 100, 3, seed=2)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))
    assert len(whole) < packs(df, ["id"], "n", 100, seed=2).select("pack_id").distinct().count()


def test_null_keys_are_packed(spark):
    df = spark.createDataFrame([(None, 1), (2, None), (3, 9)], "id long, n long")
    assert packs(df, ["id"], "n", 10).count() == 3


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, n long")
    assert balanced_packs(df, ["id"], "n", 10, 2).collect() == []
    assert epochs(df, ["id"], 2, 4).collect() == []


def test_epochs_number_every_row_once(spark):
    df = spark.createDataFrame([(k if k else None, "x") for k in range(50)], "id long, note string")
    rows = epochs(df, ["id"], 3, 8, seed=4).collect()
    orders = [[r.id for r in sorted(rows, key=lambda r: r.ix) if r.epoch == e] for e in range(3)]
    assert all(sorted(x or 0 for x in order) == list(range(50)) for order in orders) and len({tuple(o) for o in orders}) == 3
    assert {(r.ix, r.batch_id) for r in rows} == {(k, k // 8) for k in range(50)}


UNTYPED = [
    ({"id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "more": {"x": [1, None]}}, True),
    ({"id": "two", "messages": [{"role": "user", "content": 5}]}, False),
    ({"id": 3, "messages": [{"role": "user", "content": ["a"]}]}, False),
    ({"id": 4, "messages": [{"role": "user"}]}, False),
    ({"id": 5, "messages": [{"role": "user", "content": None}]}, False),
    ({"id": 6, "messages": [{"role": 7, "content": "a"}]}, False),
    ({"id": 7, "messages": []}, True),
    ({"id": 8, "messages": "none"}, None),
    ({"id": 9}, None),
    ({"id": 10, "messages": [{"role": "user", "content": "ü \" \n"}, {"role": "user", "content": "b"}]}, False),
    ({"id": 11, "messages": ["text", {"role": "user", "content": "a"}]}, False),
]


def test_untyped_records(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text("".join(json.dumps(r) + "\n" for r, _ in UNTYPED))
    records = read_untyped(spark, str(tmp_path / "in.jsonl"))
    listed = records.withColumn("messages", untyped_messages(records.record))
    kept = keep_records(listed, max_turns=4)
    write_untyped(kept, str(tmp_path / "out"))
    lines = [json.loads(line) for file in (tmp_path / "out").glob("*.txt") for line in file.open()]
    assert lines == [r for r, ok in UNTYPED if ok]
    assert listed.filter("messages IS NULL").count() == 2
