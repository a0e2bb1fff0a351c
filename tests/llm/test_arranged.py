"""Fill-in-middle, mixing and the Merkle manifest against plain versions, and their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

import tests.oracle as oracle
from turnloom.llm import infill, merkle, mixing
from turnloom.llm.oracles import ORACLES
from turnloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, mark int, size string, tree int, times string, row int, place int, at int"


def frame(spark, rows, parts=3):
    """Rows of (doc_id, text, lang, source, n_chars) beside columns with clashing names."""
    return spark.createDataFrame([(*r, 1, "s", 2, "t", 3, 4, 5) for r in rows], EXTRA).repartition(parts)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows():
    drawn = random.Random(5)
    words = ["a", "Wörter", "x" * 20000, " ", "\x1c", "𝒳y", "<P", "P>", "<"]
    text = lambda n: "".join(drawn.choice(words[:2] + words[3:]) + drawn.choice([" ", "\n", "  ", "\t\x0b", "\r\n"]) for _ in range(n))
    rows = [(k, text(drawn.choice([0, 1, 2, 3, 40, 3000])), "en", f"s{k % 4}", 9) for k in range(60)]
    rows += [(100, None, None, None, None), (101, "", "", "", 0), (102, " \n ", "de", "é", 3), (103, "a <M> b c d e f", "en", "z", 1)]
    rows += [(None, "no id here", "en", "s1", 2), (None, None, None, None, None), (105, words[2] * 30 + " end", "fr", "s2", 5)]
    rows += [(7, "the same row\nagain", "en", "s0", 4)] * 50 + [(8, "one id, other texts " + c, "en", None, 4) for c in "abc"]
    return rows


def plainly_infilled(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc, n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(part) for part in (units[:low], units[low:high], units[high:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    output = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc, n, form, len(p), len(m), sha(output), sha(text)


def test_infill_equals_a_plain_version(spark):
    rows = odd_rows()
    wanted = Counter(plainly_infilled(r[0], r[1]) for r in rows)
    for parts in (1, 5):
        got = infill.infill_digests(frame(spark, rows, parts))
        assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
        assert Counter(map(tuple, got.collect())) == wanted


def test_infill_outputs_restore_their_texts(spark):
    rows = odd_rows()
    got = infill.fill_in_middle(frame(spark, rows), rate=100, spm=50).collect()
    assert {"psm", "spm", "plain"} == {r["form"] for r in got}
    assert Counter((r["doc_id"], infill.restore(r["output"], r["form"])) for r in got) == Counter((r[0], r[1] or "") for r in rows)


def test_infill_moves_pieces_not_texts(spark):
    text = "word " * 200_000
    pieces = infill.in_output_order(frame(spark, [(3, text, None, None, None)]), rate=100).filter("at >= 0").collect()
    assert max(len(r["piece"]) for r in pieces) <= infill.CHARS and len(pieces) > 300
    plan = infill.infill_digests(frame(spark, [(3, text, None, None, None)]).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(mark") == 1


def plainly_mixed(rows, weights=(5, 2, 1), most=3):
    size = lambda text: len(re.findall("[^\x20\x09-\x0d]+", text or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in order if s not in full)
        left = Fraction(total - sum(most * sizes[s] for s in full), rest or 1)
        more = {s for s in order if s not in full and weight[s] * left >= most * sizes[s]}
        if not more:
            return sizes, {s: most * sizes[s] if s in full else weight[s] * left for s in order}
        full |= more


@pytest.mark.parametrize("parts", [1, 4])
def test_mix_comes_near_its_targets(spark, tmp_path, parts):
    drawn = random.Random(2)
    rows = odd_rows() + [(1000 + k, "w " * drawn.randint(0, 90), None, drawn.choice(["big", "big", "tiny"]), None) for k in range(400)]
    rows += [(5000, "again and again", None, "hot", None)] * 300 + [(6000 + k, "an only source " * 400, None, f"t{k}", None) for k in range(5)]
    sizes, targets = plainly_mixed(rows)
    frame(spark, rows, parts).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    got = mixing.mix_digests(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    source = {(r[0], r[3]) for r in rows}
    named = {s: t for s, t in ((s, float(t)) for s, t in targets.items())}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        where = [s for d, s in source if d == r["doc_id"] and sizes[s] == r["source_size"]]
        assert where and any(abs(named[s] - r["target"]) < 1e-6 * max(1, named[s]) for s in where)
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        if len(where) == 1:
            taken[where[0]] += r["taken"]
            largest[where[0]] = max(largest[where[0]], r["size"])
    for s in taken:
        if s is not None and s not in ("s0", "s1"):  # ids that stand in several sources
            assert abs(taken[s] - named[s]) <= largest[s] / 2 + 1e-6, s
    assert Counter(map(tuple, mixing.mix_digests(frame(spark, rows, 2)).collect())) == Counter(map(tuple, got))
    whole = Counter(r["doc_id"] for r in mixing.mix(df).collect())
    empty = {r["doc_id"] for r in got if not r["size"]}
    expected = Counter()
    for r in got:
        expected[r["doc_id"]] += r["taken"] // (r["size"] or 1)
    assert {k: n for k, n in whole.items() if k not in empty} == {k: n for k, n in expected.items() if n and k not in empty}


def test_mix_takes_more_of_the_same_for_a_larger_budget(spark):
    rows = [(k, "w " * (k % 7 + 1), None, "ab"[k % 2], None) for k in range(300)]
    taken = lambda weights: {r["doc_id"]: r["taken"] for r in mixing.mix_digests(frame(spark, rows), weights=weights).collect()}
    less, more = taken((1, 3)), taken((2, 3))
    assert all(less[k] <= more[k] for k in range(0, 300, 2)) and less != more


def plain_tree(leaves):
    """Root and, for each leaf, what stands left and right on its way up."""
    paths = [[] for _ in leaves]
    groups = [[k] for k in range(len(leaves))]
    nodes = list(leaves)
    while len(nodes) > 1:
        runs = [range(at, min(at + 3, len(nodes))) for at in range(0, len(nodes), 3)]
        for run in runs:
            for k in run:
                for member in groups[k]:
                    paths[member].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
        groups = [sum((groups[k] for k in run), []) for run in runs]
        nodes = [sha("".join(nodes[k] for k in run)) for run in runs]
    return nodes[0], paths


def plain_manifest(rows):
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(show, (r[0], r[3], r[2], r[4], text))))
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda x: x[:3])
    trees = {s: plain_tree([x[2] for x in sources[s]]) for s in order}
    root, tops = plain_tree([trees[s][0] for s in order])
    for top, s in zip(tops, order):
        subroot, paths = trees[s]
        for (_, _, own, r), path in zip(sources[s], paths):
            node = own
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0:
                node = leaf(r, None if r[1] is None else r[1].replace("\n", ""))
            for left, right in path + top:
                node = sha(left + node + right)
            proof = sha("".join(left + right for left, right in path + top))
            yield r[0], own, subroot, root, proof, node, node == root


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_equals_a_plain_version(spark, levels):
    rows = odd_rows()
    found = merkle.manifest(frame(spark, rows, 4), whole=False, levels=levels)
    got = [(r["key"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["folded_root"] == r["root"]) for r in found.collect()]
    assert Counter(got) == Counter(plain_manifest(rows))
    assert {True, False} == {r[-1] for r in got}


def test_versions_copy_only_ancestors(spark):
    rows = [(k, "a\nb", None, "s", None) for k in range(100)] + [(1000, "x", None, "t", None)]
    for r in merkle.manifest(frame(spark, rows), levels=2).collect():
        levels = 5 if r["key"] < 1000 else 0
        assert len(r["copied"]) == levels + 2 and len(r["proof"]) == levels + 1
        assert (r["copied"][-1] == r["root"]) == (zlib.crc32(str(r["key"]).encode()) % 2 == 1 or r["key"] == 1000)


def test_put_shares_what_is_not_above_the_leaf():
    tree = merkle.Tree([sha(str(k)) for k in range(20)], 3)
    for at in range(20):
        nodes = [sha(str(k)) for k in range(20)]
        nodes[at] = sha("other")
        assert tree.put(at, sha("other")) == [level[at // 3**k] for k, level in enumerate(merkle.Tree(nodes, 3).levels)]


@pytest.mark.parametrize("operator", [infill.infill_digests, infill.fill_in_middle, mixing.mix_digests, mixing.mix, merkle.merkle_digests])
def test_empty_tables_give_no_rows(spark, operator):
    assert operator(frame(spark, [], 1)).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, monkeypatch, name):
    monkeypatch.setattr(oracle, "QUERIES", QUERIES)
    monkeypatch.setattr(oracle, "ORACLES", ORACLES)
    assert oracle.differences(spark, oracle.connect(SF), SF, name) is None
