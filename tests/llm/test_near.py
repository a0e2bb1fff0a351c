"""Near-duplicate operators against all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from turnloom.llm import bagminhash
from turnloom.llm.bagminhash import REGISTERS, Shingler, near_texts, signatures
from turnloom.llm.components import components, possibly
from turnloom.llm.pivots import near_vectors

DOCS = "doc_id long, text string, n_chars long, class_id string, key int"


def roots_of(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_possible_rows_hold_all_wanted_and_few_others(spark):
    rows = [(k if k % 10 else None, f"t{k}" if k % 15 else None, "payload") for k in range(20_000)]
    df = spark.createDataFrame(rows, "id long, name string, text string").repartition(3)
    wanted = spark.createDataFrame([r[:2] for r in rows[::20]] * 2, "i long, n string")
    found = df.filter(possibly(wanted, "i", "n")("id", "name")).select("id", "name").collect()
    assert {r[:2] for r in rows[::20]} <= {tuple(r) for r in found} and len(found) < 1000 + 600
    assert df.filter(possibly(wanted.limit(0), "i", "n")("id", "name")).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rnd = random.Random(5)
    edges = {
        "chain": [(k, k + 1) for k in range(60)],
        "star": [(99, k) for k in range(50)],
        "random": [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)],
    }[shape]
    got = {r["key"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == {k: v for k, v in roots_of({n for e in edges for n in e}, edges).items() if k in nodes}


def vectors():
    rng = np.random.default_rng(7)
    rows, base = [], rng.normal(size=(120, 24))
    for k in range(600):
        v = base[rng.integers(120)] + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12, 0.25])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    hot = base[0] * 3
    rows += [(k, [float(np.float32(x)) for x in hot], 1) for k in range(600, 700)]
    near = hot + rng.normal(size=(900, 24)) * 0.05
    rows += [(700 + k, [float(np.float32(x)) for x in v], 1) for k, v in enumerate(near)]
    rows += [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, rows[0][1], None)]
    rows += [(2003, [float("nan"), *rows[0][1][1:]], 1), (2004, [None, *rows[0][1][1:]], 1)]
    rows += [(5, rows[5][1], rows[5][2]), (2005, [1.0, 2.0], 0), (None, [1.0] * 24, 2)]
    return rows


def test_vectors_equal_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame(
        [(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, key string"
    )
    got = sorted(tuple(r) for r in near_vectors(df).filter("vec_id IS NOT NULL").collect())
    good = [
        k
        for k, (i, v, label) in enumerate(rows)
        if i is not None and v and label is not None and len(v) == 24
        and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    m = np.array([rows[k][1] for k in good])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    labels = np.array([rows[k][2] for k in good])
    link = (m @ m.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(link, False)
    ids = [rows[k][0] for k in good]
    root = roots_of(set(ids), [(ids[a], ids[b]) for a, b in np.argwhere(link) if a < b])
    want = {k: (0, rows[k][0]) for k in range(len(rows)) if rows[k][0] is not None}
    for at, k in enumerate(good):
        want[k] = (int(link[at].sum()), root[ids[at]])
    links = sum(n for n, _ in want.values())
    assert all(c is not None for *_, c, _ in got)
    assert sum(r[1] for r in got) >= 0.999 * links  # an index: recall is measured
    same = sum(a == (rows[k][0], *w, w[1] == rows[k][0]) for a, (k, w) in zip(
        got, sorted(want.items(), key=lambda x: (rows[x[0]][0], x[1]))))
    assert same >= 0.99 * len(got)
    assert len(got) == len(want)
    for vec_id, n, component, kept in got:
        assert n <= max(w[0] for k, w in want.items() if rows[k][0] == vec_id)  # none too many
        assert kept == (component == vec_id)


def cone(rng, n, dim):
    """Vectors within a cosine of 0.9 or so of each other, each with a near copy."""
    base = rng.normal(size=dim) + rng.normal(size=(n, dim)) * 0.3
    return np.concatenate([base, base + rng.normal(size=(n, dim)) * 0.01])


@pytest.mark.parametrize("n", [1, 300])
def test_vectors_of_one_cone_and_of_two_lengths(spark, n):
    rng = np.random.default_rng(3)
    rows = [v for dim in (12, 20) for v in (cone(rng, n, dim) if n > 1 else np.ones((2, dim)) + np.eye(2, dim) * 0.1)]
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(rows)] + [(9000, [1.0, 2.0, 3.0], 1)]
    got = {r["vec_id"]: tuple(r)[1:] for r in near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = {9000: (0, 9000, True)}
    for part in (rows[: 2 * n], rows[2 * n : 4 * n]):
        m = np.array([v for _, v, _ in part]).astype(np.float32).astype(np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        link = m @ m.T >= 0.98
        np.fill_diagonal(link, False)
        ids = [k for k, *_ in part]
        root = roots_of(ids, [(ids[a], ids[b]) for a, b in np.argwhere(link) if a < b])
        assert link.any(axis=1).all()
        want |= {k: (int(link[at].sum()), root[k], root[k] == k) for at, k in enumerate(ids)}
    assert got == want


def test_vectors_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors(df).collect() == []
    df = spark.createDataFrame([(3, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in near_vectors(df).collect()] == [(3, 0, 3, True)]


def bag(text):
    w = text.split()
    n = min(len(w), 5)
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter()


def overlap(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def texts():
    rnd = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 60, 150]))]
        for _ in range(rnd.randint(1, 5)):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            out.append(" ".join(copy))
    hot = [rnd.choice(vocab) for _ in range(80)]
    out += [" ".join(hot)] * 50
    for _ in range(400):  # one large group of near copies
        copy = list(hot)
        copy[rnd.randrange(80)] = rnd.choice(vocab)
        out.append(" ".join(copy))
    out += ["a b c d e " * 40, "a b c d e " * 38, "a b c d e " * 20]  # multisets, not sets
    rnd.shuffle(out)
    return [*out, None, "", "", " \n", "one", "one", "two", "x " * 20000]


def test_texts_equal_all_pairs(spark):
    rows = [(k, t, 1, "c", 2) for k, t in enumerate(texts())]
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_texts(spark.createDataFrame(rows, DOCS)).collect()}
    bags = {k: bag(t or "") for k, t, *_ in rows}
    index = {}
    edges = set()
    for k, b in bags.items():
        seen = set()
        for s in b:
            for other in index.get(s, ()):
                if other not in seen:
                    seen.add(other)
                    if overlap(b, bags[other]) >= 0.8:
                        edges.add((other, k))
            index.setdefault(s, []).append(k)
    root = roots_of(set(bags), edges)
    assert got == {k: (r, r == k) for k, r in root.items()}


def test_repeated_rows_nulls_and_empty_tables(spark):
    assert near_texts(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(None, "a b c d e f", 1, "c", 2), (7, "a b c d e f", 1, "c", 2), (7, "a b c d e f", 1, "c", 2)]
    got = near_texts(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"], r["kept"]) for r in got) == [(0, 7, False), (7, 7, True), (7, 7, True)]


def test_signatures_estimate_the_weighted_overlap():
    shingler, errors = Shingler(), []
    rnd = random.Random(2)
    for _ in range(60):
        words = [rnd.choice("abcdefgh") for _ in range(300)]
        other = words[: rnd.randint(150, 300)] + [rnd.choice("abcdefgh") for _ in range(40)]
        a, b = " ".join(words), " ".join(other)
        x, y = signatures([shingler.bag(a), shingler.bag(b)])
        errors.append(np.mean(x == y) - overlap(bag(a), bag(b)))
    assert abs(np.mean(errors)) < 3 * 0.5 / (REGISTERS * 60) ** 0.5


def test_signatures_do_not_depend_on_the_batch():
    bags = [Shingler().bag(t) for t in texts() if t and t.split()][:80]
    assert (signatures(bags) == np.concatenate([signatures([b]) for b in bags])).all()


def test_texts_that_share_many_bands_are_compared_once(spark, monkeypatch):
    def groups(table):
        keys = sorted(table.column("key").to_pylist())
        return pa.table({"a": pa.array(keys[:1], pa.binary()), "b": pa.array([b"".join(keys)], pa.binary())})

    monkeypatch.setattr(bagminhash, "_candidates", groups)
    words = [f"w{k}" for k in range(200)]
    copies = [" ".join([*words[:at], f"v{at}", *words[at + 1 :]]) for at in (20, 90, 160)]
    signed = signatures([Shingler().bag(t) for t in copies])
    reps = spark.createDataFrame([(bytes([k]), s.tobytes()) for k, s in enumerate(signed)], "key binary, signature binary")
    banded = reps.mapInArrow(bagminhash._explode_bands, "key binary, band long")
    compared = [bytes(r["b"]) for r in bagminhash._estimated_links(reps, banded).collect()]
    assert b"\0\1\2" in compared and len(compared) == len(set(compared)) <= 4


def test_few_points_are_drawn(monkeypatch):
    bags = [b for b in (Shingler().bag(t) for t in texts() if t) if 40 < len(b[0]) < 200]
    drawn, mix = [], bagminhash.mix
    monkeypatch.setattr(bagminhash, "mix", lambda x: (drawn.append(x.size), mix(x))[1])
    signatures(bags)
    # Seeds, points, registers and values; 120 registers are all met after 640 points on average.
    assert sum(drawn) / len(bags) < 1900
