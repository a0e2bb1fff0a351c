"""Near-duplicate vectors through a pivot-permutation index.

Each vector is described by the ordered list of its nearest pivots. Inverted lists, one per
label, length and pivot, hold the vectors that name the pivot; two vectors that share enough
pivots are candidates, and their cosine decides. A list is worked on in pairs of blocks, so
a list of any length is many small tasks, and a task returns each vector's number of links
and one link of it to a local root instead of the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.components import components, forest, written

#: Pivots a vector is described by, and how many of them a candidate must share.
NEAREST, SHARED = 10, 2
#: Pivots are chosen from a sample of this many vectors at most, none of them closer to
#: another than this cosine; their number grows as a square root up to a bound.
SAMPLE, APART, MOST_PIVOTS, LEAST_PIVOTS = 4096, 0.8, 2048, 32
#: Vectors of a block.
BLOCK = 384


def usable(vector: Column) -> Column:
    """Neither NULL nor zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; divided by their largest component first."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _apart(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of the sample, none close to an earlier one: a dense group gives one pivot, so
    that its members name the same pivots in the same order."""
    closest = np.full(len(sample), -1.0)
    chosen = []
    for k in range(len(sample)):
        if closest[k] < APART and len(chosen) < most:
            chosen.append(k)
            closest = np.maximum(closest, sample @ sample[k])
    return sample[chosen]


def _pivots(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Pivots for each length of more than BLOCK vectors; shorter lists need none."""
    sizes = distinct.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    pivots = {}
    for size, count in sizes.filter(F.col("n") > BLOCK).collect():
        wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 ** np.ceil(np.log2(2 * np.sqrt(count))))))
        sample = distinct.filter(F.size("vector") == size).orderBy("key").select("vector")
        sample = sample.limit(min(4 * wanted, SAMPLE)).collect()
        pivots[size] = _apart(unit(np.array([r["vector"] for r in sample])), wanted)
    return pivots


def describe(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``size``, the vector's length, and ``near``: the numbers of the nearest pivots of
    this length in order. A length without pivots has one list for all its vectors."""
    schema = f"label {vectors.schema['label'].dataType.simpleString()}, key string, copies long, vector array<double>, near array<int>, size int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                lengths = some.column(3).value_lengths().to_numpy()
                for size in np.unique(lengths).tolist():
                    part = some.take(pa.array(np.flatnonzero(lengths == size)))
                    rows = unit(_matrix(part.column(3)))
                    if size in pivots:
                        close = rows @ pivots[size].T
                        k = min(NEAREST, len(pivots[size]))
                        near = np.argpartition(-close, k - 1, axis=1)[:, :k]
                        order = np.argsort(-np.take_along_axis(close, near, 1), axis=1, kind="stable")
                        near = np.take_along_axis(near, order, 1).astype(np.int32)
                    else:
                        near = np.zeros((len(rows), 1), np.int32)
                    arrays = [part.column(k) for k in range(3)]
                    for values, kind in ((rows, pa.float64()), (near, pa.int32())):
                        offsets = pa.array(np.arange(len(rows) + 1) * values.shape[1], pa.int32())
                        arrays.append(pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), kind)))
                    arrays.append(pa.array(np.full(len(rows), size, np.int32)))
                    yield pa.RecordBatch.from_arrays(arrays, ["label", "key", "copies", "vector", "near", "size"])

    return vectors.mapInArrow(run, schema)


def _links(table: pa.Table, least: float, shared: int) -> pa.Table:
    """Links of one pair of blocks of one list: of each vector their number and a root."""
    pivot, low, high = (table.column(c)[0].as_py() for c in ("pivot", "low", "high"))
    blocks = table.column("block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    table, blocks = table.take(pa.array(order)), blocks[order]
    keys = table.column("key").to_pylist()
    copies = table.column("copies").to_numpy()
    vectors = _matrix(table.column("vector").combine_chunks())
    near = _matrix(table.column("near").combine_chunks())
    n = len(keys)
    first = int((blocks == low).sum()) if low != high else n
    a, b = slice(0, first), (slice(first, n) if low != high else slice(0, n))
    names, local = np.unique(near, return_inverse=True)
    marks = np.zeros((n, len(names)), np.float32)
    np.put_along_axis(marks, local.reshape(near.shape), 1, axis=1)
    before = marks[:, names < pivot]
    # With fewer pivots than must be shared, all of them.
    candidate = marks[a] @ marks[b].T >= min(shared, near.shape[1])
    candidate &= before[a] @ before[b].T == 0  # else another list answers for the pair
    if low == high:
        np.fill_diagonal(candidate, False)
    link = candidate & (vectors[a] @ vectors[b].T >= least)
    whole = np.zeros((n, n), bool)
    whole[a, b] = link
    whole |= whole.T
    linked = whole.any(axis=1)
    counts = whole @ copies
    roots = forest(whole)
    some = np.flatnonzero(linked)
    return pa.table(
        {
            "key": pa.array([keys[k] for k in some], pa.string()),
            "links": pa.array(counts[some], pa.int64()),
            "root": pa.array([keys[roots[k]] for k in some], pa.string()),
        }
    )


def near_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = 0.98,
    nearest: int = NEAREST,
    shared: int = SHARED,
) -> DataFrame:
    """``key, n_links, component_id, kept``: vectors of one label with a cosine of ``least``.

    ``n_links`` counts the rows linked directly, copies included; ``component_id`` is the
    least key reachable; ``kept`` is whether it is the row's own. NULL vectors and labels,
    zero vectors, and NULL or non-finite components link with nothing and are kept. Vectors of
    different lengths do not link, those of each length do. Where all vectors of a length lie
    so close that ten pivots or fewer stand apart, all pairs of a label are compared. Repeated rows link with each
    other. A NULL key stays NULL and is not kept unless it links with nothing. An empty
    table gives no rows; other columns are not read.
    """
    good = usable(F.col(vector)) & F.col(label).isNotNull()
    rows = df.select(
        F.col(key).alias("id"),
        F.col(label).alias("label"),
        F.when(good, F.col(vector)).alias("vector"),
    ).withColumn(
        "key",
        F.when(
            F.col("vector").isNotNull(),
            F.concat(
                F.hex(F.xxhash64("label", "vector")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "vector", "label"))
            ),
        ),
    )
    distinct = written(
        rows.filter("vector IS NOT NULL")
        .groupBy("label", "key")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"), F.min("id").alias("id")),
        "vectors",
    )
    count = distinct.count()
    if not count:
        return df.select(
            F.col(key), F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.lit(True).alias("kept")
        )
    vectors = distinct.select("label", "key", "copies", "vector")
    described = written(describe(vectors, _pivots(distinct)), "described")
    listed = described.withColumn("pivot", F.explode("near"))
    sizes = (
        described.select("label", "size", F.explode("near").alias("pivot"))
        .groupBy("label", "size", "pivot")
        .agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    blocks = listed.join(sizes, ["label", "size", "pivot"]).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    )
    paired = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "size", "pivot", "key", "copies", "vector", "near", "block",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
    )

    def work(table: pa.Table) -> pa.Table:
        return _links(table, least, shared)

    links = written(
        paired.groupBy("label", "size", "pivot", "low", "high").applyInArrow(work, "key string, links long, root string"),
        "vector-links",
    )
    roots = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")), "vector-components")
    counts = links.groupBy("key").agg(F.sum("links").alias("links"))
    classes = written(
        distinct.select("key", "copies", "id")
        .join(counts, "key", "left")
        .join(roots, "key", "left")
        .select(
            "key",
            "id",
            F.coalesce("root", "key").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "vector-classes",
    )
    # A table, so that the join with it is of two plain shuffles, whose hot roots Spark can split.
    least_id = written(classes.groupBy("root").agg(F.min("id").alias("component")), "vector-least")
    answers = classes.join(least_id, "root").select("key", "n_links", "component")
    own = F.coalesce("component", "id")
    return rows.select("id", "key").join(answers, "key", "left").select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        own.eqNullSafe(F.col("id")).alias("kept"),
    )
