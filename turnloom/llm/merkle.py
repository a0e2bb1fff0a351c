"""Merkle manifest of a table: a tree of digests per source, a tree of sources above, and versions.

Leaves are cut into aligned blocks of 3 ** 7, which are whole subtrees; a block is built in one
task from digests alone, and block roots are the leaves of the next level of blocks. A tree is
persistent: putting another leaf copies only the nodes above it, level by level to the root
of its block, and shares all others. Versions go on through the upper levels where their block
is: what stands beside the block's way to the root is one small row per block, made by the
same blocks over block roots and joined back.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.components import written

#: Children of a node, and levels of a block.
WIDTH, LEVELS = 3, 7
#: Columns of a leaf, in order (fixed value).
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What stands left and right of the nodes on a way up.
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def climbed(node: str, beside: list[tuple[str, str]]) -> list[str]:
    """A node and its new ancestors, given what stands beside them."""
    nodes = [node]
    for left, right in beside:
        nodes.append(digest(left, nodes[-1], right))
    return nodes


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while WIDTH**levels < n:
        levels += 1
    return levels


class Tree:
    """A block's nodes by level; leaves are level 0. A lone node still goes up where the tree is higher."""

    def __init__(self, leaves: list[str], height: int) -> None:
        self.levels = [leaves]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([digest(*below[at : at + WIDTH]) for at in range(0, len(below), WIDTH)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """What stands left and right of a leaf's ancestors in their runs, level by level."""
        found = []
        for nodes in self.levels[:-1]:
            start = at - at % WIDTH
            found.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + WIDTH])))
            at //= WIDTH
        return found

    def put(self, at: int, leaf: str) -> list[str]:
        """The version with another leaf: its copied nodes, from the leaf to the block's root.
        All other nodes are those of this tree."""
        return climbed(leaf, self.siblings(at))


def field(column: Column) -> Column:
    """``-`` for NULL, else the value's bytes in UTF-8, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(values[name]) for name in FIELDS]), 256)


def leaves(df: DataFrame) -> DataFrame:
    """``tree, key, leaf, changed``: a digest of each row, and of the tampered one where there is one.

    A tree's name sorts as its source does, NULL first. Rows whose id has an even CRC-32 lose
    the line feeds of their text; a NULL id counts as one without digits.
    """
    own = {name: F.col(name) for name in FIELDS}
    tampered = own | {"text": F.replace("text", F.lit("\n"), F.lit(""))}
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return df.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
        F.col("doc_id").alias("key"),
        leaf(own).alias("leaf"),
        F.when(F.crc32(named) % 2 == 0, leaf(tampered)).alias("changed"),
    )


def numbered(leaves: DataFrame) -> DataFrame:
    """Leaves with ``at``, their place in their tree by key (NULL first), then digest, and ``n``,
    the leaves of the tree.

    Rows are dealt in ranges of tree and key, so a hot tree lies in many tasks; counts by tree
    and range carry the numbers across. Equal rows are told apart by a number.
    """
    fixed = written(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    order = [F.col(c).asc_nulls_first() for c in ("tree", "key", "leaf", "row")]
    ranged = written(
        fixed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("nth", F.monotonically_increasing_id()),
        "merkle-ranges",
    )
    counts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("nth").alias("first"))
    # One row for each tree and range.
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(
        "tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n")
    )
    placed = ranged.join(counts, ["tree", "part"]).withColumn("at", F.col("nth") + F.col("shift"))
    return placed.drop("part", "nth", "shift", "row")


def in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("at") / WIDTH**levels).cast("long"))


def _built(table: pa.Table, levels: int) -> tuple[Tree, list[int]]:
    """The tree of a block's leaves, and which row of the table each leaf is."""
    order = table.column("at").to_numpy().argsort().tolist()
    found = table.column("leaf").to_pylist()
    return Tree([found[k] for k in order], min(height(table.column("n")[0].as_py()), levels)), order


def block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """``tree, at, n, leaf``: the blocks of each tree as the leaves of a tree above."""

    def root(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        row = {"tree": table.column("tree")[0].as_py(), "at": table.column("block")[0].as_py()}
        return pa.Table.from_pylist([row | {"n": -(-n // WIDTH**levels), "leaf": _built(table, levels)[0].root}])

    used = in_blocks(nodes, levels).select("tree", "block", "at", "n", "leaf")
    return used.groupBy("tree", "block").applyInArrow(root, "tree string, at long, n long, leaf string")


def ways(nodes: DataFrame, levels: int) -> DataFrame:
    """``tree, at, path, root``: for each node (``tree, at, n, leaf``) what stands beside its way to
    the root of its tree. Blocks over blocks, until a tree is one block."""
    most = nodes.agg(F.max("n")).first()[0]

    def beside(table: pa.Table) -> pa.Table:
        tree, order = _built(table, levels)
        name, block = table.column("tree")[0].as_py(), table.column("block")[0].as_py()
        places = table.column("at").to_pylist()
        rows = [
            {
                "tree": name,
                "at": places[row],
                "block": block,
                "path": [{"left": left, "right": right} for left, right in tree.siblings(at)],
                "root": tree.root,
            }
            for at, row in enumerate(order)
        ]
        return pa.Table.from_pylist(rows, schema=arrow)

    side = pa.struct([("left", pa.string()), ("right", pa.string())])
    arrow = pa.schema(
        [("tree", pa.string()), ("at", pa.int64()), ("block", pa.int64()), ("path", pa.list_(side)), ("root", pa.string())]
    )
    found = in_blocks(nodes, levels).groupBy("tree", "block").applyInArrow(
        beside, f"tree string, at long, block long, path {PATH}, root string"
    )
    if most is None or most <= WIDTH**levels:
        return found.drop("block")
    above = ways(written(block_roots(nodes, levels), "merkle-blocks"), levels)
    above = above.select("tree", F.col("at").alias("block"), F.col("path").alias("_above"), F.col("root").alias("_root"))
    return found.join(above, ["tree", "block"]).select(
        "tree", "at", F.concat("path", "_above").alias("path"), F.col("_root").alias("root")
    )


def _top(subroots: DataFrame, levels: int) -> DataFrame:
    """``tree, path, root``: from each source's root to the root of all."""
    sources = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "leaf"))
    found = ways(sources, levels).select("at", "path", "root")
    return sources.join(found, "at").select(F.col("key").alias("tree"), "path", "root")


def manifest(df: DataFrame, whole: bool = True, levels: int = LEVELS) -> DataFrame:
    """``key, tree, at, leaf, subroot, root``, and of every leaf its proof and its version.

    ``proof`` is the siblings on the way from the leaf to the root, level by level, those of a
    run joined left to right. ``copied`` is the nodes of the leaf's version from leaf to root: with
    the tampered leaf where there is one, else the leaf itself. Without ``whole`` only the
    proof's digest, ``proof_sha256``, and the version's root, ``folded_root``, are given.

    Trees are named ``=`` and the source, or by the empty text for NULL. Equal keys follow their
    digests; rows that repeat are a leaf each; an empty table gives none. A block has 3 ** ``levels``
    leaves.
    """
    rows = numbered(leaves(df))
    roots = written(block_roots(rows, levels), "merkle-blocks")
    inner = written(ways(roots, levels), "merkle-ways")
    top = _top(inner.select("tree", F.col("root").alias("leaf")).distinct(), levels)
    above = inner.join(top.select("tree", F.col("path").alias("_up"), F.col("root").alias("_root")), "tree").select(
        "tree", F.col("at").alias("block"), F.concat("path", "_up").alias("path"), F.col("root").alias("subroot"), F.col("_root").alias("root")
    )
    key = rows.schema["key"].dataType.simpleString()
    last = "proof array<string>, copied array<string>" if whole else "proof_sha256 string, folded_root string"

    def answer(table: pa.Table, way: pa.Table) -> pa.Table:
        tree, order = _built(table, levels)
        up = [(step["left"], step["right"]) for step in way.column("path")[0].as_py()]
        found, changed = table.column("leaf").to_pylist(), table.column("changed").to_pylist()
        high = [left + right for left, right in up]
        proofs, versions = [], []
        for at, row in enumerate(order):
            beside = tree.siblings(at)
            proof = [left + right for left, right in beside] + high
            copied = tree.put(at, changed[row] or found[row])
            copied += climbed(copied[-1], up)[1:]
            proofs.append(proof if whole else digest(*proof))
            versions.append(copied if whole else copied[-1])
        ordered = table.take(pa.array(order, pa.int64()))
        n = len(order)
        columns = [ordered.column(c) for c in ("key", "tree", "at", "leaf")]
        columns += [pa.array([way.column(c)[0].as_py()] * n, pa.string()) for c in ("subroot", "root")]
        kind = pa.list_(pa.string()) if whole else pa.string()
        names = ["key", "tree", "at", "leaf", "subroot", "root", *(c.split()[0] for c in last.split(", "))]
        return pa.table([*columns, pa.array(proofs, kind), pa.array(versions, kind)], names)

    schema = f"key {key}, tree string, at long, leaf string, subroot string, root string, {last}"
    return in_blocks(rows, levels).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(answer, schema)


def merkle_digests(df: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row; see
    ``manifest``. Other columns than those of a leaf are not read."""
    found = manifest(df, whole=False)
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
