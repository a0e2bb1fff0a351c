"""Token ids from a vocabulary table ``(token, id)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.operators.joins import MAX_BYTES, MAX_ROWS, fits_broadcast
from turnloom.operators.order import with_dense_index
from turnloom.session import stored

#: What a lookup gives, in Spark and in Arrow.
_KINDS = {"token": ("string", pa.string()), "id": ("int", pa.int32())}


def vocabulary(df: DataFrame, tokens: Column, specials: tuple[str, ...], seed: int = 0) -> DataFrame:
    """Every distinct token with a dense id; the special tokens come first. ``n`` is the number of
    rows that hold the token.

    Repeats are dropped map-side. Ids follow a hash of the token, so numbering needs no
    global sort. Distinct tokens and the vocabulary are written out once each, since both
    are read several times: for counts and numbers, and for measuring and lookup.
    """
    found = (
        df.select(F.explode(F.array_distinct(tokens)).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spark = df.sparkSession
    found = stored(found, "tokens")
    others = found.filter(~F.col("token").isin(*specials))
    numbered = with_dense_index(others, ["token"], seed, name="id", start=len(specials))
    marks = spark.createDataFrame(
        [(token, i) for i, token in enumerate(specials)], "token string, id bigint"
    )
    seen = marks.join(found.filter(F.col("token").isin(*specials)), "token", "left")
    columns = ["token", "id", F.coalesce("n", F.lit(0)).alias("n")]
    return stored(seen.select(*columns).unionByName(numbered.select(*columns)), "vocabulary")


def _map_lists(lists: pa.Array, change) -> pa.Array:
    """Apply ``change`` to the flat values of a list array, keeping its shape."""
    flat = change(lists.flatten())
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype("int32"))
    mask = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(offsets, flat, mask=mask)


def _copied(spark: SparkSession, table: DataFrame, source: str, target: str):
    """A measured table on the workers; one hash table per worker."""
    rows = table.select(source, target).toArrow()
    return spark.sparkContext.broadcast(
        dict(zip(rows.column(source).to_pylist(), rows.column(target).to_pylist()))
    )


def _changed(lists: pa.Array, find, value: pa.DataType, unknown) -> pa.Array:
    def change(flat: pa.Array) -> pa.Array:
        coded = flat.dictionary_encode()
        targets = pa.array([find(v, unknown) for v in coded.dictionary.to_pylist()], value)
        found = pc.take(targets, coded.indices)
        return found if unknown is None else pc.fill_null(found, pa.scalar(unknown, value))

    return _map_lists(lists, change)


def _broadcast_lookup(spark: SparkSession, table: DataFrame, source: str, target: str, unknown):
    """A function that maps arrays through a measured table, in Arrow batches."""
    shared = _copied(spark, table, source, target)
    kind, value = _KINDS[target]

    @F.arrow_udf(f"array<{kind}>")
    def mapped(lists: pa.Array) -> pa.Array:
        return _changed(lists, shared.value.get, value, unknown)

    return mapped


def _common(table: DataFrame, asked: Column, df: DataFrame, source: str, max_rows: int, max_bytes: int):
    """A condition on ``table`` and its counts ``n``: the commonest entries, as many classes of
    counts (eight to each power of two) as are within the limits."""
    if "n" not in table.columns:
        counts = df.select(F.explode(F.array_distinct(asked)).alias(source)).groupBy(source)
        counts = counts.agg(F.count(F.lit(1)).alias("n"))
        table = table.join(counts, source, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    level = F.floor(F.log2(F.col("n") + 1) * 8)
    size = F.octet_length(F.to_json(F.struct("token", "id")))
    sizes = (
        table.select(level.alias("level"), size.alias("bytes"))
        .groupBy("level")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
        .orderBy(F.desc("level"))
        .collect()
    )
    least = None
    for row in sizes:  # some hundred levels at most
        max_rows, max_bytes = max_rows - row["rows"], max_bytes - row["bytes"]
        if max_rows < 0 or max_bytes < 0:
            break
        least = row["level"]
    return table, F.lit(False) if least is None else level >= least


def _asked(df: DataFrame, column: str, names: list[str], shared) -> DataFrame:
    """``names`` and ``_from``: each row's values that are not copied, once each."""

    @F.arrow_udf(df.schema[column].dataType)
    def rare(lists: pa.Array) -> pa.Array:
        known, flat = shared.value, lists.flatten()
        coded = flat.dictionary_encode()
        missing = pa.array([v not in known for v in coded.dictionary.to_pylist()], pa.bool_())
        open_ = pc.fill_null(pc.take(missing, coded.indices), False).to_numpy(zero_copy_only=False)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum([0, *lengths])
        offsets = np.concatenate(([0], np.cumsum(open_)))[ends]
        return pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), flat.filter(pa.array(open_)))

    return df.select(*names, F.explode(F.array_distinct(rare(F.col(column)))).alias("_from"))


def _join_lookup(
    df: DataFrame, column: str, table: DataFrame, source: str, target: str, keys: list[str], unknown,
    max_rows: int, max_bytes: int,
) -> DataFrame:
    """The same for a table too large to copy: its commonest entries are copied, and only values
    that are not among them are joined.

    Rows ask once for each such value. Answers are gathered per distinct pair of keys and array,
    so that rows with equal or NULL keys get their own.
    """
    kind, value = _KINDS[target]
    table, common = _common(table, F.col(column), df, source, max_rows, max_bytes)
    shared = _copied(df.sparkSession, table.filter(common), source, target)

    @F.arrow_udf(f"array<{kind}>")
    def mapped(lists: pa.Array, answers: pa.Array) -> pa.Array:
        known, found = shared.value, answers.flatten()
        joined = dict(zip(found.field("_from").to_pylist(), found.field("_to").to_pylist()))

        def find(v, missing):
            return known[v] if v in known else joined.get(v, missing)

        return _changed(lists, find, value, unknown)

    names = [*keys, "_hash"]
    hashed = df.withColumn("_hash", F.xxhash64(column))
    wanted = table.filter(~common).select(F.col(source).alias("_from"), F.col(target).cast(kind).alias("_to"))
    answers = (
        _asked(hashed, column, names, shared)
        .join(wanted, "_from")
        .groupBy(*names)
        .agg(F.collect_set(F.struct("_from", "_to")).alias("_answers"))
        .select(*[F.col(name).alias(f"_key{k}") for k, name in enumerate(names)], "_answers")
    )
    same = F.lit(True)
    for k, name in enumerate(names):
        same &= F.col(name).eqNullSafe(F.col(f"_key{k}"))
    return (
        hashed.join(answers, same, "left")
        .withColumn(column, mapped(F.col(column), F.col("_answers")))
        .select(*df.columns)
    )


def _through(df, column, table, source, target, keys, unknown, max_rows, max_bytes) -> DataFrame:
    if fits_broadcast(table.select("token", "id"), max_rows, max_bytes):
        mapped = _broadcast_lookup(df.sparkSession, table, source, target, unknown)
        return df.withColumn(column, mapped(F.col(column)))
    return _join_lookup(df, column, table, source, target, keys, unknown, max_rows, max_bytes)


def encode(
    df: DataFrame,
    column: str,
    vocab: DataFrame,
    keys: list[str],
    unknown: int | None = None,
    max_rows: int = MAX_ROWS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Replace an array of tokens by their ids; ``keys`` identify a row.

    A vocabulary within the limits is copied to the workers and looked up in place. Of a
    larger one the commonest tokens are, by its column ``n`` or else by a count over ``df``,
    and the others are joined.
    """
    return _through(df, column, vocab, "token", "id", keys, unknown, max_rows, max_bytes)


def decode(
    df: DataFrame,
    column: str,
    vocab: DataFrame,
    keys: list[str],
    max_rows: int = MAX_ROWS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Replace an array of ids by their tokens."""
    return _through(df, column, vocab, "id", "token", keys, None, max_rows, max_bytes)
