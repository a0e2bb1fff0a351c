"""Dataset scans, JSON-lines sinks and row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed value: the split that is read unless another is named.
SPLIT = "train"
#: How JSON lines are written, in batches and streams alike.
JSONL = {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}


def read_dataset(
    spark: SparkSession, path: str, split: str | None = None, schema: StructType | str | None = None
) -> DataFrame:
    """A dataset as a DataFrame: JSON lines if a schema is given, else parquet.

    A dataset partitioned by ``split`` is pruned to one of them (``train`` by default).
    """
    if schema is None:
        df = spark.read.parquet(path)
    else:
        df = spark.read.schema(schema).json(path)
    if split is None and "split" not in df.columns:
        return df
    return df.filter(F.col("split") == (split or SPLIT)).drop("split")


def write_jsonl(df: DataFrame, path: str, split: str | None = None) -> int:
    """Overwrite ``path`` with one ASCII-only JSON object per line; returns the row count.

    NULL fields are written out. The count is observed while writing, without a second
    scan. ``split`` names a column to lay the files out by.
    """
    counted = Observation()
    writer = (
        df.observe(counted, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .options(**JSONL)
    )
    if split:
        writer = writer.partitionBy(split)
    writer.json(path)
    return counted.get["rows"]


def read_jsonl(
    spark: SparkSession, path: str, schema: StructType | str, keys: dict[str, str] | None = None
) -> DataFrame:
    """JSON lines by a declared schema; ``keys`` maps output columns to record keys."""
    df = spark.read.schema(schema).json(path)
    if not keys:
        return df
    return df.select(*[F.col(source).alias(name) for name, source in keys.items()])


def read_untyped(spark: SparkSession, path: str, name: str = "record") -> DataFrame:
    """JSON lines as they are: each record one VARIANT, whatever its fields and their types."""
    return spark.read.option("singleVariantColumn", name).json(path)


def untyped_messages(record: Column, key: str = "messages") -> Column:
    """The message list of a VARIANT record, contents untyped: NULL where the record has none or
    something else in its place. A message without a role, or with one that is no text, has none."""
    items = F.try_variant_get(record, f"$.{key}", "array<variant>")

    def message(item: Column) -> Column:
        role = F.try_variant_get(item, "$.role", "variant")
        text = F.schema_of_variant(role).eqNullSafe("STRING")
        return F.struct(
            F.when(text, F.try_variant_get(role, "$", "string")).alias("role"),
            F.try_variant_get(item, "$.content", "variant").alias("content"),
        )

    return F.transform(items, message)


def write_untyped(df: DataFrame, path: str, record: str = "record") -> None:
    """VARIANT records as JSON lines again."""
    df.select(F.to_json(record).alias("value")).write.mode("overwrite").text(path)
