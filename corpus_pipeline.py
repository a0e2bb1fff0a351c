"""From raw documents to token ids: language, near-duplicates, benchmarks, secrets, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.bagminhash import near_texts, text_key
from turnloom.llm.bpe import encode_decode
from turnloom.llm.components import possibly, written
from turnloom.llm.decontam import contaminated
from turnloom.llm.langid import UNKNOWN, held_out, identify, train
from turnloom.llm.secrets import redact_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter (or text) go. Documents that
    came without a language get the one that their text has."""
    docs = docs.select(*COLUMNS)
    profiles = train(docs.filter(~held_out("doc_id")))
    found = identify(docs, profiles, COLUMNS, "text").filter(F.col("lang_pred") != UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of the least id. If several rows
    have this id (or none has one) and the same text, one of them stays."""
    docs = docs.select(*COLUMNS)
    counted = (
        near_texts(docs)
        .filter(F.col("text_key").isNotNull())
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    )
    marked = written(counted.filter("NOT kept OR n > 1"), "near-marked")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & text_key("text").eqNullSafe(F.col("_key"))
    suspect = possibly(marked, "_id", "_key")(F.col("doc_id"), text_key("text"))
    suspects = docs.filter(suspect)
    single = docs.filter(~suspect).union(suspects.join(marked.select("_id", "_key"), same, "left_anti"))
    heads = marked.filter("kept").select("_id", "_key")
    if heads.isEmpty():
        return single
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    repeated = (
        suspects.join(heads, same, "left_semi")
        .groupBy("doc_id", text_key("text").alias("_key"))
        .agg(F.first("text").alias("text"), F.min(F.struct(*others)).alias("rest"))
    )
    return single.union(repeated.select("doc_id", "text", *[F.col(f"rest.{c}").alias(c) for c in others]).select(*COLUMNS))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    docs = docs.select(*COLUMNS)
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    held = found.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    clean = redact_secrets(docs.select(*COLUMNS), ["doc_id", "lang", "source"])
    return clean.select(
        "doc_id",
        F.col("redacted").alias("text"),
        "lang",
        "source",
        F.char_length("redacted").cast("long").alias("n_chars"),
    )


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, and the digest of what these decode to."""
    coded = encode_decode(docs, public_tokenizers.path(TOKENIZER), (*COLUMNS,))
    return coded.select(
        *COLUMNS, F.col("ids").alias("input_ids"), F.size("ids").cast("long").alias("n_tokens"), "decoded_sha256"
    )


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmarks),
    ("secret scans", secrets),
    ("BPE encoding and decoding", encoding),
]

# Language profiles, signatures and merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
