"""The operators bound to the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.bagminhash import near_texts
from turnloom.llm.blocks import extract_text
from turnloom.llm.bpe import round_trip
from turnloom.llm.decontam import contaminated
from turnloom.llm.infill import infill_digests
from turnloom.llm.langid import language_ids
from turnloom.llm.licenses import scan_licenses
from turnloom.llm.merkle import merkle_digests
from turnloom.llm.mixing import mix_digests
from turnloom.llm.pivots import near_vectors
from turnloom.llm.secrets import find_secrets
from turnloom.llm.sharding import shard
from turnloom.llm.token_counts import count_tokens

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pivot_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))


def line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(table(spark, sf, "pages"))


def transducer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"), public_tokenizers.path(PIECES))


def hyperdimensional_languages(spark: SparkSession, sf: str) -> DataFrame:
    return language_ids(table(spark, sf, "documents"))


def positional_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents"))


def bag_min_hash(spark: SparkSession, sf: str) -> DataFrame:
    return near_texts(table(spark, sf, "documents")).drop("text_key")


def streaming_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return round_trip(table(spark, sf, "documents"), public_tokenizers.path(WORDS))


def histogram_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shard(table(spark, sf, "documents"))


def keyword_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return find_secrets(table(spark, sf, "documents"))


def template_windows(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def sorted_infill(spark: SparkSession, sf: str) -> DataFrame:
    return infill_digests(table(spark, sf, "documents"))


def hash_threshold_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_digests(table(spark, sf, "documents"))


def merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle_digests(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivot_neighbors": pivot_neighbors,
    "op2_line_blocks": line_blocks,
    "op3_transducer_counts": transducer_counts,
    "op4_hyperdimensional_languages": hyperdimensional_languages,
    "op5_positional_licenses": positional_licenses,
    "op6_bag_min_hash": bag_min_hash,
    "op7_streaming_bpe": streaming_bpe,
    "op8_histogram_shards": histogram_shards,
    "op9_keyword_secrets": keyword_secrets,
    "op10_template_windows": template_windows,
    "op11_sorted_infill": sorted_infill,
    "op12_hash_threshold_mix": hash_threshold_mix,
    "op13_merkle_manifest": merkle_manifest,
}
