"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, licenses, line_dedup, ngram_join, oracle, packing, quality, sharding, substring_dedup, token_counts
from tidemark.llm.runtime import Durable


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file; TIDEMARK_TOKENIZERS may name another folder of them."""
    folder = os.environ.get("TIDEMARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(documents(spark, sf_dir), 8, Durable(spark, "slot-map").root)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op2_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op5_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op9_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(documents(spark, sf_dir)).drop("who")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_virtual_slots, op2_quality_bands, op3_ngram_join, op4_token_counts, op5_licence_sentences, op6_line_templates, op7_bpe_round_trip, op8_length_buckets, op9_hilbert_neighbours, op10_paragraph_minhash)}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": oracle.NGRAM_JOIN, "op6_line_templates": oracle.LINE_TEMPLATES, "op9_hilbert_neighbours": oracle.NEIGHBOURS}
