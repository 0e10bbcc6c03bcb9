"""The queries of this subpackage: ``opN_<name>`` applies operator N to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import alignment, bpe, divergence, embedding_dedup, licenses, media, mixing, neardup, oracle, pii, quality, substrings, toxicity
from tilewright.plans.storage import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("offending")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("passes")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"))


def media_digests(docs: DataFrame) -> DataFrame:
    stored = media.store(docs)
    read = media.features(stored, ("doc_id", "n_bytes"))
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.length("tile").cast("long").alias("tile_bytes"),
    )


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def pii_digests(docs: DataFrame) -> DataFrame:
    found = pii.find(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = pii.joined({k: F.col(k) for k in pii.KINDS})
    every = {k: F.col(f"{k}_all") for k in pii.ALL_KINDS}
    n_spans = sum((F.size(c) for c in every.values()), F.lit(0)).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.joined(every).alias("spans"), n_spans)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(table(spark, sf_dir, "documents"))


def byte_bpe_digests(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.decode(bpe.encode(docs, path), path)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_digests(table(spark, sf_dir, "documents"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.components(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bpe.count(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.scan(table(spark, sf_dir, "documents")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.weigh(alignment.align(table(spark, sf_dir, "documents"), *paths))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_neardup, op4_media, op5_pii, op6_byte_bpe, op7_substrings, op8_embedding_dedup, op9_token_counts, op10_quality, op11_divergence, op12_licenses, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
