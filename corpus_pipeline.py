"""From raw documents to token ids: the stages, in order, and the run of all of them.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept and returns a DataFrame; all but
the last return the columns of ``documents``. ``run`` writes each stage's result to shared storage and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import bpe, mixing, neardup, pii, quality
from tilewright.plans.storage import discard, materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts: score 0.5 or more.

    Null and empty texts all get the score of a text without features, so they stay or go together; a score of exactly
    0.5 stays; repeated rows stay as often as they are there; very long texts are scored whole; other columns, whatever
    their names, are carried along; no documents or no usable labels: no error, nothing is scored below 0.5 then."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Null, empty and wordless texts are near nothing and all stay, but rows that agree in doc_id and text are one
    document and stay once; different texts with one id are told apart; of a group with null ids only, one text stays; other columns are those of the row that
    stays; very long texts are compared whole; no documents: none."""
    return neardup.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced by their kind and n_chars counted anew where text changed.

    Null, empty and clean texts stay as they are; spans that overlap are replaced together under the kind of the one
    that starts first, the longer one on ties; repeated rows stay and get equal texts; very long texts are searched
    whole; other columns, whatever their names, stay; no documents: none."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, each pass at its place in the order of training.

    Null and wordless texts take no words and stay once each; a null source is a source of its own; repeated rows are
    documents of their own; documents stay whole, so a very long one may overshoot its source's target by half its size;
    ties in the order go by id; other columns, whatever their names, stay; no documents: none."""
    return mixing.apply_mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 32-bit), and digests of the ids and of what they decode to.

    A row for each row, repeated ones included; null and empty texts have no ids; null ids and sources stay; very long
    texts are encoded whole; other columns are dropped; no documents: no rows."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.decode(bpe.encode(docs, path, ("doc_id", "source")), path)
    return coded.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: Classifiers, components and merges cannot be stated in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written = None
    for _, stage in STAGES:
        new = materialize(stage(spark, docs, sf_dir))
        if written is not None:
            discard(written)
        docs = written = new
    return docs
