"""From raw documents to token ids: five stages, each on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, exact, minhash, mixing, quality
from plumbline.llm.common import batches_of, stored, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts; it learns from ``labels`` of ``sf_dir``."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("__row")
    kept = quality.score(docs.select("text", others), model).where("predicted = 1")
    kept = kept.select(*[F.col("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
    with batches_of(spark, 512):
        return stored(kept, "accepted")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every normalised text."""
    return exact.dedup(docs, exact.DigestIndex(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group; a row without id links with nothing and stays."""
    gone = minhash.groups(docs).where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn, those of scarce cells repeated, so that source, language and topic have their target shares of tokens."""
    return mixing.repeated(mixing.sample(docs.withColumn("__row", F.struct(*docs.columns)))).select("__row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a check that they decode to its text."""
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.round_trip(docs, vocabulary)
    with batches_of(spark, 512):
        return stored(coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")), "tokens")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("byte-level BPE", encode),
]

#: Boosted trees, sketches and merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
