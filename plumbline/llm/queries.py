"""Registered queries of the corpus operators and their equivalents in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, codes, exact, html_text, licences, minhash, mixing, packed, phrases, quality, search, suffixes, vectors
from plumbline.llm.common import batches_of, stored, table
from plumbline.operators.scale import attach_group
from plumbline.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_main_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op2_packed_ids")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "packed")
    packed.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    read = packed.read(spark, path)
    with batches_of(spark, 16):
        return stored(read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "op2")


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op4_vectors")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.groups(table(spark, sf_dir, "embeddings"))


@query("op5_byte_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    digests = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    with batches_of(spark, 1024):
        return stored(coded.select("doc_id", "n_tokens", *digests), "op5")


@query("op6_minhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


@query(
    "op10_exact",
    r"""
    WITH t AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = exact.decide(table(spark, sf_dir, "documents"), exact.DigestIndex(spark))
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_licences", licences.oracle_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    best = F.get("licences", F.lit(0))
    return found.select(
        "doc_id",
        best["licence"].alias("licence"),
        F.coalesce(best["score"], F.lit(0.0)).alias("score"),
        F.size("licences").cast("long").alias("n_segments"),
    )


@query("op8_phrases")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = phrases.remove_repeats(table(spark, sf_dir, "documents"))
    with batches_of(spark, 1024):
        return stored(cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")), "op8")


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.sample(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "copies", "kept")


@query("op11_search")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "postings")
    search.build(table(spark, sf_dir, "documents"), path)
    return search.search(spark, path, table(spark, sf_dir, "benchmark"))


@query("op12_codes")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__size"))
    rows = attach_group(coded, sums, ["label"], "__size", ["vec_id"])
    code = F.lower(F.hex("code")).alias("code")
    return rows.select("vec_id", code, "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


@query("op13_suffixes")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    with batches_of(spark, 1024):
        return stored(cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "op13")
