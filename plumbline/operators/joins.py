"""Key lookups: contexts, labels, grades, knowledge flags."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import CLAIM_BLOCK, claim_values, fit_labels
from plumbline.operators.scale import lookup, written_in_turn


def union_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of b added row by row; a shared column must be equal."""
    shared = [c for c in b.columns if c in a.columns and c != key]
    extra = [c for c in b.columns if c not in a.columns]
    right = b.select(key, *extra, *[F.col(c).alias(f"__b_{c}") for c in shared])
    joined = a.join(right, key)
    clash = F.lit(False)
    for c in shared:
        clash = clash | ~F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    message = F.raise_error(F.concat(F.lit(f"columns {shared} differ at key "), F.col(key).cast("string")))
    checked = joined.where(F.when(clash, message.cast("boolean")).otherwise(F.lit(True)))
    return checked.drop(*[f"__b_{c}" for c in shared])


def format_reference(rank: Column, contents: Column) -> Column:
    """``Doc i(Title: first line) rest`` for one passage."""
    title = F.substring_index(contents, "\n", 1)
    body = F.when(contents.contains("\n"), F.substring(contents, F.length(title) + 2, F.length(contents))).otherwise(F.lit(""))
    return F.concat(F.lit("Doc "), rank.cast("string"), F.lit("(Title: "), title, F.lit(") "), body, F.lit("\n"))


#: Bytes of passages that meet at once: so many times the corpus, and no less than this.
PASSAGE_SHARE, PASSAGE_FLOOR = 3, 1 << 28


def passage_blocks(ranked: DataFrame, corpus: DataFrame, topk: int, share: float = PASSAGE_SHARE, floor: int = PASSAGE_FLOOR) -> int:
    """How many blocks of questions keep the passages of a block within ``share`` times the corpus."""
    times = ranked.where(F.col("rank") <= topk).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = corpus.select("doc_id", F.octet_length("contents").cast("bigint").alias("bytes")).join(times, "doc_id", "left")
    found = sizes.agg(F.sum(F.col("bytes") * F.col("n")).alias("met"), F.sum("bytes").alias("held")).first()
    return max(1, math.ceil((found.met or 0) / max(floor, share * (found.held or 0), 1)))


def by_blocks(questions: DataFrame, ranked: DataFrame, blocks: int, answer: Callable, name: str, key: str = "question_id") -> DataFrame:
    """``answer(questions, ranked)`` of each block of questions by hash of the id, as one table."""

    def block(df: DataFrame, i: int) -> DataFrame:
        return df.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i)

    return written_in_turn((answer(block(questions, i), block(ranked, i)) for i in range(blocks)), questions.sparkSession, name)


def attach_context(questions: DataFrame, ranked: DataFrame, corpus: DataFrame, topk: int = 3) -> DataFrame:
    """Context text of each question from its ranked document ids.

    ``ranked`` is ``(question_id, rank, doc_id)`` with ranks from 1; at most
    ``topk`` passages meet in one row.
    """
    top = ranked.where(F.col("rank") <= topk)
    found = lookup(top, corpus.select("doc_id", "contents"), ["doc_id"]).where(F.col("contents").isNotNull())
    passages = found.select(
        "question_id", "rank", format_reference(F.col("rank"), F.col("contents")).alias("passage")
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", "passage")))
    # Passages are gathered where their question lies; lists begun before would only be sorted and spilled.
    context = passages.repartition("question_id").groupBy("question_id").agg(F.array_join(ordered["passage"], "").alias("context"))
    return questions.join(context, "question_id", "left").withColumn("context", F.coalesce("context", F.lit("")))


NO_RESULTS = "No search results found."


def format_passages(questions: DataFrame, hits: DataFrame, key: str = "question_id", topk: int = 100) -> DataFrame:
    """``Doc i (Title: t)\\ntext`` blocks per question, in rank order; at most ``topk`` meet in one row."""
    hits = hits.where(F.col("rank") <= topk)
    title = F.substring_index("contents", "\n", 1)
    body = F.when(
        F.contains(F.col("contents"), F.lit("\n")), F.substring("contents", F.length(title) + 2, F.length("contents"))
    ).otherwise(F.lit(""))
    block = F.concat(F.lit("Doc "), F.col("rank").cast("string"), F.lit(" (Title: "), title, F.lit(")\n"), body, F.lit("\n\n"))
    blocks = hits.select(key, "rank", block.alias("p")).repartition(key)
    listed = blocks.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("rank", "p")))["p"], "").alias("text")
    )
    text = F.coalesce(F.rtrim(F.regexp_replace("text", r"\s+$", "")), F.lit(NO_RESULTS))
    return questions.join(listed, key, "left").withColumn("text", text)


def join_query_texts(texts: DataFrame, key: str = "question_id", by: str = "request_id") -> DataFrame:
    """Texts of one request's queries, separated by rules."""
    ordered = F.array_sort(F.collect_list(F.struct(key, "text")))
    return texts.groupBy(by).agg(F.array_join(ordered["text"], "\n---\n").alias("text"))


def flag_members(df: DataFrame, ids: DataFrame, key: str, out: str) -> DataFrame:
    """Whether a key is in a list."""
    flags = ids.select(key).distinct().withColumn(out, F.lit(True))
    return lookup(df, flags, [key]).withColumn(out, F.coalesce(out, F.lit(False)))


def join_claim_labels(preds: DataFrame, labels: DataFrame, response: str = "full_response") -> DataFrame:
    """One row per claim with its confidence and 0/1 label.

    Labels are padded with 0 or cut to the number of claims; a response without
    labels gets zeros.
    """
    claims = preds.select("index", claim_values(F.col(response)).alias("confidences"))
    joined = claims.join(labels, "index", "left")
    given = F.coalesce("claim_labels", F.array().cast("array<int>"))
    fitted = fit_labels(given, F.size("confidences"))
    zipped = F.arrays_zip(F.col("confidences"), fitted.alias("labels"))
    return joined.select("index", F.posexplode(zipped).alias("claim_idx", "z")).select(
        "index",
        "claim_idx",
        F.col("z.confidences").alias("claim_confidence"),
        F.col("z.labels").alias("claim_label"),
    )


def explode_claims(df: DataFrame, key: str, response: str) -> DataFrame:
    """Response to one row per claim: index, confidence, text."""
    texts = F.regexp_extract_all(F.col(response), F.lit(CLAIM_BLOCK), F.lit(1))
    zipped = F.arrays_zip(claim_values(F.col(response)).alias("c"), texts.alias("t"))
    return df.select(key, F.posexplode(zipped).alias("claim_idx", "z")).select(
        key, "claim_idx", F.col("z.c").alias("claim_confidence"), F.col("z.t").alias("claim_text")
    )


def _json_text(c: Column) -> Column:
    """A JSON string literal as Python writes it, non-ASCII kept."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escaped in [("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def grade_key(question: Column, reference: Column, answer: Column) -> Column:
    """SHA-1 of ``{"a": …, "q": …, "r": …}`` with sorted keys."""
    payload = F.concat(
        F.lit('{"a": '), _json_text(answer), F.lit(', "q": '), _json_text(question), F.lit(', "r": '), _json_text(reference), F.lit("}")
    )
    return F.sha1(F.encode(payload, "UTF-8"))


def last_labels(cache: DataFrame, order: str) -> DataFrame:
    """Last written label per key; rows lacking key or label are dropped."""
    usable = cache.where((F.length("key") > 0) & (F.length("label") > 0))
    return usable.groupBy("key").agg(F.max_by("label", order).alias("label"))


def lookup_grades(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """Cached label of each graded response; NULL means it must be graded."""
    keyed = preds.withColumn("key", grade_key(F.col("question"), F.col("reference"), F.col("model_answer")))
    return lookup(keyed, labels.select("key", F.col("label").alias("grading_label")), ["key"])
