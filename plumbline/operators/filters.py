"""Predicates and row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scale import attach_group, lookup, lowest, written

# Source names with a meaning of their own.
MATH_SOURCES = [
    "dapo_math",
    "math_dapo",
    "aime",
    "aime_2024",
    "aime_2025",
    "beyondaime",
    "gsm8k",
    "gsm8k_train",
    "gsm8k_test",
]
QA_NAMES = ["popqa", "nq", "hotpotqa", "musique", "2wikimultihopqa", "triviaqa", "bamboogle"]
QA_SOURCES = [
    "simpleqa",
    "simpleqa_gtgrpo",
    "hotpot_qa",
    "nq_hotpotqa_searchr1",
    "popqa",
    "nq",
    "hotpotqa",
    "musique",
    "2wikimultihopqa",
    "triviaqa",
    "bamboogle",
    "flashrag_popqa",
    "flashrag_nq",
    "flashrag_hotpotqa",
    "flashrag_musique",
    "flashrag_2wikimultihopqa",
    "flashrag_triviaqa",
    "flashrag_bamboogle",
]


def norm_source(c: Column) -> Column:
    return F.when(c == "dapo_math", F.lit("math_dapo")).otherwise(c)


def is_searchr1(c: Column) -> Column:
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit("searchr1"))


def is_openqa(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike("^(" + "|".join(QA_NAMES) + ")")


def is_qa(c: Column) -> Column:
    return is_searchr1(c) | is_openqa(c)


def is_maths(c: Column) -> Column:
    return (norm_source(c) == "math_dapo") | c.startswith("aime")


def drop_math_sources(df: DataFrame, extra: list[str] | None = None, source: str = "data_source") -> DataFrame:
    """Drop rows of mathematics sources; a blank source is kept."""
    name = F.lower(F.trim(F.coalesce(F.col(source), F.lit(""))))
    known = [*MATH_SOURCES, *[e.lower() for e in extra or []]]
    return df.where(~(name.isin(known) | name.startswith("aime") | name.startswith("gsm8k")))


def is_qa_row(source: Column, prompt: Column) -> Column:
    """Known QA source, or a prompt that asks a question."""
    text = F.lower(F.coalesce(prompt, F.lit("")))
    return (
        F.lower(F.coalesce(source, F.lit(""))).isin(QA_SOURCES)
        | F.contains(text, F.lit("question:"))
        | F.contains(text, F.lit("question："))
        | F.rtrim(text).endswith("?")
    )


def drop_overlong(df: DataFrame, limit: int, length: str) -> DataFrame:
    """Rows up to a prompt length; a row without a length counts as too long."""
    return df.where(F.coalesce(F.col(length), F.lit(limit + 1)) <= limit)


def drop_unlabeled(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.length(label) > 0)


def filter_date_range(df: DataFrame, col: str, lo: str, hi: str) -> DataFrame:
    """Half-open range on an ISO date kept as text; pushed down to the scan."""
    return df.where((F.col(col) >= lo) & (F.col(col) < hi))


def stride_shard(df: DataFrame, offset: int, stride: int, row: str = "row", head: int | None = None) -> DataFrame:
    """Rows ``offset, offset + stride, …``; optionally only the first ``head``."""
    kept = df.where((F.col(row) >= offset) & ((F.col(row) - offset) % stride == 0))
    return kept if head is None else kept.where((F.col(row) - offset) / stride < head)


def select_rows(df: DataFrame, ids: DataFrame, row: str = "row") -> DataFrame:
    """Rows of an index list, in list order (``ordinal``), repeats kept."""
    found = lookup(ids.select("ordinal", row), df.withColumn("__found", F.lit(True)), [row])
    return found.where("__found").drop("__found")


def slice_rows(df: DataFrame, start: int, end: int, step: int = 1, row: str = "row") -> DataFrame:
    inside = (F.col(row) >= start) & (F.col(row) < end)
    return df.where(inside & ((F.col(row) - start) % step == 0))


def filter_groups(df: DataFrame, metric: str, uid: str = "uid") -> DataFrame:
    """Rows of prompts whose metric varies, or that have a single sample."""
    return keep_prompts(df, varied_groups(df, metric, uid), uid)


def varied_groups(df: DataFrame, metric: str, uid: str = "uid") -> DataFrame:
    stats = df.groupBy(uid).agg(
        F.min(metric).alias("lo"), F.max(metric).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    return stats.where((F.col("lo") < F.col("hi")) | (F.col("n") == 1)).select(uid)


def keep_prompts(df: DataFrame, kept: DataFrame, uid: str = "uid") -> DataFrame:
    """Rows of kept prompts.

    The kept list is marked on each row's group through the salted join, so a
    hot prompt's rows do not meet in one task.
    """
    flags = kept.select(uid).distinct().withColumn("__keep", F.lit(True))
    return lookup(df, flags, [uid]).where(F.coalesce("__keep", F.lit(False))).drop("__keep")


def align_batch(df: DataFrame, prompts: int, max_rounds: int, uid: str = "uid", round_col: str = "round") -> DataFrame:
    """The first ``prompts`` kept prompts in order of arrival.

    Arrival is ``(round, uid)``. Needing more than ``max_rounds`` rounds is an
    error. Only one row per prompt is looked at for that.
    """
    arrival = df.groupBy(uid).agg(F.min(round_col).alias("__r"))
    first = lowest(written(arrival, "arrivals"), prompts, ["__r", uid])
    used = first.agg(F.max("__r").alias("r"), F.count(F.lit(1)).alias("n"))
    state = used.select(F.when((F.col("n") < prompts) | (F.col("r") >= max_rounds), 1).otherwise(0).alias("bad"))
    message = F.raise_error(F.lit(f"no full batch of {prompts} prompts in {max_rounds} rounds")).cast("boolean")
    return keep_prompts(df, first, uid).where(F.when(state.scalar() == 1, message).otherwise(F.lit(True)))


def prioritized_downsample(
    df: DataFrame,
    lo: float,
    hi: float,
    max_length: int,
    factor: float,
    group_order: str = "uid",
    score: str = "acc",
    length: str = "response_length",
) -> DataFrame:
    """Keep 1/factor of the rows, groups that pass the filters first.

    A group passes with mean accuracy in [lo, hi] and longest response below
    ``max_length − 1``. Order within passing and failing groups is by group, and
    by response within a group.
    """
    groups = df.groupBy(group_order).agg(
        F.avg(score).alias("__acc"), F.max(length).alias("__len"), F.count(F.lit(1)).alias("__n")
    )
    passed = F.col("__acc").between(lo, hi) & (F.col("__len") < max_length - 1)
    flagged = groups.select(group_order, "__n", F.coalesce(passed, F.lit(False)).alias("passes"))
    marked = attach_group(df, flagged, [group_order], "__n", ["seq_id"]).drop("__n")
    marked = written(marked.withColumn("__fails", (~F.col("passes")).cast("int")), "marked")
    return lowest(marked, int(marked.count() // factor), ["__fails", group_order, "seq_id"]).drop("__fails")


def resume_skip(todo: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    """Rows whose key has not been handled before."""
    return todo.join(done.select(key), key, "left_anti")
