"""Picking one answer out of k samples per question.

All votes are aggregates (``max_by`` over counts), so a question with very many
samples is combined map-side instead of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scale import union_all


def first_k(samples: DataFrame, k_values: list[int]) -> DataFrame:
    """Prefix of the first k samples for every k: adds column ``k``."""
    ks = F.array(*[F.lit(k).cast("bigint") for k in sorted(k_values)])
    return samples.withColumn("k", F.explode(F.filter(ks, lambda k: F.col("sample_idx") < k)))


def _groups(samples: DataFrame) -> list[str]:
    return ["question_id", "k"] if "k" in samples.columns else ["question_id"]


def _answered(samples: DataFrame) -> DataFrame:
    return samples.where(F.col("answer").isNotNull() & (F.col("answer") != ""))


def _vote(samples: DataFrame, weight, strategy: str) -> DataFrame:
    """Heaviest non-empty answer, first seen on ties; score over all samples."""
    keys = _groups(samples)
    tally = (
        _answered(samples)
        .groupBy(*keys, "answer")
        .agg(
            weight.alias("w"),
            F.min("sample_idx").alias("first"),
            F.min_by("is_correct", "sample_idx").alias("is_correct"),
        )
    )
    best = F.struct(F.col("w"), -F.col("first"))
    winner = tally.groupBy(*keys).agg(F.max_by(F.struct("answer", "w", "is_correct"), best).alias("best"))
    sizes = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(winner, keys, "left").select(
        *keys,
        F.lit(strategy).alias("strategy"),
        F.coalesce("best.answer", F.lit("")).alias("answer"),
        F.coalesce(F.col("best.w") / F.col("n"), F.lit(0.0)).alias("score"),
        F.coalesce("best.is_correct", F.lit(0)).alias("is_correct"),
    )


def vote_majority(samples: DataFrame) -> DataFrame:
    return _vote(samples, F.count(F.lit(1)).cast("double"), "majority")


def vote_weighted(samples: DataFrame, places: int = 9) -> DataFrame:
    """Summed confidence, rounded so that ties do not hang on summing order."""
    return _vote(samples, F.round(F.sum("confidence"), places), "weighted")


def vote_max_confidence(samples: DataFrame) -> DataFrame:
    """Most confident answer, first on ties; its correctness comes from the
    first sample that gave the same answer."""
    keys = _groups(samples)
    order = F.struct(F.col("confidence"), -F.col("sample_idx"))
    per_answer = samples.groupBy(*keys, "answer").agg(
        F.max(order).alias("o"), F.min_by("is_correct", "sample_idx").alias("is_correct")
    )
    picked = per_answer.groupBy(*keys).agg(F.max_by(F.struct("answer", "o", "is_correct"), "o").alias("best"))
    return picked.select(
        *keys,
        F.lit("max_confidence").alias("strategy"),
        F.col("best.answer").alias("answer"),
        F.col("best.o.confidence").alias("score"),
        F.coalesce("best.is_correct", F.lit(0)).alias("is_correct"),
    )


def mean_best_at_k(samples: DataFrame) -> DataFrame:
    """Mean correctness and "any correct" per question (and k)."""
    keys = _groups(samples)
    return samples.groupBy(*keys).agg(
        F.avg(F.col("is_correct").cast("double")).alias("mean_at_k"),
        F.max(F.col("is_correct").cast("double")).alias("best_at_k"),
    )


def scaling_summary(samples: DataFrame, k_values: list[int]) -> DataFrame:
    """Accuracy and mean score per strategy and k over all questions."""
    prefixed = first_k(samples, k_values)
    votes = union_all([vote_max_confidence(prefixed), vote_weighted(prefixed), vote_majority(prefixed)])
    voted = votes.groupBy("k", "strategy").agg(
        F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.avg("score").alias("mean_score")
    )
    plain = mean_best_at_k(prefixed).unpivot(["question_id", "k"], ["mean_at_k", "best_at_k"], "strategy", "v")
    at_k = plain.groupBy("k", "strategy").agg(F.avg("v").alias("accuracy"), F.avg("v").alias("mean_score"))
    return voted.unionByName(at_k)


def majority_value(df: DataFrame, keys: list[str], vote: str, value: str, order: str) -> DataFrame:
    """Most frequent vote per group (first seen on ties) and its first value."""
    tally = df.groupBy(*keys, vote).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("value")
    )
    best = F.struct(F.col("n"), -F.col("first"))
    return (
        tally.groupBy(*keys)
        .agg(F.max_by(F.struct(F.col(vote).alias("vote"), "value", "n"), best).alias("best"))
        .select(*keys, F.col("best.vote").alias("vote"), F.col("best.value").alias("value"), F.col("best.n").alias("n"))
    )
