"""Metrics of a training step: batches, timing, throughput, lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _three(name: str, c: Column) -> list[Column]:
    return [F.avg(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min")]


def _joined(*frames: DataFrame) -> DataFrame:
    """Side by side: every frame is the single row of an ungrouped aggregate."""
    one = F.lit(1).alias("__one")
    out = frames[0].select("*", one)
    for frame in frames[1:]:
        out = out.join(frame.select("*", one), "__one")
    return out.drop("__one")


def data_metrics(
    rollouts: DataFrame, tokens: DataFrame, max_response: int, max_prompt: int, use_critic: bool = True
) -> DataFrame:
    """Scores, rewards, advantages, returns, values and lengths of a batch.

    Score and reward statistics leave out aborted responses (length 0); a batch
    with nothing else is an error. Two aggregates, one per table.
    """
    length, prompt = F.col("response_length"), F.col("prompt_length")
    live = length > 0
    nothing = F.raise_error(F.lit("all samples are aborted")).cast("double")
    over_rollouts = rollouts.agg(
        *_three("score", F.when(live, F.col("score"))),
        *_three("reward", F.when(live, F.col("reward"))),
        *_three("response_length", length),
        F.avg((length == max_response).cast("double")).alias("response_length_clip_ratio"),
        *_three("response_length_non_aborted", F.when(live, length)),
        F.avg(F.when(live, (length == max_response).cast("double"))).alias("response_length_non_aborted_clip_ratio"),
        F.when(F.count_if(live) == 0, nothing).otherwise(F.avg((~live).cast("double"))).alias("aborted_ratio"),
        *_three("prompt_length", prompt),
        F.avg((prompt == max_prompt).cast("double")).alias("prompt_length_clip_ratio"),
    )
    aggs = [*_three("advantage", F.col("advantage")), *_three("return", F.col("return"))]
    if use_critic:
        gap = F.var_samp(F.col("return") - F.col("value"))
        explained = 1 - gap / (F.var_samp("return") + 1e-5)
        aggs += [*_three("value", F.col("value")), explained.alias("vf_explained_var")]
    return _joined(over_rollouts, tokens.where(F.col("mask") > 0).agg(*aggs))


# Stages whose time is spread over all tokens, not responses only.
ALL_TOKEN_STAGES = ["ref", "values", "adv", "update_critic", "update_actor"]


def timing_metrics(stages: DataFrame, rollouts: DataFrame) -> DataFrame:
    """Seconds per stage and milliseconds per token.

    Generation divides by response tokens, the named stages by all tokens.
    """
    totals = rollouts.agg(
        F.struct(
            F.sum("response_length").alias("response"),
            F.sum(F.col("prompt_length") + F.col("response_length")).alias("all"),
        ).alias("t")
    ).scalar()
    tokens = F.when(F.col("stage") == "gen", totals["response"]).when(
        F.col("stage").isin(ALL_TOKEN_STAGES), totals["all"]
    )
    return stages.withColumn("per_token_ms", F.try_divide(F.col("seconds") * 1000.0, tokens))


def throughput(rollouts: DataFrame, step_seconds: float, devices: int) -> DataFrame:
    total = F.sum(F.col("prompt_length") + F.col("response_length"))
    return rollouts.agg(
        total.alias("total_num_tokens"),
        F.lit(float(step_seconds)).alias("time_per_step"),
        (total / F.lit(float(step_seconds) * devices)).alias("throughput"),
    )


SLOWEST = ["seq_id", "generate_seconds", "tool_seconds", "prompt_length", "response_length"]


def agent_metrics(df: DataFrame) -> DataFrame:
    """Generation and tool seconds, and the details of the slowest sample."""
    total = F.col("generate_seconds") + F.col("tool_seconds")
    out = df.agg(
        *_three("generate", F.col("generate_seconds")),
        *_three("tool", F.col("tool_seconds")),
        F.max_by(F.struct(*SLOWEST), F.struct(total, -F.col("seq_id"))).alias("s"),
    )
    names = [c for c in out.columns if c != "s"]
    return out.select(*names, *[F.col(f"s.{c}").alias(f"slowest_{c}") for c in SLOWEST])


def flops(
    rollouts: DataFrame, dense_params: float, layers: int, heads: int, head_dim: int, seconds: float, length: str = "length"
) -> DataFrame:
    """Estimated TFLOP/s of a dense transformer from sums of lengths."""
    n = F.col(length).cast("double")
    dense = 6.0 * dense_params * F.sum(n)
    attention = 12.0 * F.sum(n * n) * head_dim * heads * layers
    return rollouts.agg(((dense + attention) / seconds / 1e12).alias("tflops"))


def fact_metrics(scored: DataFrame) -> DataFrame:
    """Format and answer rewards of think/answer responses."""
    return scored.agg(
        F.avg("format_reward").alias("format_mean"),
        F.avg("answer_reward").alias("answer_mean"),
        F.avg(F.col("format_reward") + F.col("answer_reward")).alias("total_mean"),
        F.sum(F.col("format_reward").cast("bigint")).alias("n_well_formed"),
        F.count(F.lit(1)).alias("n_rows"),
    )


# Closed length ranges of the report; the last one is open.
LENGTH_RANGES = [(0, 100), (101, 200), (201, 300), (301, 400), (401, 500), (501, 1000)]


def length_stats(df: DataFrame, length: str = "length", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(
        F.avg(length).alias("mean"),
        F.max(length).alias("max"),
        F.min(length).alias("min"),
        F.percentile(length, 0.5).alias("median"),
        F.stddev_pop(length).alias("std"),
    )


def length_histogram(df: DataFrame, length: str = "length") -> DataFrame:
    """Rows and percent per length range."""
    label = F.lit("1001+")
    for lo, hi in reversed(LENGTH_RANGES):
        label = F.when(F.col(length).between(lo, hi), F.lit(f"{lo}-{hi}")).otherwise(label)
    counts = df.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def seqlen_imbalance(df: DataFrame, before: str, after: str, length: str = "length") -> DataFrame:
    """Spread of summed lengths per block, before and after balancing."""

    def sums(part: str, prefix: str) -> DataFrame:
        per = df.groupBy(part).agg(F.sum(length).alias("s"))
        return per.agg(
            F.min("s").alias(f"{prefix}min"), F.max("s").alias(f"{prefix}max"), F.avg("s").alias(f"{prefix}mean")
        )

    out = _joined(sums(before, ""), sums(after, "balanced_"))
    return out.select(
        "min", "max", (F.col("max") - F.col("min")).alias("minmax_diff"), "balanced_min", "balanced_max", "mean"
    )
