"""Distance between the policy that trains and the policy that sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.basics import bounded_exp, clip
from plumbline.operators.tokens import (
    MEAN_EPS,
    is_weights,
    log_ratio,
    masked,
    rejection_mask,
    veto_sequences,
)


def offpolicy_metrics(tokens: DataFrame) -> DataFrame:
    """Perplexities, divergences and χ² between training and rollout policy.

    One aggregate per sequence, one over sequences; token-level means are
    carried as sums.
    """
    lr = log_ratio()
    n = F.sum("mask") + MEAN_EPS
    seq = tokens.groupBy("seq_id").agg(
        (F.sum(masked("mask", F.col("old_log_prob"))) / n).alias("train"),
        (F.sum(masked("mask", F.col("rollout_log_prob"))) / n).alias("roll"),
        F.sum("mask").alias("n"),
        F.coalesce(F.sum(masked("mask", lr)), F.lit(0.0)).alias("lr"),
        F.sum(masked("mask", F.exp(lr) - lr - 1)).alias("k3"),
        F.sum(masked("mask", F.pow(bounded_exp(lr), F.lit(2.0)))).alias("rho2"),
    )
    train = F.coalesce("train", F.lit(0.0))
    roll = F.coalesce("roll", F.lit(0.0))
    diff = roll - train
    total = F.sum("n") + MEAN_EPS
    return seq.agg(
        F.avg(F.exp(-train)).alias("training_ppl"),
        F.avg(-train).alias("training_log_ppl"),
        (-F.sum("lr") / total).alias("kl"),
        (F.sum("k3") / total).alias("k3_kl"),
        F.avg(F.exp(-roll)).alias("rollout_ppl"),
        F.avg(-roll).alias("rollout_log_ppl"),
        F.avg(diff).alias("log_ppl_diff"),
        F.avg(F.abs(diff)).alias("log_ppl_abs_diff"),
        F.max(diff).alias("log_ppl_diff_max"),
        F.min(diff).alias("log_ppl_diff_min"),
        F.avg(F.exp(diff)).alias("ppl_ratio"),
        (F.sum("rho2") / total - 1).alias("chi2_token"),
        (F.avg(F.exp(2 * clip(F.col("lr"), -20.0, 20.0))) - 1).alias("chi2_seq"),
    )


def ratio_metrics(
    tokens: DataFrame, level: str, upper: float, lower: float | None = None, prefix: str = "rollout_is"
) -> DataFrame:
    """Statistics of importance ratios at token, sequence or geometric level."""
    low = 1.0 / upper if lower is None else lower
    lr = log_ratio()
    m = F.col("mask")
    seq_lr = F.coalesce(F.sum(masked("mask", lr)), F.lit(0.0))
    if level == "geometric":
        seq_lr = seq_lr / (F.sum("mask") + MEAN_EPS)

    def sums(w: Column, weight: Column) -> list[Column]:
        cut = F.greatest(F.lit(low), F.least(F.lit(upper), w))
        return [
            F.sum(w * weight).alias("w"),
            F.sum(cut * weight).alias("wc"),
            F.sum(cut * cut * weight).alias("wc2"),
            F.sum((w > upper).cast("int") * weight).alias("hi"),
            F.sum((w < low).cast("int") * weight).alias("lo"),
            F.sum(weight).alias("n"),
        ]

    if level == "token":
        seq = tokens.groupBy("seq_id").agg(
            *sums(bounded_exp(lr), m),
            F.max(masked("mask", bounded_exp(lr))).alias("max"),
            F.min(masked("mask", bounded_exp(lr))).alias("min"),
        )
        peak, floor = F.max("max"), F.min("min")
        high, under = F.sum("hi") / (F.sum("n") + MEAN_EPS), F.sum("lo") / (F.sum("n") + MEAN_EPS)
    else:
        per_seq = tokens.groupBy("seq_id").agg(seq_lr.alias("lr"), F.sum("mask").alias("n"))
        ratio = bounded_exp(F.col("lr"))
        cut = F.greatest(F.lit(low), F.least(F.lit(upper), ratio))
        seq = per_seq.select(
            "seq_id",
            "lr",
            "n",
            (ratio * F.col("n")).alias("w"),
            (cut * F.col("n")).alias("wc"),
            (cut * cut * F.col("n")).alias("wc2"),
        )
        peak, floor = F.exp(F.least(F.max("lr"), F.lit(20.0))), F.exp(F.min("lr"))
        high = F.avg((F.col("lr") > F.ln(F.lit(upper))).cast("double"))
        under = F.avg((F.col("lr") < F.ln(F.lit(low))).cast("double"))
    total = F.sum("n") + MEAN_EPS
    mean_cut = F.sum("wc") / total
    square_cut = F.sum("wc2") / total
    seq_mean = F.col("w") / (F.col("n") + MEAN_EPS)
    variance = F.greatest(square_cut - mean_cut * mean_cut, F.lit(0.0))
    return seq.agg(
        (F.sum("w") / total).alias(f"{prefix}_mean"),
        peak.alias(f"{prefix}_max"),
        floor.alias(f"{prefix}_min"),
        F.when(F.sum("n") > 1, F.sqrt(variance)).otherwise(F.lit(0.0)).alias(f"{prefix}_std"),
        high.alias(f"{prefix}_ratio_fraction_high"),
        under.alias(f"{prefix}_ratio_fraction_low"),
        (F.pow(mean_cut + MEAN_EPS, F.lit(2.0)) / square_cut).alias(f"{prefix}_eff_sample_size"),
        F.avg(seq_mean).alias(f"{prefix}_seq_mean"),
        F.coalesce(F.stddev_samp(seq_mean), F.lit(0.0)).alias(f"{prefix}_seq_std"),
        F.max(seq_mean).alias(f"{prefix}_seq_max"),
        F.min(seq_mean).alias(f"{prefix}_seq_min"),
        F.max(F.abs(seq_mean - 1)).alias(f"{prefix}_seq_max_deviation"),
        F.avg((seq_mean > upper).cast("double")).alias(f"{prefix}_seq_fraction_high"),
        F.avg((seq_mean < low).cast("double")).alias(f"{prefix}_seq_fraction_low"),
    )


def is_metrics(tokens: DataFrame, level: str = "token", threshold: float = 2.0) -> DataFrame:
    return ratio_metrics(tokens, level, threshold)


def rs_metrics(tokens: DataFrame, level: str = "token", upper: float = 2.0, lower: float | None = None) -> DataFrame:
    """Ratio statistics plus the masked share of tokens and of sequences."""
    base = ratio_metrics(tokens, level, upper, lower, "rollout_rs")
    kept = rejection_mask(tokens, level, upper, lower)
    per_seq = kept.groupBy("seq_id").agg(F.sum("mask").alias("n"), F.sum("kept_mask").alias("k"))
    shares = per_seq.agg(
        (1 - F.sum("k") / F.sum("n")).alias("rollout_rs_masked_fraction"),
        F.avg((F.col("k") < F.col("n")).cast("double")).alias("rollout_rs_seq_masked_fraction"),
    )
    one = F.lit(1).alias("__one")
    return base.select("*", one).join(shares.select("*", one), "__one").drop("__one")


def rollout_correction(
    tokens: DataFrame,
    is_level: str | None = "token",
    is_threshold: float = 2.0,
    rs_level: str | None = None,
    rs_upper: float = 2.0,
    rs_lower: float | None = None,
    veto: float | None = None,
    normalize: bool = False,
) -> DataFrame:
    """Importance weights and the combined rejection and veto mask per token."""
    out = tokens
    if is_level is not None:
        out = is_weights(out, is_level, is_threshold, normalize)
    else:
        out = out.withColumn("is_weight", F.lit(1.0))
    kept = F.col("mask")
    if rs_level is not None:
        out = rejection_mask(out, rs_level, rs_upper, rs_lower).withColumnRenamed("kept_mask", "__rs")
        kept = kept * F.col("__rs")
    if veto is not None:
        out = veto_sequences(out, veto).withColumnRenamed("kept_mask", "__vt")
        kept = kept * F.col("__vt")
    return out.withColumn("kept_mask", kept).drop("__rs", "__vt")


def rollout_correction_metrics(tokens: DataFrame, is_level: str = "token", threshold: float = 2.0) -> DataFrame:
    """Off-policy and weight statistics as ``(metric, value)`` with a prefix."""
    wide = [offpolicy_metrics(tokens), is_metrics(tokens, is_level, threshold)]
    long = [w.unpivot([], w.columns, "metric", "value") for w in wide]
    return long[0].unionByName(long[1]).select(
        F.concat(F.lit("rollout_corr/"), "metric").alias("metric"), F.col("value").cast("double").alias("value")
    )
