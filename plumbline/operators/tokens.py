"""Token-level columns: rewards, masks, divergence and importance weights.

A token table has one row per ``(seq_id, pos)``. Sequence values are summed
with partial aggregation and attached through the salted join of ``scale``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.basics import bounded_exp, clip
from plumbline.operators.scale import attach_group, lowest, running_sum, written

MEAN_EPS = 1e-8


def attach_sequence(tokens: DataFrame, *aggs: Column, where: Column | None = None) -> DataFrame:
    """Aggregates of a sequence's (valid) tokens on each of its tokens."""
    source = tokens if where is None else tokens.where(where)
    sizes = tokens.groupBy("seq_id").agg(F.count(F.lit(1)).alias("__size"))
    if where is None:
        stats = tokens.groupBy("seq_id").agg(F.count(F.lit(1)).alias("__size"), *aggs)
    else:
        stats = sizes.join(source.groupBy("seq_id").agg(*aggs), "seq_id", "left")
    return attach_group(tokens, stats, ["seq_id"], "__size", ["pos"]).drop("__size")


def masked(mask: str, value: Column) -> Column:
    """The value on valid tokens, NULL elsewhere, for conditional aggregates."""
    return F.when(F.col(mask) > 0, value)


def place_terminal_reward(tokens: DataFrame, rollouts: DataFrame) -> DataFrame:
    """Score of a response on its last valid token, zero on the others."""
    valid = F.when((F.col("mask") > 0) & F.col("seq_id").isNotNull(), F.col("pos"))
    ends = tokens.groupBy("seq_id").agg(F.count(F.lit(1)).alias("__size"), F.max(valid).alias("__last"))
    stats = ends.join(rollouts.select("seq_id", "score"), "seq_id", "left")
    joined = attach_group(tokens, stats, ["seq_id"], "__size", ["pos"])
    reward = F.when(F.col("pos") == F.col("__last"), F.col("score")).otherwise(F.lit(0.0))
    return joined.withColumn("reward", reward).drop("__size", "__last", "score")


def eos_mask(tokens: DataFrame, eos_ids: list[int]) -> DataFrame:
    """1 up to and including the first end token of a sequence."""
    first = F.min(F.when(F.col("token_id").isin(eos_ids), F.col("pos"))).alias("__eos")
    keep = (F.col("__eos").isNull() | (F.col("pos") <= F.col("__eos"))).cast("int")
    return attach_sequence(tokens, first).withColumn("mask", keep).drop("__eos")


def position_ids(tokens: DataFrame, chunk: int = 512) -> DataFrame:
    """Running count of valid tokens minus one, never below zero."""
    cut = tokens.withColumn("__chunk", F.floor(F.col("pos") / chunk))
    summed = running_sum(cut, ["seq_id"], "__chunk", [F.col("pos")], {"__seen": "mask"})
    return summed.withColumn(
        "position_id", F.greatest(F.col("__seen") - 1, F.lit(0)).cast("bigint")
    ).drop("__seen", "__chunk")


def kl(log_prob: Column, ref_log_prob: Column, kind: str = "k1") -> Column:
    """Per-token divergence estimate; a trailing ``+`` only matters for gradients."""
    delta = log_prob - ref_log_prob
    name = kind.rstrip("+")
    if name in ("k1", "kl"):
        return delta
    if name == "abs":
        return F.abs(delta)
    if name in ("k2", "mse"):
        return 0.5 * delta * delta
    if name in ("k3", "low_var_kl"):
        back = clip(-delta, -20.0, 20.0)
        return clip(F.exp(back) - back - 1, -10.0, 10.0)
    raise ValueError(f"unknown divergence estimate {kind!r}")


def apply_kl_penalty(tokens: DataFrame, beta: float, kind: str = "k1", score: str = "score") -> DataFrame:
    """``reward = score − β·KL`` on valid tokens."""
    d = kl(F.col("old_log_prob"), F.col("ref_log_prob"), kind) * F.col("mask")
    return tokens.withColumn("kl", d).withColumn("reward", F.col(score) - beta * F.col("kl"))


def mean_sequence_kl(tokens: DataFrame) -> DataFrame:
    """Mean over sequences of the masked mean divergence (column ``kl``)."""
    per_seq = tokens.groupBy("seq_id").agg(
        (F.sum(F.col("kl") * F.col("mask")) / (F.sum("mask") + MEAN_EPS)).alias("kl")
    )
    return per_seq.agg(F.avg("kl").alias("mean_kl"))


def masked_stats(tokens: DataFrame, col: str, by: list[str] | None = None, mask: str = "mask", strict: bool = True) -> DataFrame:
    """Masked sum, mean (÷(Σmask + 1e-8)) and Bessel-corrected variance.

    Fewer than two valid rows is an error for the variance, or gives NULL if not
    ``strict``; without any the mean is NULL.
    """
    x = masked(mask, F.col(col))
    n = F.sum(mask)
    mean = F.sum(x) / (n + MEAN_EPS)
    few = F.raise_error(F.lit("variance needs more than one valid row")).cast("double")
    return tokens.groupBy(*(by or [])).agg(
        F.coalesce(F.sum(x), F.lit(0.0)).alias("masked_sum"),
        mean.alias("masked_mean"),
        F.when(n <= 1, few if strict else F.lit(None)).otherwise(F.var_samp(x)).alias("masked_var"),
    )


def group_moments(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Mean, max, min and deviation over everything the cluster holds."""
    return df.groupBy(*(by or [])).agg(
        F.avg(col).alias("mean"), F.max(col).alias("max"), F.min(col).alias("min"), F.stddev_samp(col).alias("std")
    )


LEVELS = ("token", "sequence", "geometric")


def log_ratio() -> Column:
    """Training against rollout policy."""
    return F.col("old_log_prob") - F.col("rollout_log_prob")


def with_log_ratio(tokens: DataFrame, level: str) -> DataFrame:
    """``__lr``: log ratio of the token, its sequence sum or sequence mean."""
    if level == "token":
        return tokens.withColumn("__lr", log_ratio())
    total = F.coalesce(F.sum(masked("mask", log_ratio())), F.lit(0.0))
    if level == "sequence":
        return attach_sequence(tokens, total.alias("__lr"))
    if level == "geometric":
        return attach_sequence(tokens, (total / (F.sum("mask") + MEAN_EPS)).alias("__lr"))
    raise ValueError(f"unknown level {level!r}; have {LEVELS}")


def is_weights(tokens: DataFrame, level: str = "token", threshold: float = 2.0, normalize: bool = False) -> DataFrame:
    """Truncated importance weights ``is_weight``, zero on masked tokens.

    ``normalize`` divides by the batch mean, over tokens or over sequence means;
    a mean of 1e-8 or less leaves the weights alone.
    """
    if level == "token":
        weight = F.least(bounded_exp(F.col("__lr")) * F.col("mask"), F.lit(threshold))
        out = with_log_ratio(tokens, level).withColumn("is_weight", weight).drop("__lr")
        m = out.agg((F.sum("is_weight") / (F.sum("mask") + MEAN_EPS)).alias("m")).scalar() if normalize else None
        return out if m is None else out.withColumn("is_weight", _over_mean(F.col("is_weight"), m))
    # All valid tokens of a sequence weigh the same: one aggregate, joined back once.
    total, n = F.coalesce(F.sum(masked("mask", log_ratio())), F.lit(0.0)), F.sum("mask")
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; have {LEVELS}")
    ratio = total if level == "sequence" else total / (n + MEAN_EPS)
    weight = F.least(bounded_exp(ratio), F.lit(threshold))
    per_seq = tokens.groupBy("seq_id").agg(weight.alias("__w"), n.alias("__n"), F.count(F.lit(1)).alias("__size"))
    per_seq = written(per_seq, "sequence-weights")
    weighed = F.col("__w")
    if normalize:
        mean = per_seq.where("__n > 0").agg(F.avg(F.col("__w") * F.col("__n") / (F.col("__n") + MEAN_EPS)).alias("m"))
        weighed = _over_mean(weighed, F.lit(mean.first()["m"]))
    joined = attach_group(tokens, per_seq.select("seq_id", weighed.alias("__w"), "__size"), ["seq_id"], "__size", ["pos"])
    return joined.withColumn("is_weight", F.col("__w") * F.col("mask")).drop("__w", "__size")


def _over_mean(weight: Column, mean: Column) -> Column:
    return F.when(mean > 1e-8, weight / mean).otherwise(weight)


def rejection_mask(
    tokens: DataFrame, level: str = "token", upper: float = 2.0, lower: float | None = None
) -> DataFrame:
    """``kept_mask``: tokens (or whole sequences) inside the ratio band."""
    ratio = bounded_exp(F.col("__lr"))
    low = 1.0 / upper if lower is None else lower
    inside = ratio.between(low, upper).cast("int")
    return with_log_ratio(tokens, level).withColumn("kept_mask", F.col("mask") * inside).drop("__lr")


def veto_sequences(tokens: DataFrame, threshold: float) -> DataFrame:
    """Mask a whole sequence if one valid token's ratio is below the threshold."""
    below = (F.col("mask") > 0) & (log_ratio() < F.ln(F.lit(threshold)))
    bad = F.max(F.when(below, 1).otherwise(0))
    marked = attach_sequence(tokens, bad.alias("__veto"))
    return marked.withColumn("kept_mask", F.col("mask") * (1 - F.col("__veto"))).drop("__veto")


def token_mismatch(tokens: DataFrame, a: str, b: str) -> DataFrame:
    """Valid positions per sequence where two token columns differ."""
    differs = (F.col("mask") == 1) & (F.col(a) != F.col(b))
    return tokens.groupBy("seq_id").agg(F.count_if(differs).alias("n_diff"))


def logprob_drift(tokens: DataFrame, a: str = "old_log_prob", b: str = "rollout_log_prob") -> DataFrame:
    """Distance and correlation of token probabilities on valid tokens."""
    p, q = F.exp(F.col(a)), F.exp(F.col(b))
    gap = F.abs(p - q)
    return tokens.where(F.col("mask") > 0).agg(
        F.max(gap).alias("diff_max"),
        F.avg(gap).alias("diff_mean"),
        F.stddev_samp(gap).alias("diff_std"),
        F.corr(p, q).alias("pearson"),
    )


def sequence_logprob(tokens: DataFrame, col: str = "log_prob", average: bool = False) -> DataFrame:
    """Sum or mean of logged log-probabilities over valid tokens."""
    x = masked("mask", F.col(col))
    value = F.avg(x) if average else F.coalesce(F.sum(x), F.lit(0.0))
    return tokens.groupBy("seq_id").agg(value.alias("logp"))


def with_covariance(tokens: DataFrame, out: str = "cov") -> tuple[DataFrame, int]:
    """Each token's term of the covariance of advantage and log-prob over valid tokens, and their number."""
    valid = tokens.where(F.col("mask") > 0)
    means = valid.agg(F.avg("advantage").alias("a"), F.avg("log_prob").alias("l"), F.count(F.lit(1)).alias("n")).first()
    cov = (F.col("advantage") - F.lit(means["a"])) * (F.col("log_prob") - F.lit(means["l"]))
    return tokens.withColumn(out, cov), means["n"]


def topk_covariance(tokens: DataFrame, ratio: float) -> DataFrame:
    """Valid tokens with the largest covariance term, ``max(1, int(n · ratio))`` of them."""
    scored, n = with_covariance(tokens)
    return take_largest(scored.where(F.col("mask") > 0), "cov", ["seq_id", "pos"], max(1, int(n * ratio)))


def take_largest(df: DataFrame, col: str, ties: list[str], wanted: int | Column) -> DataFrame:
    """The ``wanted`` largest rows of a column, ties in ascending key order.

    Equal values are told apart by the keys, so any number of them is no bucket.
    """
    if isinstance(wanted, Column):
        wanted = df.sparkSession.range(1).select(wanted).first()[0]
    held = written(df.withColumn("__low", -F.col(col)), "candidates")
    return lowest(held, wanted, ["__low", *ties]).drop("__low")
