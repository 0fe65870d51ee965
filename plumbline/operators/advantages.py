"""Advantage estimators over groups of responses and over tokens.

Outcome estimators take one row per response (``uid, seq_id, score`` and, where
needed, ``response_length``) and add ``advantage``. Group values come from an
aggregate joined back with salting for hot prompts, never from a window over
the whole prompt group. Token estimators take one row per token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.registry import ADVANTAGES, register_advantage
from plumbline.operators.scale import attach_group, backward_scan, lookup, match, with_group_stats, written

EPS = 1e-6
WHITEN_EPS = 1e-8


def advantage(df: DataFrame, name: str, **options) -> DataFrame:
    """Run a registered estimator by its (case-sensitive) name."""
    return ADVANTAGES.get(name)(df, **options)


def _with_moments(rollouts: DataFrame, score: str, *extra: Column) -> DataFrame:
    r = F.col(score)
    aggs = [
        F.count(F.lit(1)).alias("__n"),
        F.avg(r).alias("__mean"),
        F.var_samp(r).alias("__var"),
        F.sum(r).alias("__sum"),
        *extra,
    ]
    return with_group_stats(rollouts, ["uid"], aggs, ["seq_id"])


def _tidy(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def group_mean_std(df: DataFrame, uid: str = "uid", score: str = "score", eps: float = EPS) -> DataFrame:
    """Per group mean, floored standard deviation and size; a single row gives
    mean 0 and deviation 1."""
    single = F.col("n") == 1
    stats = df.groupBy(uid).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("m"), F.var_samp(score).alias("v")
    )
    return stats.select(
        uid,
        F.when(single, 0.0).otherwise(F.col("m")).alias("mean"),
        F.when(single, 1.0).otherwise(F.sqrt(F.greatest(F.col("v"), F.lit(eps)))).alias("std"),
        "n",
    )


@register_advantage("grpo")
def grpo(rollouts: DataFrame, norm: bool = True, eps: float = EPS, score: str = "score") -> DataFrame:
    """(r − mean) / (sample deviation + eps); a lone response has mean 0, std 1."""
    single = F.col("__n") == 1
    centred = F.col(score) - F.when(single, 0.0).otherwise(F.col("__mean"))
    scale = F.when(single, 1.0).otherwise(F.sqrt("__var")) + eps
    adv = centred / scale if norm else centred
    return _tidy(_with_moments(rollouts, score).withColumn("advantage", adv))


@register_advantage("grpo_vectorized")
def grpo_vectorized(rollouts: DataFrame, norm: bool = True, eps: float = EPS, score: str = "score") -> DataFrame:
    """The same with the variance floored at eps inside the root."""
    single = F.col("__n") == 1
    centred = F.col(score) - F.when(single, 0.0).otherwise(F.col("__mean"))
    scale = F.when(single, 1.0).otherwise(F.sqrt(F.greatest(F.col("__var"), F.lit(eps)))) + eps
    adv = centred / scale if norm else centred
    return _tidy(_with_moments(rollouts, score).withColumn("advantage", adv))


@register_advantage("grpo_passk")
def grpo_passk(rollouts: DataFrame, norm: bool = True, eps: float = EPS, score: str = "score") -> DataFrame:
    """Only the best response of a prompt gets best − second best.

    Ties go to the lowest ``seq_id``; a prompt with one response is an error.
    """
    first = F.max(F.struct(F.col(score), (-F.col("seq_id")).alias("neg_id"))).alias("__best")
    marked = _with_moments(rollouts, score, first)
    is_best = F.col("seq_id") == -F.col("__best.neg_id")
    rest = marked.where(~is_best).groupBy("uid").agg(
        F.max(score).alias("__second"), F.count(F.lit(1)).alias("__rest")
    )
    gap = F.col("__best")[score] - F.col("__second")
    scale = F.sqrt("__var") + eps
    lone = F.raise_error(F.lit("pass@k needs at least two responses per prompt")).cast("double")
    joined = attach_group(marked, rest, ["uid"], "__rest", ["seq_id"])
    adv = F.when(F.col("__n") < 2, lone).when(is_best, gap / scale if norm else gap).otherwise(F.lit(0.0))
    return _tidy(joined.withColumn("advantage", adv))


@register_advantage("rloo")
def rloo(rollouts: DataFrame, score: str = "score") -> DataFrame:
    """Leave-one-out baseline; a lone response keeps its raw reward."""
    n, r = F.col("__n"), F.col(score)
    adv = F.when(n > 1, (n * r - F.col("__sum")) / (n - 1)).otherwise(r)
    return _tidy(_with_moments(rollouts, score).withColumn("advantage", adv))


@register_advantage("rloo_vectorized")
def rloo_vectorized(rollouts: DataFrame, score: str = "score") -> DataFrame:
    """Leave-one-out baseline; a lone response gets 0."""
    n, r = F.col("__n"), F.col(score)
    adv = F.when(n > 1, (n * r - F.col("__sum")) / (n - 1)).otherwise(F.lit(0.0))
    return _tidy(_with_moments(rollouts, score).withColumn("advantage", adv))


@register_advantage("opo")
def opo(rollouts: DataFrame, score: str = "score", length: str = "response_length") -> DataFrame:
    """Reward minus the length-weighted mean reward of the prompt."""
    weighted = F.try_divide(F.sum(F.col(length) * F.col(score)), F.sum(length)).alias("__base")
    base = F.when(F.col("__n") == 1, 0.0).otherwise(F.col("__base"))
    return _tidy(_with_moments(rollouts, score, weighted).withColumn("advantage", F.col(score) - base))


@register_advantage("gpg")
def gpg(rollouts: DataFrame, f_norm: float = 1.0, score: str = "score") -> DataFrame:
    """α · (r − mean) / f_norm with α = batch size / responses with a reward."""
    batch = rollouts.agg(
        (F.count(F.lit(1)) / F.greatest(F.count_if(F.col(score) != 0), F.lit(1))).alias("alpha")
    )
    single = F.col("__n") == 1
    centred = F.col(score) - F.when(single, 0.0).otherwise(F.col("__mean"))
    return _tidy(
        _with_moments(rollouts, score).withColumn("advantage", batch.scalar() * centred / F.lit(f_norm))
    )


@register_advantage("reinforce_plus_plus_baseline")
def reinforce_plus_plus_baseline(rollouts: DataFrame, score: str = "score", length: str = "response_length"):
    """Reward minus group mean, whitened over all valid tokens.

    Every token of a response carries the same value, so the whitening moments
    are length-weighted sums over responses.
    """
    single = F.col("__n") == 1
    centred = _with_moments(rollouts, score).withColumn(
        "__x", F.col(score) - F.when(single, 0.0).otherwise(F.col("__mean"))
    )
    return _tidy(whiten(centred, "__x", "advantage", weight=length))


def whiten(df: DataFrame, col: str, out: str | None = None, weight: str = "mask", shift_mean: bool = True) -> DataFrame:
    """(x − mean) / sqrt(var + 1e-8) over all rows with positive weight.

    The moments enter as scalar subqueries. A 0/1 weight uses Spark's own merging
    moments; other weights take a second pass around the mean.
    """
    w, x = F.col(weight), F.col(col)
    valid = df.where(w > 0)
    if weight == "mask":
        mean, variance = F.avg(x), F.var_samp(x)
    else:
        mean = F.sum(w * x) / F.sum(w)
        off = x - valid.agg(mean.alias("m")).scalar()
        variance = F.sum(w * off * off) / (F.sum(w) - 1)
    moments = valid.agg(F.struct(mean.alias("m"), variance.alias("v")).alias("s")).scalar()
    centred = (x - moments["m"]) / F.sqrt(moments["v"] + WHITEN_EPS)
    return df.withColumn(out or col, centred if shift_mean else centred + moments["m"])


@register_advantage("reinforce_plus_plus")
def reinforce_plus_plus(tokens: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Discounted return from the right, reset after a masked token, whitened."""
    m, r = F.col("mask"), F.col("reward")
    scanned = backward_scan(
        tokens, ["seq_id"], "pos", factor=m * gamma, addend=m * r, out="__next", inclusive=False
    )
    returns = scanned.withColumn("return", r + gamma * F.col("__next"))
    white = whiten(returns, "return", "advantage")
    return _tidy(white.withColumn("advantage", F.col("advantage") * m))


@register_advantage("remax")
def remax(tokens: DataFrame, baselines: DataFrame) -> DataFrame:
    """Reverse running reward minus the greedy baseline on valid tokens."""
    m = F.col("mask")
    returns = backward_scan(
        tokens, ["seq_id"], "pos", factor=F.lit(1.0), addend=F.col("reward") * m, out="return"
    )
    joined = join_baseline(returns, baselines)
    return joined.withColumn("advantage", F.col("return") - F.col("reward_baseline") * m).drop("reward_baseline")


def join_baseline(df: DataFrame, greedy: DataFrame) -> DataFrame:
    """Spread each prompt's greedy reward over all its rows (many to one)."""
    return lookup(df, greedy.select("uid", "reward_baseline"), ["uid"])


@register_advantage("gae")
def gae(tokens: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Generalised advantage estimation over one row per token.

    Next value and running sum run from the right in one scan; a masked token
    hands both through. Returns are taken before whitening.
    """
    m, r, v = F.col("mask"), F.col("reward"), F.col("value")
    scanned = backward_scan(
        tokens,
        ["seq_id"],
        "pos",
        factor=m * (gamma * lam) + (1 - m),
        addend=m * (r - v),
        out="__gae",
        cross=m * gamma,
        helper_factor=1 - m,
        helper_addend=m * v,
    )
    white = whiten(scanned.withColumn("return", F.col("__gae") + v), "__gae", "advantage")
    return _tidy(white)


@register_advantage("prime")
def prime_rloo(tokens: DataFrame, dpo_coef: float = 1.0, gt_coef: float = 1.0) -> DataFrame:
    """Leave-one-out advantage from two reward sources, whitened.

    A prompt without a valid token has no baseline and zero rewards.

    Token scores (``rm_score``) and accuracy on the last valid token (``acc``)
    each get the baseline Σ row means / (n − 1) of their prompt; the weighted
    sum becomes a reverse running total.
    """
    m = F.col("mask")
    tokens = written(tokens, "tokens")
    seq = tokens.where(m > 0).groupBy("uid", "seq_id").agg(
        F.avg("rm_score").alias("__rm"), F.max("acc").alias("__acc"), F.max("pos").alias("__last")
    )
    group = seq.groupBy("uid").agg(
        F.count(F.lit(1)).alias("__n"), F.sum("__rm").alias("__rm_sum"), F.sum("__acc").alias("__acc_sum")
    )
    sized = match(tokens.groupBy("uid").agg(F.count(F.lit(1)).alias("__size")), group, ["uid"], "left")
    with_group = attach_group(tokens, sized, ["uid"], "__size", ["seq_id", "pos"]).drop("__size")
    lasts = seq.select("uid", "seq_id", "__last")
    rows = match(with_group, lasts, ["uid", "seq_id"], "left")
    n = F.col("__n")
    rm = F.col("rm_score") * n / (n - 1) - F.col("__rm_sum") / (n - 1)
    acc = F.col("acc") * n / (n - 1) - F.col("__acc_sum") / (n - 1)
    reward = dpo_coef * rm + F.when(F.col("pos") == F.col("__last"), gt_coef * acc).otherwise(0.0)
    scored = rows.withColumn("__reward", F.when((m > 0) & (n > 1), reward).otherwise(F.lit(0.0)))
    returns = backward_scan(
        scored, ["uid", "seq_id"], "pos", factor=F.lit(1.0), addend=F.col("__reward"), out="return"
    )
    return _tidy(whiten(returns, "return", "advantage"))


def softmean_center(rollouts: DataFrame, beta: float, score: str = "score") -> DataFrame:
    """r − (logsumexp(βr) − ln n)/β over the whole batch; β = 0 is the mean."""
    r = F.col(score)
    if beta == 0:
        return rollouts.withColumn("centered", r - rollouts.agg(F.avg(r).alias("m")).scalar())
    peak = rollouts.agg(F.max(r * beta).alias("m")).scalar()
    total = rollouts.agg((F.ln(F.sum(F.exp(r * beta - peak))) - F.ln(F.count(F.lit(1)))).alias("t")).scalar()
    return rollouts.withColumn("centered", r - (total + peak) / F.lit(beta))
