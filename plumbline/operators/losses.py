"""Forward values of policy and value losses over a logged token table.

Every loss is a per-token column followed by ``aggregate_loss``; nothing here
has gradients. Results are one row: ``loss`` and the loss's own metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.basics import clip, hash48
from plumbline.operators.offpolicy import rollout_correction
from plumbline.operators.registry import LOSSES, register_loss
from plumbline.operators.tokens import MEAN_EPS, attach_sequence, kl, masked, take_largest, with_covariance

MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def aggregate_loss(
    tokens: DataFrame, mode: str = "token-mean", extra: list[tuple[str, Column]] | None = None, col: str = "token_loss", norm: float | None = None
) -> DataFrame:
    """Token losses to one number by one of four modes.

    Every mode is sums per sequence, then sums over sequences; ``extra`` are
    masked token means ``(alias, column)`` taken along in the same pass. Fully
    masked sequences do not count. ``norm`` defaults to the longest sequence.
    """
    extra = extra or []
    m = F.col("mask")
    sums = [F.sum(c * m).alias(f"__x{i}") for i, (_, c) in enumerate(extra)]
    seq = tokens.groupBy("seq_id").agg(
        F.sum(F.col(col) * m).alias("s"), F.sum(m).alias("n"), F.max("pos").alias("last"), *sums
    )
    means = [(F.sum(f"__x{i}") / (F.sum("n") + MEAN_EPS)).alias(name) for i, (name, _) in enumerate(extra)]
    live = F.col("n") > 0
    if mode == "token-mean":
        loss = F.sum("s") / (F.sum("n") + MEAN_EPS)
    elif mode == "seq-mean-token-sum":
        loss = F.sum(F.when(live, F.col("s"))) / F.count_if(live)
    elif mode == "seq-mean-token-mean":
        loss = F.sum(F.when(live, F.col("s") / (F.col("n") + MEAN_EPS))) / F.count_if(live)
    elif mode == "seq-mean-token-sum-norm":
        width = F.lit(float(norm)) if norm else (F.max("last") + 1).cast("double")
        loss = F.sum("s") / width
    else:
        raise ValueError(f"unknown loss aggregation {mode!r}; have {MODES}")
    return seq.agg(loss.alias("loss"), *means)


def policy_loss(tokens: DataFrame, name: str = "vanilla", **options) -> DataFrame:
    return LOSSES.get(name)(tokens, **options)


def _weighted(tokens: DataFrame, loss: Column) -> Column:
    return loss * F.col("is_weight") if "is_weight" in tokens.columns else loss


def _delta() -> Column:
    return F.col("log_prob") - F.col("old_log_prob")


def _flag(c: Column) -> Column:
    return c.cast("double")


@register_loss("vanilla")
def ppo_loss(
    tokens: DataFrame, clip_lo: float = 0.2, clip_hi: float = 0.2, clip_c: float = 3.0, mode: str = "token-mean"
) -> DataFrame:
    """Clipped-ratio loss with a second clip for negative advantages."""
    if clip_c <= 1.0:
        raise ValueError("the dual clip bound must be above 1")
    adv = F.col("advantage")
    delta = clip(_delta(), -20.0, 20.0)
    ratio = F.exp(delta)
    plain = -adv * ratio
    clipped = -adv * F.greatest(F.lit(1 - clip_lo), F.least(F.lit(1 + clip_hi), ratio))
    upper = F.greatest(plain, clipped)
    dual = -adv * clip_c
    loss = F.when(adv < 0, F.least(dual, upper)).otherwise(upper)
    return aggregate_loss(
        tokens.withColumn("token_loss", _weighted(tokens, loss)),
        mode,
        [
            ("pg_clipfrac", _flag(clipped > plain)),
            ("ppo_kl", -delta),
            ("pg_clipfrac_lower", _flag((upper > dual) & (adv < 0))),
        ],
    )


@register_loss("gspo")
def gspo_loss(tokens: DataFrame, clip_lo: float = 0.2, clip_hi: float = 0.2) -> DataFrame:
    """The sequence's mean log ratio stands in for each token's."""
    mean = F.coalesce(F.sum(masked("mask", _delta())), F.lit(0.0)) / F.greatest(F.sum("mask"), F.lit(1))
    seq = attach_sequence(tokens, mean.alias("__seq"))
    adv = F.col("advantage")
    ratio = F.exp(F.least(F.col("__seq"), F.lit(10.0)))
    plain = -adv * ratio
    clipped = -adv * F.greatest(F.lit(1 - clip_lo), F.least(F.lit(1 + clip_hi), ratio))
    return aggregate_loss(
        seq.withColumn("token_loss", _weighted(tokens, F.greatest(plain, clipped))),
        "seq-mean-token-mean",
        [("pg_clipfrac", _flag(clipped > plain)), ("ppo_kl", -_delta())],
    )


@register_loss("gpg")
def gpg_loss(tokens: DataFrame, mode: str = "token-mean") -> DataFrame:
    loss = -F.col("log_prob") * F.col("advantage")
    return aggregate_loss(tokens.withColumn("token_loss", _weighted(tokens, loss)), mode)


def _picked(tokens: DataFrame, chosen: DataFrame) -> DataFrame:
    marks = chosen.select("seq_id", "pos", F.lit(True).alias("__picked"))
    joined = tokens.join(marks, ["seq_id", "pos"], "left")
    return joined.withColumn("__picked", F.coalesce("__picked", F.lit(False)))


@register_loss("clip_cov")
def clip_cov_loss(
    tokens: DataFrame,
    ratio: float = 0.0002,
    lb: float = 1.0,
    ub: float = 5.0,
    clip_lo: float = 0.2,
    clip_hi: float = 0.2,
    mode: str = "token-mean",
    seed: int = 0,
) -> DataFrame:
    """A share of the tokens with covariance in (lb, ub) gets weight zero.

    Which ones is decided by a hash of token and seed instead of a random
    permutation; tokens already clipped are not candidates.
    """
    adv = F.col("advantage")
    rho = F.exp(_delta())
    plain = -adv * rho
    clipped = -adv * F.greatest(F.lit(1 - clip_lo), F.least(F.lit(1 + clip_hi), rho))
    scored, n = with_covariance(tokens, "__cov")
    band = (F.col("__cov") > lb) & (F.col("__cov") < ub) & (F.col("mask") > 0) & ~(clipped > plain)
    draw = hash48(F.col("seq_id"), F.col("pos"), F.lit(seed))
    candidates = scored.where(band).select("seq_id", "pos", draw.alias("__draw"))
    chosen = take_largest(candidates, "__draw", ["seq_id", "pos"], max(1, int(n * ratio)))
    marked = _picked(scored, chosen)
    loss = F.when(F.col("__picked"), F.lit(0.0)).otherwise(F.greatest(plain, clipped))
    return aggregate_loss(
        marked.withColumn("token_loss", _weighted(tokens, loss)),
        mode,
        [("pg_clipfrac", _flag(F.col("__picked"))), ("ppo_kl", -_delta())],
    )


@register_loss("kl_cov")
def kl_cov_loss(tokens: DataFrame, ratio: float = 0.0002, coef: float = 1.0, mode: str = "token-mean") -> DataFrame:
    """The tokens of largest covariance get a coef·|KL| penalty."""
    scored, n = with_covariance(tokens, "__cov")
    candidates = scored.where(F.col("mask") > 0).select("seq_id", "pos", "__cov")
    chosen = take_largest(candidates, "__cov", ["seq_id", "pos"], max(1, int(n * ratio)))
    marked = _picked(scored, chosen)
    plain = -F.col("advantage") * F.exp(_delta())
    loss = plain + F.when(F.col("__picked"), coef * F.abs(_delta())).otherwise(F.lit(0.0))
    return aggregate_loss(
        marked.withColumn("token_loss", _weighted(tokens, loss)), mode, [("ppo_kl", F.abs(_delta()))]
    )


@register_loss("geo_mean")
def geo_mean_loss(tokens: DataFrame, clip_lo: float = 0.2, clip_hi: float = 0.2) -> DataFrame:
    """Geometric mean ratio per sequence with a sign-aware clip."""
    adv, delta, m = F.col("advantage"), _delta(), F.col("mask")
    bounded = F.greatest(F.lit(-clip_lo), F.least(F.lit(clip_hi), delta))
    sign = F.signum(adv)
    cut = sign * F.least(sign * delta, sign * bounded)
    clipped = F.col("mask") * (delta != bounded).cast("int")
    sums = [
        F.sum(cut * m).alias("cut"),
        F.sum(adv * m).alias("adv"),
        F.sum(m).alias("n"),
        F.sum(delta * m).alias("delta"),
        F.sum(clipped * (adv > 0).cast("int")).alias("hi"),
        F.sum(clipped * (adv < 0).cast("int")).alias("lo"),
    ]
    if "is_weight" in tokens.columns:
        sums.append(F.sum(F.ln(F.col("is_weight") + 1e-10) * m).alias("w"))
    n = F.col("n") + MEAN_EPS
    loss = -(F.col("adv") / n) * F.exp(F.col("cut") / n)
    if "is_weight" in tokens.columns:
        loss = loss * F.exp(F.col("w") / n)
    total = F.sum("n") + MEAN_EPS
    return tokens.groupBy("seq_id").agg(*sums).agg(
        F.avg(loss).alias("loss"),
        (F.sum("hi") / total).alias("pg_clipfrac"),
        (-F.sum("delta") / total).alias("ppo_kl"),
        (F.sum("lo") / total).alias("pg_clipfrac_lower"),
    )


@register_loss("reinforce")
def reinforce_loss(tokens: DataFrame, mode: str = "token-mean") -> DataFrame:
    loss = -F.col("advantage") * F.col("log_prob")
    divergence = F.col("rollout_log_prob") - F.col("log_prob")
    return aggregate_loss(tokens.withColumn("token_loss", _weighted(tokens, loss)), mode, [("ppo_kl", divergence)])


@register_loss("bypass_mode")
def bypass_loss(
    tokens: DataFrame,
    loss_type: str = "ppo_clip",
    is_level: str | None = None,
    is_threshold: float = 2.0,
    rs_level: str | None = None,
    rs_upper: float = 2.0,
    rs_lower: float | None = None,
    veto: float | None = None,
    mode: str = "token-mean",
    **options,
) -> DataFrame:
    """Rollout log-probs act as the old policy; rejected tokens are masked.

    Importance weights only enter the ``reinforce`` form, never a ratio clip.
    """
    if loss_type not in ("reinforce", "ppo_clip"):
        raise ValueError(f"unknown bypass loss {loss_type!r}")
    behaviour = F.col("rollout_log_prob")
    current = tokens.withColumn("old_log_prob", F.col("log_prob"))
    fixed = rollout_correction(current, is_level, is_threshold, rs_level, rs_upper, rs_lower, veto)
    fixed = fixed.withColumn("mask", F.col("kept_mask")).withColumn("old_log_prob", behaviour).drop("kept_mask")
    if loss_type == "reinforce":
        return reinforce_loss(fixed, mode)
    return ppo_loss(fixed.drop("is_weight"), mode=mode, **options)


def value_loss(tokens: DataFrame, clip_range: float = 0.5, mode: str = "token-mean") -> DataFrame:
    """Clipped value loss; new predictions are in ``vpred``."""
    bounded = F.greatest(F.col("value") - clip_range, F.least(F.col("value") + clip_range, F.col("vpred")))
    free = F.pow(F.col("vpred") - F.col("return"), F.lit(2.0))
    held = F.pow(bounded - F.col("return"), F.lit(2.0))
    out = aggregate_loss(
        tokens.withColumn("token_loss", F.greatest(free, held)), mode, [("vf_clipfrac", _flag(held > free))]
    )
    return out.withColumn("loss", 0.5 * F.col("loss"))


def sft_nll(tokens: DataFrame, shift: bool = False) -> DataFrame:
    """−Σ logp·mask / valid tokens; ``shift`` moves the mask one place left."""
    source = tokens
    if shift:
        ahead = tokens.select("seq_id", (F.col("pos") - 1).alias("pos"), F.col("mask").alias("__next"))
        source = tokens.join(ahead, ["seq_id", "pos"], "left").withColumn("mask", F.coalesce("__next", F.lit(0)))
    return source.agg((-F.sum(F.col("log_prob") * F.col("mask")) / F.sum("mask")).alias("loss"))


def entropy_mean(tokens: DataFrame, mode: str = "token-mean") -> DataFrame:
    """Aggregated logged per-token entropy."""
    return aggregate_loss(tokens, mode, col="entropy").withColumnRenamed("loss", "entropy")


def policy_objective(
    tokens: DataFrame,
    loss: str = "vanilla",
    entropy_coef: float = 0.0,
    kl_coef: float = 0.0,
    kl_kind: str = "k3",
    mode: str = "token-mean",
    **options,
) -> DataFrame:
    """Policy loss − c_e·entropy + c_kl·KL, all aggregated the same way."""
    pg = policy_loss(tokens, loss, mode=mode, **options).select(F.col("loss").alias("pg_loss"))
    ent = entropy_mean(tokens, mode)
    divergence = kl(F.col("log_prob"), F.col("ref_log_prob"), kl_kind)
    kls = aggregate_loss(tokens.withColumn("token_loss", divergence), mode).select(F.col("loss").alias("kl_loss"))
    one = F.lit(1).alias("__one")
    joined = pg.select("*", one).join(ent.select("*", one), "__one").join(kls.select("*", one), "__one")
    total = F.col("pg_loss") - entropy_coef * F.col("entropy") + kl_coef * F.col("kl_loss")
    return joined.select(total.alias("objective"), "pg_loss", "entropy", "kl_loss")


def kl_controller(
    steps: DataFrame, beta0: float, target: float, horizon: float, mode: str = "adaptive", run: str = "run"
) -> DataFrame:
    """Divergence coefficient after each step of a run.

    Each step multiplies it by ``1 + clip(KL/target − 1, ±0.2)·n/horizon``; the
    product over steps is a running sum of logarithms. One row per step, so a
    run's window is as long as the run has steps.
    """
    if mode == "fixed":
        return steps.withColumn("beta", F.lit(float(beta0)))
    error = clip(F.col("kl") / target - 1, -0.2, 0.2)
    factor = 1 + error * F.col("n_steps") / horizon
    along = W.partitionBy(run).orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps.withColumn("beta", beta0 * F.exp(F.sum(F.ln(factor)).over(along)))
