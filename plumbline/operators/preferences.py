"""Comparisons between the responses of one prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.basics import log_sigmoid, sigmoid
from plumbline.operators.scale import attach_group, match, ordered, running_sum, with_group_stats, written


def mark_chosen(rollouts: DataFrame, score: str = "score") -> DataFrame:
    """``chosen`` for the best response of a prompt, the first on ties."""
    best = F.max(F.struct(F.col(score), (-F.col("seq_id")).alias("neg_id"))).alias("__best")
    marked = with_group_stats(rollouts, ["uid"], [best], ["seq_id"])
    return marked.withColumn("chosen", F.col("seq_id") == -F.col("__best.neg_id")).drop("__best")


def preference_pairs(rollouts: DataFrame, score: str = "score") -> DataFrame:
    """One row per prompt: its best response and its worst other one."""
    top = F.struct(F.col(score).alias("s"), (-F.col("seq_id")).alias("i"))
    low = F.struct(F.col(score).alias("s"), (-F.col("seq_id")).alias("i"))
    ends = rollouts.groupBy("uid").agg(
        F.max(top).alias("t"), F.min(low).alias("b"), F.count(F.lit(1)).alias("n")
    )
    return ends.where("n > 1").select(
        "uid",
        (-F.col("t.i")).alias("chosen_id"),
        F.col("t.s").alias("chosen_score"),
        (-F.col("b.i")).alias("rejected_id"),
        F.col("b.s").alias("rejected_score"),
    )


def preference_loss(
    pairs: DataFrame, beta: float = 0.1, kind: str = "sigmoid", smoothing: float = 0.0, reference_free: bool = False
) -> DataFrame:
    """Mean DPO (sigmoid, optionally smoothed) or IPO loss over pairs.

    Columns: ``policy_chosen, policy_rejected, ref_chosen, ref_rejected``.
    """
    reference = F.lit(0.0) if reference_free else F.col("ref_chosen") - F.col("ref_rejected")
    logits = F.col("policy_chosen") - F.col("policy_rejected") - reference
    if kind == "sigmoid":
        loss = -(1 - smoothing) * log_sigmoid(beta * logits) - smoothing * log_sigmoid(-beta * logits)
    elif kind == "ipo":
        loss = F.pow(logits - 1 / (2 * beta), F.lit(2.0))
    else:
        raise ValueError(f"unknown preference loss {kind!r}")
    return pairs.agg(F.avg(loss).alias("loss"), F.avg(logits).alias("mean_logits"))


def pairwise_preference_accuracy(
    rollouts: DataFrame, uid: str = "uid", score: str = "score", acc: str = "acc", order: str = "seq_id"
) -> DataFrame:
    """Agreement of score order with accuracy order over all i<j pairs.

    A pair weighs |Δacc|; a prompt whose accuracies are all equal counts 0.5.
    Pairs are not formed. A pair with equal accuracies weighs nothing. Of the
    others, with accuracies a < b, "score of i above score of j" must agree with
    "accuracy of i above accuracy of j": when the better response comes first it
    must score strictly higher, when it comes second it must not score lower.

    So among rows put in order of score, then position, the better response of a
    pair must come later: the agreeing weight is that of the pairs in order.
    Accuracies may take any number of values. Each gets its rank within the
    prompt; two ranks part at one binary digit, the smaller one having 0 there.
    So every row is listed once per digit, under the digits in front of it, and
    a row with digit 1 counts the rows with digit 0 before it, which is a merge of
    two halves of the ranks. Rows are put in order once, as a written table cut
    into buckets; a running total crosses buckets by their sums.
    """
    base = rollouts.select(uid, F.col(score).alias("s"), F.col(acc).cast("double").alias("a"), F.col(order).alias("o"))
    return _pair_agreement(base, uid).agg(F.avg("accuracy").alias("accuracy"))


def _pair_agreement(base: DataFrame, uid: str) -> DataFrame:
    rows = ordered(base, [uid, "s", "o"], "pair-rows")
    sizes = ordered(rows.groupBy(uid, "a").agg(F.count(F.lit(1)).alias("__n")), [uid, "a"], "pair-sizes")
    sizes = sizes.withColumns({"__na": F.col("__n") * F.col("a"), "__one": F.lit(1)})
    before = {"__rank": "__one", "__fewer": "__n", "__fewer_a": "__na"}
    ranks = written(running_sum(sizes, [uid], "__bucket", [F.col("a")], before, inclusive=False).drop("__bucket", "__one"), "pair-ranks")
    weight = ranks.groupBy(uid).agg(
        F.sum(F.col("__na") * F.col("__fewer") - F.col("__n") * F.col("__fewer_a")).alias("weight"), F.max("__rank").cast("long").alias("__top")
    )
    tops = match(ranks.select(uid, "a", "__n", F.col("__rank").cast("long").alias("__rank")), weight.select(uid, "__top"), [uid])
    placed = written(attach_group(rows, tops, [uid, "a"], "__n", ["o"]).where("__top > 0"), "pair-placed")
    listed = placed.withColumn("__digit", F.explode(F.sequence(F.lit(0), F.length(F.bin("__top")) - 1)))
    listed = listed.withColumns(
        {
            "__front": F.expr("shiftright(__rank, __digit + 1)"),
            "__zero": F.expr("1 - (shiftright(__rank, __digit) & 1)"),
        }
    ).withColumn("__a0", F.col("__zero") * F.col("a"))
    earlier = {"__below": "__zero", "__below_a": "__a0"}
    merged = running_sum(listed, [uid, "__digit", "__front"], "__bucket", [F.col("s"), F.col("o")], earlier, inclusive=False)
    gain = F.col("a") * F.col("__below") - F.col("__below_a")
    agreed = merged.where("__zero = 0").groupBy(uid).agg(F.sum(gain).alias("agree"))
    return match(weight, agreed, [uid], "left").select(
        uid, F.when(F.col("weight") > 0, F.col("agree") / F.col("weight")).otherwise(F.lit(0.5)).alias("accuracy")
    )


def implicit_rm_loss(
    rollouts: DataFrame, beta: float = 0.05, mode: str = "ce", bon: str = "none", score: str = "score", acc: str = "acc"
) -> DataFrame:
    """Loss of an implicit reward model and its sign accuracy.

    ``ce``: cross-entropy of σ(βQ) with the accuracy. ``pairwise``: −log σ of
    the distance to the mean Q of opposite-accuracy siblings (0/1 accuracies).
    ``bon`` weighs a response by the chance of being best of n, by accuracy.
    """
    q, y = F.col(score), F.col(acc).cast("double")
    hit = (F.signum(q) == F.signum(2 * y - 1)).cast("double")
    if mode == "ce":
        p = sigmoid(beta * q)
        loss = -(y * F.greatest(F.ln(p), F.lit(-100.0)) + (1 - y) * F.greatest(F.ln(1 - p), F.lit(-100.0)))
        return rollouts.agg(F.avg(loss).alias("loss"), F.avg(hit).alias("sign_accuracy"))
    if mode != "pairwise":
        raise ValueError(f"unknown implicit reward loss {mode!r}")
    aggs = [
        F.avg(F.when(y > 0, q)).alias("__right"),
        F.avg(F.when(y <= 0, q)).alias("__wrong"),
        F.avg(y).alias("__rate"),
        F.count(F.lit(1)).alias("__n"),
    ]
    grouped = with_group_stats(rollouts, ["uid"], aggs, ["seq_id"])
    other = F.coalesce(F.when(y > 0, F.col("__wrong")).otherwise(F.col("__right")), F.lit(0.0))
    loss = -log_sigmoid(beta * (q - other) * F.when(y > 0, 1.0).otherwise(-1.0))
    if bon == "none":
        total = F.avg(loss)
    elif bon == "bon_acc":
        share = F.when(y > 0, F.lit(1.0)).otherwise(1 - F.col("__rate"))
        total = F.sum(loss * F.col("__n") * F.pow(share, F.col("__n") - 1))
    else:
        raise ValueError(f"unknown best-of-n weighting {bon!r}")
    return grouped.agg(total.alias("loss"), F.avg(hit).alias("sign_accuracy"))


def sppo_loss(seq: DataFrame, eta: float = 1.0) -> DataFrame:
    """Mean of (Σlogp − Σold − η·r)² over sequences with a valid token.

    One row per sequence: ``log_prob_sum, old_log_prob_sum, score, n_valid``.
    """
    gap = F.col("log_prob_sum") - F.col("old_log_prob_sum") - eta * F.col("score")
    return seq.where(F.col("n_valid") > 0).agg(F.avg(F.pow(gap, F.lit(2.0))).alias("loss"))


def dpo_metrics(rollouts: DataFrame) -> DataFrame:
    """Score and reward statistics, logits and lengths of a preference batch."""
    stats = []
    for name in ("score", "reward", "prompt_length", "response_length"):
        stats += [
            F.avg(name).alias(f"{name}_mean"),
            F.max(name).alias(f"{name}_max"),
            F.min(name).alias(f"{name}_min"),
        ]
    return rollouts.agg(
        *stats,
        F.avg(F.when(F.col("chosen"), F.col("log_prob_sum"))).alias("chosen_logp_mean"),
        F.avg(F.when(~F.col("chosen"), F.col("log_prob_sum"))).alias("rejected_logp_mean"),
        (
            F.avg(F.when(F.col("chosen"), F.col("log_prob_sum") - F.col("ref_log_prob_sum")))
            - F.avg(F.when(~F.col("chosen"), F.col("log_prob_sum") - F.col("ref_log_prob_sum")))
        ).alias("logits_mean"),
    )
