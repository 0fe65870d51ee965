"""Hand-worked calibration, vote, group and token results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import advantages as A
from plumbline.operators import calibration as C
from plumbline.operators import preferences, risk, validation, votes

FIVE = [(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 0), (0.0, 0)]


def preds(spark, rows):
    return spark.createDataFrame(rows, "confidence DOUBLE, correct INT")


def test_calibration_report(spark):
    row = C.calibration_report(preds(spark, FIVE)).first().asDict()
    want = {
        "brier": 0.156,
        "nll": 0.458923,
        "auc": 0.916667,
        "abstention_accuracy": 0.8,
        "predictive_accuracy": 0.4,
        "smooth_ece": 0.187439,
        "snr_gain": 0.833104,
    }
    assert {k: round(row[k], 6) for k in want} == want
    assert C.ece(preds(spark, FIVE)).first().ece == pytest.approx(0.2)


def test_calibration_edges(spark):
    assert C.confidence_auc(preds(spark, [(0.2, 1), (0.7, 1)])).first().auc == 0.5
    same = preds(spark, [(0.6, 1), (0.6, 0)])
    assert C.smoothed_ece(same).first().smooth_ece == pytest.approx(C.ece(same).first().ece)
    assert C.snr_gain(preds(spark, [(0.6, 1)])).first().snr_gain == 0.0
    assert C.ece(preds(spark, [(0.0, 0), (0.0, 1)])).first().ece == pytest.approx(0.5)


def test_auc_of_flipped_confidence(spark):
    rng = random.Random(1)
    rows = [(rng.random(), rng.randint(0, 1)) for _ in range(200)]
    auc = C.confidence_auc(preds(spark, rows)).first().auc
    flipped = C.confidence_auc(preds(spark, [(1 - c, y) for c, y in rows])).first().auc
    assert auc + flipped == pytest.approx(1.0)


def test_summary_does_not_depend_on_partitions(spark):
    rows = [((i * 37 % 101) / 101, i * 7 % 3 % 2) for i in range(500)]
    a = C.prediction_summary(preds(spark, rows)).first().asDict()
    b = C.prediction_summary(preds(spark, rows).repartition(13)).first().asDict()
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_risk_sweep_needs_a_threshold(spark):
    df = spark.createDataFrame([(None, False, 1)], "risk_t DOUBLE, abstained BOOLEAN, correct INT")
    rows = spark.createDataFrame([(0.5, False, 1), (0.0, False, 0)], "risk_t DOUBLE, abstained BOOLEAN, correct INT")
    assert risk.risk_sweep(rows, rows.where("risk_t = 0")).first().snr_gain is None
    with pytest.raises(Exception, match="no row states risk_t"):
        risk.risk_sweep(df).collect()


SAMPLES = "question_id BIGINT, sample_idx BIGINT, answer STRING, confidence DOUBLE, is_correct INT"


def test_votes(spark):
    df = spark.createDataFrame([(1, 0, "A", 0.2, 1), (1, 1, "B", 0.9, 0), (1, 2, "A", 0.3, 1)], SAMPLES)
    major, weighted, top = (v(df).first() for v in (votes.vote_majority, votes.vote_weighted, votes.vote_max_confidence))
    assert (major.answer, round(major.score, 6)) == ("A", 0.666667)
    assert (weighted.answer, round(weighted.score, 6)) == ("B", 0.3)
    assert top.answer == "B"


def test_vote_ties_and_blanks(spark):
    df = spark.createDataFrame([(1, 0, "A", 0.5, 1), (1, 1, "B", 0.5, 0), (1, 2, "", 0.9, 0)], SAMPLES)
    row = votes.vote_majority(df).first()
    assert (row.answer, round(row.score, 6)) == ("A", 0.333333)


def rollouts(spark, scores, lengths=None):
    rows = [(i, 1, float(s), lengths[i] if lengths else 1) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "seq_id BIGINT, uid BIGINT, score DOUBLE, response_length BIGINT")


def adv(df, name, **options):
    return [round(r.advantage, 6) for r in A.advantage(df, name, **options).orderBy("seq_id").collect()]


def test_group_advantages(spark):
    four = rollouts(spark, [1, 0, 0, 1])
    assert adv(four, "grpo") == [0.866024, -0.866024, -0.866024, 0.866024]
    assert adv(four, "rloo") == [0.666667, -0.666667, -0.666667, 0.666667]
    assert adv(rollouts(spark, [1, 0.5, 0.2]), "grpo_passk") == [1.237176, 0.0, 0.0]
    assert adv(rollouts(spark, [1, 0.5, 0.2], [10, 20, 30]), "opo") == [0.566667, 0.066667, -0.233333]


def test_singletons(spark):
    alone = rollouts(spark, [0.7])
    assert adv(alone, "grpo") == [round(0.7 / (1 + 1e-6), 6)]
    assert adv(alone, "rloo") == [0.7]
    assert adv(alone, "rloo_vectorized") == [0.0]
    assert adv(alone, "opo") == [0.7]
    with pytest.raises(Exception, match="at least two"):
        adv(alone, "grpo_passk")


def tokens(spark, rewards, values, mask):
    rows = [(1, i, r, v, m) for i, (r, v, m) in enumerate(zip(rewards, values, mask))]
    return spark.createDataFrame(rows, "seq_id BIGINT, pos BIGINT, reward DOUBLE, value DOUBLE, mask INT")


def gae_returns(df, **options):
    out = A.gae(df, **options).orderBy("pos").collect()
    return [r["return"] - r["value"] for r in out]


def test_gae_before_whitening(spark):
    got = gae_returns(tokens(spark, [0.0, 0.0, 1.0], [0.1, 0.2, 0.3], [1, 1, 1]), gamma=0.9, lam=0.95)
    assert [round(g, 6) for g in got] == [0.651567, 0.6685, 0.7]


def test_gae_ignores_values_on_masked_tokens(spark):
    rng = random.Random(3)
    mask = [1, 1, 0, 0, 1, 1, 0, 1, 1, 0, 1]
    rewards = [rng.random() * m for m in mask]
    values = [rng.random() for _ in mask]
    noisy = [v if m else rng.random() for v, m in zip(values, mask)]
    a = gae_returns(tokens(spark, rewards, values, mask), gamma=0.8, lam=0.6)
    b = gae_returns(tokens(spark, rewards, noisy, mask), gamma=0.8, lam=0.6)
    assert all(x == pytest.approx(y) for x, y, m in zip(a, b, mask) if m)


def test_best_of_n_closed_form(spark):
    rows = [("s", 1, i, float(v)) for i, v in enumerate([0, 0, 1])]
    df = spark.createDataFrame(rows, "data_source STRING, uid BIGINT, seq_id BIGINT, score DOUBLE")
    got = {r.metric: r.value for r in validation.validation_metrics(df, ["score"]).collect()}
    assert got["best@2/mean"] == pytest.approx(0.555556, abs=1e-6)
    assert got["mean@3"] == pytest.approx(1 / 3)


def test_pair_accuracy_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(u, i, float(rng.randint(0, 3)), float(rng.randint(0, 1))) for u in range(6) for i in range(7)]
    # More distinct accuracies than any fixed number of levels, and a prompt without differences.
    rows += [(6, i, float(rng.randint(0, 9)), rng.random()) for i in range(60)] + [(7, i, float(i), 0.5) for i in range(3)]
    df = spark.createDataFrame(rows, "uid BIGINT, seq_id BIGINT, score DOUBLE, acc DOUBLE")
    per = []
    for u in range(8):
        group = [r for r in rows if r[0] == u]
        hit = weight = 0.0
        for i in range(len(group)):
            for j in range(i + 1, len(group)):
                d = group[i][3] - group[j][3]
                weight += abs(d)
                hit += abs(d) * ((group[i][2] - group[j][2] > 0) == (d > 0))
        per.append(hit / weight if weight else 0.5)
    got = preferences.pairwise_preference_accuracy(df).first().accuracy
    assert got == pytest.approx(sum(per) / len(per))


def test_registry_rejects_a_second_function():
    from plumbline.operators.registry import Registry

    names = Registry("thing")
    names.register("a")(math.sqrt)
    with pytest.raises(ValueError):
        names.register("a")(math.exp)
    with pytest.raises(ValueError):
        names.get("A")


def test_clip_cov_only_lowers_weights(spark):
    from plumbline.operators import losses

    rows = [(1, i, 1, -0.1 * i, -0.1 * i + 0.01, (i - 5) / 5.0, -0.1 * i) for i in range(11)]
    df = spark.createDataFrame(
        rows, "seq_id BIGINT, pos BIGINT, mask INT, log_prob DOUBLE, old_log_prob DOUBLE, advantage DOUBLE, rollout_log_prob DOUBLE"
    )
    row = losses.policy_loss(df, "clip_cov", ratio=0.2, lb=-5.0, ub=5.0).first()
    assert row.pg_clipfrac == pytest.approx(2 / 11)
    assert df.agg(F.count("*")).first()[0] == 11


def test_moments_keep_their_digits_under_a_large_offset(spark):
    rows = [(0, 1e8, 10), (1, 1e8 + 1, 10)]
    white = A.whiten(spark.createDataFrame(rows, "seq_id long, x double, w long"), "x", "out", weight="w").orderBy("seq_id").collect()
    assert abs(white[0].out + math.sqrt(19 / 20)) < 1e-6 and abs(white[1].out - math.sqrt(19 / 20)) < 1e-6
    df = spark.createDataFrame([("s", 1, 1e9 + i) for i in range(2)], "data_source string, uid int, v double")
    got = {r.metric: r.value for r in validation.validation_metrics(df, ["v"]).collect()}
    assert got["std@2"] == 0.5 and abs(got["best@2/std"] - math.sqrt(3 / 16)) < 1e-12 and got["best@2/mean"] == 1e9 + 0.75
