"""Draws with replacement: multinomial counts and weighted resampling."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import draws, sampling, validation


def exact_inverse(n, p, u):
    below = 0.0
    for x in range(n + 1):
        below += math.comb(n, x) * p**x * (1 - p) ** (n - x)
        if u < below:
            return x
    return n


def test_binomial_inverts_its_distribution(spark):
    cases = [(n, p, u) for n in (0, 1, 2, 7, 40, 300) for p in (0.0, 0.001, 0.3, 0.5, 0.77, 1.0) for u in (0.0, 0.013, 0.37, 0.61, 0.999)]
    df = spark.createDataFrame(cases, "n long, p double, u double")
    got = df.withColumn("x", draws.binomial(F.col("n"), F.col("p"), F.col("u"), F.lit(0.25))).collect()
    for r in got:
        want = exact_inverse(r.n, r.p, r.u) if r.p <= 0.5 else r.n - exact_inverse(r.n, 1 - r.p, r.u)
        assert r.x == want, r


@pytest.mark.parametrize("n, p", [(5000, 0.5), (10**9, 0.25), (10**12, 0.999)])
def test_binomial_moments_when_large(spark, n, p):
    grid = spark.range(20000).select(((F.col("id") + 0.5) / 20000).alias("u"), (F.pmod(F.col("id") * 7919, F.lit(20000)) / 20000).alias("t"))
    rows = grid.select(F.lit(n).cast("long").alias("n"), F.lit(p).alias("p"), "u", "t").repartition(2)
    got = rows.select(draws.binomial(F.col("n"), F.col("p"), F.col("u"), F.col("t")).cast("double").alias("x")).agg(F.avg("x"), F.stddev_pop("x")).first()
    sd = math.sqrt(n * p * (1 - p))
    assert abs(got[0] - n * p) < 0.02 * sd + 0.6 and abs(got[1] / sd - 1) < 0.02


@pytest.mark.parametrize("leaf", [64, 3])
def test_multinomial_counts_add_up(spark, monkeypatch, leaf):
    monkeypatch.setattr(draws, "LEAF", leaf)
    weights = {"a": 1, "b": 2, None: 3, "d": 4, "e": 0.5, "f": 1.5, "g": 8, "h": 5, "i": 7, "j": 8}
    values = [(k, v, float(w)) for k in ("x", None) for v, w in weights.items()] + [("y", "only", 3.0)]
    asked = [(k, d, n) for k in ("x", "y", None, "none") for d, n in enumerate([0, 1, 6, 400] * 60)]
    frame = spark.createDataFrame(values, "key string, v string, c double")
    requests = spark.createDataFrame(asked, "key string, d long, n long")
    got = draws.multinomial(frame, requests, ["key"], "v").collect()
    drawn = Counter()
    for r in got:
        drawn[r.key, r.d] += r.x
        assert r.x > 0
    assert drawn == {(k, d): n for k, d, n in asked if n and k != "none"}
    whole = Counter()
    for r in got:
        if r.key == "x":
            whole[r.v] += r.x
    total, weight = sum(whole.values()), sum(weights.values())
    for v, w in weights.items():
        mean = total * w / weight
        assert abs(whole[v] - mean) < 5 * math.sqrt(mean)


def test_bootstrap_of_a_hot_group_does_not_grow_with_it(spark):
    rows = spark.range(4096).select(F.lit("s").alias("data_source"), F.lit(1).alias("uid"), (F.col("id") % 2).cast("double").alias("v"), F.lit("p").alias("pred"))
    got = {r.k: r for r in validation.bootstrap(rows, "v", draws=50, keys=["uid"]).collect()}
    assert sorted(got) == [2**i for i in range(1, 13)]
    assert abs(got[4096].mean_mean - 0.5) < 0.005 and abs(got[4096].mean_std - 0.0078) < 0.003
    assert abs(got[2].best_mean - 0.75) < 0.2 and got[4096].best_mean == 1.0 and got[4096].worst_mean == 0.0
    voted = {r.metric: r.value for r in validation.majority_at(rows, "v", "pred", 50, 1).collect()}
    assert abs(voted["maj@4096/mean"] - 0.5) < 0.25 and set(voted) >= {"maj@2/mean", "maj@2/std"}


@pytest.mark.parametrize("rows", [1_000_000, 40])
def test_resample_with_one_item_of_most_weight(spark, rows):
    weights = {i: 1.0 + i % 3 for i in range(999)}
    weights[500] = 9 * sum(w for i, w in weights.items() if i != 500)
    frame = spark.createDataFrame([(i, math.sqrt(w), f"t{i}") for i, w in weights.items()], "seq_id long, score double, at string").repartition(3)
    got = sampling.pf_resample(frame, "pow", 2.0, seed=3, rows=rows)
    assert got.columns == ["draw", "seq_id", "score", "at"]
    drawn = got.collect()
    assert sorted(r.draw for r in drawn) == list(range(999)) and all(r["at"] == f"t{r.seq_id}" for r in drawn)
    count = Counter(r.seq_id for r in drawn)
    assert abs(count[500] - 899) < 50 and len(count) > 60
    third = [sum(n for i, n in count.items() if i != 500 and i % 3 == k) for k in range(3)]
    assert third[2] > third[0]


def test_resample_of_equal_weights_and_single_rows(spark):
    one = spark.createDataFrame([(7, 0.0)], "seq_id long, score double")
    assert [tuple(r) for r in sampling.pf_resample(one).collect()] == [(0, 7, 0.0)]
    many = spark.range(3000).select(F.col("id").alias("seq_id"), F.lit(2.0).alias("score"))
    count = Counter(r.seq_id for r in sampling.pf_resample(many, "max_random", rows=500).collect())
    assert sum(count.values()) == 3000 and abs(len(count) / 3000 - 0.632) < 0.04 and max(count.values()) < 12
    assert sampling.pf_resample(many.where("false")).count() == 0
