"""Skew-proof helpers against plain loops, with hot keys forced."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import balancing, calibration, filters, retrieval, risk, sampling, scale, tokens
from plumbline.operators.scale import attach_group, backward_scan, row_index, running_sum, with_group_stats


def skewed(spark, n=900):
    """One key holds a third of the rows."""
    rows = [(i, 0 if i % 3 == 0 else i % 50 + 1, float(i % 11)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id BIGINT, k BIGINT, v DOUBLE")


def test_group_stats_with_hot_key(spark):
    rows, df = skewed(spark)
    got = with_group_stats(df, ["k"], [F.sum("v").alias("s")], ["id"], hot_floor=20, hot_share=0.01)
    sums = {}
    for _, k, v in rows:
        sums[k] = sums.get(k, 0.0) + v
    assert sorted((r.id, r.s) for r in got.collect()) == [(i, sums[k]) for i, k, _ in rows]


def test_hot_key_is_spread(spark):
    """The most rows that meet one stats row do not grow with the key."""
    for n in (900, 3600):
        _, df = skewed(spark, n)
        stats = df.groupBy("k").agg(F.count("*").alias("n"))
        joined = attach_group(df, stats, ["k"], "n", ["id"], hot_floor=40)
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert "__salt" in plan and joined.count() == n
        salts = F.ceil(F.lit(n / 3) / 40)
        most = df.where("k = 0").groupBy(F.pmod(F.xxhash64("id"), salts)).count().agg(F.max("count")).first()[0]
        assert most < 100


def test_null_keys_form_a_group(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (3, "a", 5.0)], "id BIGINT, k STRING, v DOUBLE")
    got = with_group_stats(df, ["k"], [F.sum("v").alias("s")], ["id"])
    assert sorted((r.id, r.s) for r in got.collect()) == [(1, 4.0), (2, 4.0), (3, 5.0)]


def test_null_groups_keep_their_metrics(spark):
    rows = [(None, 0.9, True), (None, 0.2, False), ("a", 0.8, False), ("a", 0.6, True)]
    df = spark.createDataFrame(rows, "data_source STRING, confidence DOUBLE, correct BOOLEAN")
    named = df.withColumn("data_source", F.coalesce("data_source", F.lit("none")))
    for metric in (calibration.calibration_report, calibration.confidence_auc, calibration.snr_gain, calibration.smoothed_ece):
        with_null = {r[0] or "none": tuple(r)[1:] for r in metric(df, ["data_source"]).collect()}
        assert with_null == {r[0]: pytest.approx(tuple(r)[1:]) for r in metric(named, ["data_source"]).collect()}
    swept = {(r.data_source or "none", r.t): r.abstention_rate for r in risk.adaptive_risk(df, [0.5], ["data_source"]).collect()}
    assert swept == {("none", 0.5): 0.5, ("a", 0.5): 0.0}


def test_finer_buckets_keep_the_order(spark, monkeypatch):
    monkeypatch.setattr(scale, "MAX_EDGES", 4)
    monkeypatch.setattr(scale, "ROWS_PER_BUCKET", 10)
    cut = scale.range_bucket(spark.range(500).withColumn("v", F.col("id") * F.col("id")), "v", "b")
    rows = sorted((r.v, r.b) for r in cut.collect())
    assert [b for _, b in rows] == sorted(b for _, b in rows) and len({b for _, b in rows}) > 20


def test_running_sum_over_buckets(spark):
    rows, df = skewed(spark, 300)
    cut = df.withColumn("b", F.floor(F.col("id") / 7))
    got = running_sum(cut, ["k"], "b", [F.col("id")], {"t": "v"})
    seen, want = {}, []
    for i, k, v in rows:
        seen[k] = seen.get(k, 0.0) + v
        want.append((i, seen[k]))
    assert sorted((r.id, r.t) for r in got.collect()) == want


def test_backward_scan_across_chunks(spark):
    rng = random.Random(2)
    rows = [(s, p, rng.random(), rng.random()) for s, n in ((1, 23), (2, 1), (3, 9)) for p in range(n)]
    df = spark.createDataFrame(rows, "seq_id BIGINT, pos BIGINT, a DOUBLE, b DOUBLE")
    want = {}
    for s in (1, 2, 3):
        state = 0.0
        for _, p, a, b in sorted((r for r in rows if r[0] == s), reverse=True):
            state = a * state + b
            want[s, p] = round(state, 9)
    for levels in (1, 2, 3):
        got = backward_scan(df, ["seq_id"], "pos", F.col("a"), F.col("b"), "s", chunk=3, levels=levels)
        assert {(r.seq_id, r.pos): round(r.s, 9) for r in got.collect()} == want


def test_backward_scan_with_helper_across_chunks(spark):
    rows = [(1, p, float(p % 3), float(p % 2)) for p in range(20)]
    df = spark.createDataFrame(rows, "seq_id BIGINT, pos BIGINT, v DOUBLE, m DOUBLE")
    m, v = F.col("m"), F.col("v")
    got = backward_scan(
        df, ["seq_id"], "pos", F.lit(0.5), v, "s", cross=m, helper_factor=1 - m, helper_addend=m * v, chunk=4
    )
    h = s = 0.0
    want = {}
    for _, p, val, mask in reversed(rows):
        h, s = (1 - mask) * h + mask * val, 0.5 * s + mask * h + val
        want[p] = round(s, 9)
    assert {r.pos: round(r.s, 9) for r in got.collect()} == want


def test_row_index_is_dense(spark):
    ids = [i * i for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "k BIGINT").repartition(7)
    got = {r.k: r.row for r in row_index(df, "k", buckets=16).collect()}
    assert got == {k: n for n, k in enumerate(ids)}


def test_take_largest_matches_sort(spark):
    rng = random.Random(8)
    rows = [(i, i % 5, float(rng.randint(0, 40))) for i in range(400)]
    df = spark.createDataFrame(rows, "seq_id BIGINT, pos BIGINT, x DOUBLE")
    got = {(r.seq_id, r.pos) for r in tokens.take_largest(df, "x", ["seq_id", "pos"], F.lit(37)).collect()}
    want = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:37]
    assert got == {(r[0], r[1]) for r in want}


def test_mini_batches_hold_every_row_once(spark):
    df = spark.createDataFrame([(i,) for i in range(120)], "id BIGINT")
    got = sampling.mini_batches(df, 10, 3, "id", seed=4).collect()
    for epoch in range(3):
        rows = [r for r in got if r.epoch == epoch]
        assert sorted(r.id for r in rows) == list(range(120))
        assert all(sum(r.batch == b for r in rows) == 10 for b in range(12))


def test_resample_draws_as_many_rows(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(200)], "seq_id BIGINT, score DOUBLE")
    got = sampling.pf_resample(df, "pow", 1.0).collect()
    assert sorted(r.draw for r in got) == list(range(200))
    assert sum(r.score == 0.0 for r in got) == 0
    peak = sampling.pf_resample(df, "max_min").collect()
    assert {r.score for r in peak} == {0.0, 3.0}


def test_balance_is_even(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, rng.randint(1, 4000)) for i in range(256)], "seq_id BIGINT, length BIGINT")
    per = balancing.balance(df, 8).groupBy("part").agg(F.count("*").alias("n"), F.sum("workload").alias("w")).collect()
    assert {r.n for r in per} == {32}
    assert max(r.w for r in per) / min(r.w for r in per) < 1.1


def test_filter_groups_keeps_varied_and_single(spark):
    rows = [(1, 1, 1.0), (2, 1, 0.0), (3, 2, 1.0), (4, 2, 1.0), (5, 3, 0.0)]
    df = spark.createDataFrame(rows, "seq_id BIGINT, uid BIGINT, acc DOUBLE")
    assert sorted(r.seq_id for r in filters.filter_groups(df, "acc").collect()) == [1, 2, 5]


def test_dense_topk_in_blocks_and_tiles(spark):
    rng = random.Random(9)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(90)]
    corpus = spark.createDataFrame(vectors, "doc_id BIGINT, vector ARRAY<DOUBLE>")
    queries = spark.createDataFrame(vectors[:20], "query_id BIGINT, vector ARRAY<DOUBLE>")
    small = retrieval.dense_topk(queries, corpus, 4)
    large = retrieval.dense_topk(queries, corpus, 4, block_values=40, tile=7)
    pick = lambda df: sorted((r.query_id, r["rank"], r.doc_id) for r in df.collect())
    assert pick(small) == pick(large)
    assert all(r.doc_id == r.query_id for r in small.where("rank = 1").collect())


def test_bm25_in_blocks_and_tiles(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(30)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 25)))) for i in range(120)]
    asks = [(i, " ".join(rng.choice(words) for _ in range(4))) for i in range(9)]
    corpus = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    queries = spark.createDataFrame(asks, "query_id BIGINT, text STRING")
    small = retrieval.bm25_topk(queries, corpus, 5)
    large = retrieval.bm25_topk(queries, corpus, 5, block_terms=6, tile=9)
    pick = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())
    assert pick(small) == pick(large)


def test_pair_agreement_of_one_hot_prompt(spark, many_buckets):
    import random

    from plumbline.operators import preferences

    own = random.Random(4)
    rows = [(1, i, float(own.randint(0, 9)), own.random() if i % 3 else 0.5) for i in range(600)] + [(None, i, 1.0, 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "uid long, seq_id long, score double, acc double").repartition(4)
    prompt = [(i, s, a) for u, i, s, a in rows if u == 1]
    weight = agree = 0.0
    for n, (_, sb, ab) in enumerate(prompt):
        for _, sa, aa in prompt[:n]:
            weight += abs(aa - ab)
            agree += abs(aa - ab) * ((sa > sb) == (aa > ab))
    got = preferences.pairwise_preference_accuracy(df).first().accuracy
    assert abs(got - (agree / weight + 0.5) / 2) < 1e-9


@pytest.fixture
def many_buckets(spark):
    """Small tables keep as many buckets as shuffle partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def test_ordered_buckets_split_equal_values(spark, many_buckets):
    from plumbline.operators.scale import ordered

    df = spark.range(20000).selectExpr("1.0 as s", "id as o")
    cut = ordered(df, ["s", "o"], "cut").groupBy("__bucket").agg({"o": "min", "*": "count"}).collect()
    assert len(cut) > 4 and max(r["count(1)"] for r in cut) < 8000
    low = [r["min(o)"] for r in sorted(cut, key=lambda r: r["__bucket"])]
    assert low == sorted(low)


def test_bm25_many_long_queries_in_bounded_blocks(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)] + [(900, None), (901, "")]
    asks = [(i, " ".join(rng.choices(words, k=300))) for i in range(120)] + [(500, None), (501, "zzz"), (502, "w1 w1 zzz")]
    corpus = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(3)
    queries = spark.createDataFrame(asks, "query_id BIGINT, text STRING")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in retrieval.bm25_topk(queries, corpus, 7, block_terms=2000, tile=50).collect())
    own = {i: (t or "").split() for i, t in docs}
    average = sum(map(len, own.values())) / len(own)
    df = {w: sum(w in set(t) for t in own.values()) for w in words}
    want = []
    for q, text in asks:
        scores = []
        for i, t in own.items():
            score = 0.0
            for w in set((text or "").split()):
                tf = t.count(w)
                if tf:
                    score += math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len(t) / average))
            if score > 0:
                scores.append((-round(score, 9), i))
        want += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:7], 1)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, sorted(want)))


def test_dense_bounds_skip_tiles_and_keep_ties(spark):
    import numpy as np
    import pyarrow as pa

    class Shared:
        value = (np.array([1, 2]), np.array([[1.0, 0.0], [0.0, 2.0]]))

    own = np.random.default_rng(1)
    vectors = own.normal(size=(500, 2)) * np.linspace(0.01, 5, 500)[:, None]
    vectors[7] = vectors[499]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(500)), pa.array(vectors.tolist(), pa.list_(pa.float64()))], names=["doc_id", "vector"])
    seen, keep = [], retrieval.Best.offer
    retrieval.Best.offer = lambda self, at, scores, ids: seen.append(len(at)) or keep(self, at, scores, ids)
    try:
        (out,) = retrieval._dense_scan(Shared, 6, False, 20)(iter([batch]))
    finally:
        retrieval.Best.offer = keep
    scores = np.round(Shared.value[1] @ vectors.T, 12)
    for n, q in enumerate((1, 2)):
        order = np.lexsort((np.arange(500), -scores[n]))[:6]
        assert [r["doc_id"] for r in out.to_pylist() if r["query_id"] == q] == order.tolist()
    assert sum(seen) < 30


@pytest.mark.parametrize("keys", [["k", "i"], ["x", "k", "i"], ["f", "i"], ["i"]])
@pytest.mark.parametrize("n", [0, 37, 4999])
def test_lowest_rows(spark, keys, n):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, -5, 3, 2**40 + i % 7]), 1 if i % 9 else None, rng.choice([0.5, rng.gauss(0, 1e-9), 1e300])) for i in range(5000)]
    df = spark.createDataFrame(rows, "i BIGINT, k BIGINT, x INT, f DOUBLE").repartition(3)
    at = {"i": 0, "k": 1, "x": 2, "f": 3}
    first = sorted(rows, key=lambda r: [(r[at[c]] is not None, r[at[c]] or 0) for c in keys])[:n]
    got = scale.lowest(df, n, keys)
    assert sorted(r.i for r in got.collect()) == sorted(r[0] for r in first)


def test_ten_million_rows_are_chosen_by_a_filter(spark):
    chosen = sampling.sample_n(spark.range(15_000_000).withColumnRenamed("id", "i"), 10_000_000, "i", shuffle=True, seed=4)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Limit", "Exchange", "Sort", "TakeOrdered"))
    assert chosen.count() == 10_000_000


def test_micro_batches_hold_their_budget(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, rng.choice([1, 5, 90, 97])) for i in range(400)], "seq_id BIGINT, length BIGINT")
    for budget, divisor in ((97, 1), (100, 4), (250, 1)):
        per = balancing.micro_batches(df, budget, 2, divisor).groupBy("micro_batch").agg(F.sum("length").alias("s")).collect()
        assert max(r.s for r in per) <= budget
    assert balancing.micro_batches(df.where("false"), 10).count() == 0
    with pytest.raises(ValueError, match="exceeds the budget"):
        balancing.micro_batches(df, 96)


def test_loads_with_giants_and_unequal_counts(spark):
    lengths = [100_000, 60_000] + [10 + i % 7 for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(lengths)), "seq_id BIGINT, length BIGINT")
    per = {r.part: (r.n, r.w) for r in balancing.balance_loads(df, 6).groupBy("part").agg(F.count("*").alias("n"), F.sum("workload").alias("w")).collect()}
    assert sorted(per) == list(range(6)) and per[0][0] == per[1][0] == 1
    rest = [w for p, (_, w) in per.items() if p > 1]
    assert max(rest) - min(rest) < 2 * 24576 * 20
    assert balancing.balance_loads(df, 1).select("part").distinct().collect()[0].part == 0


@pytest.mark.parametrize("normalize", [True, False])
def test_dense_grid_of_groups_and_parts(spark, monkeypatch, normalize):
    import numpy as np

    own = np.random.default_rng(4)
    vectors = np.round(own.normal(size=(300, 4)), 1)
    vectors[5], vectors[9] = vectors[200], 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    corpus = spark.createDataFrame([*rows, (300, None)], "doc_id BIGINT, vector ARRAY<FLOAT>")
    queries = spark.createDataFrame([*rows[::10], (301, None)], "query_id BIGINT, vector ARRAY<FLOAT>")
    monkeypatch.setattr(retrieval, "GROUP_VALUES", 40)
    monkeypatch.setattr(retrieval, "PART_VALUES", 200)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: pytest.fail("queries came to the driver"))
    found = retrieval.dense_topk(queries, corpus, 4, normalize, block_values=8, tile=16)
    monkeypatch.undo()
    exact = np.float32(vectors).astype(float)
    if normalize:
        norms = np.linalg.norm(exact, axis=1, keepdims=True)
        exact = exact / np.where(norms == 0, 1.0, norms)
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in found.collect())
    want = []
    for q in range(0, 300, 10):
        scores = np.round(exact @ exact[q], 12)
        want += [(q, n + 1, int(d)) for n, d in enumerate(np.lexsort((np.arange(300), -scores))[:4])]
    assert got == want
    assert retrieval.dense_topk(queries.limit(0), corpus, 4).count() == 0
    assert retrieval.dense_topk(queries, corpus.limit(0), 4).count() == 0


def test_terminal_rewards_of_null_and_missing_sequences(spark):
    rows = [(s, p, m) for s in (1, 2, None) for p, m in enumerate([1, 1, 0])] + [(3, 0, 0)]
    df = spark.createDataFrame(rows, "seq_id BIGINT, pos BIGINT, mask INT")
    scores = spark.createDataFrame([(1, 0.5), (3, 0.7), (None, 0.9)], "seq_id BIGINT, score DOUBLE")
    out = tokens.place_terminal_reward(df, scores)
    got = sorted([(r.seq_id or 0, r.pos, r.reward) for r in out.collect()], key=str)
    assert out.columns == ["seq_id", "pos", "mask", "reward"]
    assert got == [(0, 0, 0.0), (0, 1, 0.0), (0, 2, 0.0), (1, 0, 0.0), (1, 1, 0.5), (1, 2, 0.0), (2, 0, 0.0), (2, 1, None), (2, 2, 0.0), (3, 0, 0.0)]


def test_tasks_of_the_token_table_grow_in_number(spark, monkeypatch):
    from plumbline.plans import token_queries

    sf = "/root/testdata/sf0.001"
    plain = token_queries.tokens(spark, sf)
    monkeypatch.setattr(token_queries, "TASK_ROWS", 100)
    dealt = token_queries.tokens(spark, sf)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-lines // 100)}), REPARTITION_BY_NUM" in plan
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    assert dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()
