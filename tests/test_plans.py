"""Plan shapes: no Python on hot paths, no window over a whole table."""

import pytest

from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"
PYTHON_QUERIES = {"tokenizer_hook", "batch_scorer", "dense_topk", "dense_topk_blocks", "bm25_topk"}
HOT = [
    "calibration_report",
    "score_brier",
    "grade_predictions",
    "adv_grpo",
    "adv_gae",
    "offpolicy_metrics",
    "ppo_loss",
    "scaling_summary",
    "balanced_partitions",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", HOT)
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    for word in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(catalog.QUERIES["brier_score"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan


def test_group_topk_is_limited_before_the_shuffle(spark):
    assert plan_of(catalog.QUERIES["bm25_topk"](spark, SF)).count("WindowGroupLimit") == 2


def test_python_only_where_it_is_the_feature():
    assert PYTHON_QUERIES <= set(catalog.QUERIES)


SCANS = {"pair_compare": 4, "bm25_topk": 2, "bootstrap_metric": 8, "maj_at_n": 14, "reweighted_resample": 4}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_scans_stay_few(spark, name):
    assert plan_of(catalog.QUERIES[name](spark, SF)).count("FileScan") <= SCANS[name]
