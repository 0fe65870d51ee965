"""Registered queries against DuckDB; ``PLUMBLINE_ALL=1`` runs every one."""

import os
import shutil
import subprocess
import sys

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"
QUICK = [
    "calibration_report",
    "risk_sweep_metrics",
    "scaling_summary",
    "report_wins",
    "adv_grpo",
    "adv_gae",
    "offpolicy_metrics",
    "kl_cov_loss",
    "score_brier",
    "grade_predictions",
    "prioritized_downsample",
    "attach_retrieval_context",
    "multiturn_pack",
    "bm25_topk",
    "build_gsm8k_rows",
    "read_result_tree",
]
NAMES = sorted(catalog.ORACLE) if os.environ.get("PLUMBLINE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, catalog.QUERIES[name], catalog.ORACLE[name], SF) is None


def test_entry_and_tables():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 5


def test_entry_without_the_corpus_folders(tmp_path):
    """The other queries stand alone, whether the pipeline file is left behind or not."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and 'pipeline' not in q; print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) == len(catalog.QUERIES)
