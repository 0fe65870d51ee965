"""Writers for results, dumps, metric logs and label files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import claim_values
from plumbline.operators.rows import slim_predictions


def write_results(predictions: DataFrame, metrics: DataFrame, path: str) -> None:
    """Full rows, slim rows and metrics as three tables under one folder.

    Predictions are partitioned by method and dataset where they have them, so
    a report reads only what it needs.
    """
    parts = [c for c in ("method", "dataset") if c in predictions.columns]
    slim = slim_predictions(predictions).columns
    predictions.write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/results")
    full = predictions.sparkSession.read.schema(predictions.schema).parquet(f"{path}/results")
    full.select(*parts, *slim).write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/predictions")
    metrics.write.mode("overwrite").json(f"{path}/metrics")


def dump_rollouts(df: DataFrame, path: str) -> None:
    """One JSON line per sample, a folder per step."""
    df.write.mode("append").partitionBy("step").json(path)


def write_rl_parquet(df: DataFrame, path: str, example_rows: int = 1) -> None:
    """Train and test parquet, plus the first rows as readable JSON."""
    splits = df.withColumn("split", F.col("extra_info.split")) if "split" not in df.columns else df
    splits.write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    back = df.sparkSession.read.schema(splits.schema).parquet(f"{path}/data")
    back.limit(example_rows).select(*df.columns).write.mode("overwrite").json(f"{path}/example")


def metric_log(metrics: DataFrame) -> DataFrame:
    """``{"step": s, "data": {name: value}}`` rows, one per step."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))
    return metrics.groupBy("step").agg(entries.alias("data"))


def append_metric_log(metrics: DataFrame, path: str) -> None:
    metric_log(metrics).write.mode("append").json(path)


def export_claims(predictions: DataFrame, response: str = "full_response") -> DataFrame:
    """Rows with at least one claim, for labelling by a judge."""
    correct = F.coalesce(*[F.col(c) for c in ("correct", "is_correct") if c in predictions.columns])
    return predictions.select(
        "index",
        "question",
        correct.alias("final_answer_correct"),
        F.col(response).alias("full_response"),
        claim_values(F.col(response)).alias("claim_confidences"),
    ).where(F.size("claim_confidences") > 0)


def append_labels(df: DataFrame, path: str) -> None:
    df.select("index", "claim_labels").write.mode("append").json(path)
