"""Model × dataset report tables from a long result table.

Input: one row per ``(method, dataset)`` with the seven metric columns and
``n_samples``. Reports are as small as the number of methods and datasets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metrics of a report and whether more is better.
DIRECTIONS = {
    "snr_gain": "up",
    "auc": "up",
    "abstention_accuracy": "up",
    "smooth_ece": "down",
    "brier": "down",
    "nll": "down",
    "predictive_accuracy": "up",
}
# Display order of test sets and their two groups.
GENERAL_SETS = ["flashrag_nq", "flashrag_triviaqa", "flashrag_popqa"]
MULTIHOP_SETS = ["flashrag_hotpotqa", "flashrag_2wikimultihopqa", "flashrag_musique", "flashrag_bamboogle"]
DATASET_ORDER = GENERAL_SETS + MULTIHOP_SETS
# Method families in display order.
METHOD_ORDER = ["Binary Reward", "Verbalized Brier", "Verbalized CE"]


def coverage(df: DataFrame, datasets: list[str]) -> DataFrame:
    """1 where a method has a result for a set, else 0."""
    wide = df.groupBy("method").pivot("dataset", datasets).agg(F.max(F.lit(1)))
    return wide.na.fill(0)


def overall_means(df: DataFrame) -> DataFrame:
    return df.groupBy("method").agg(*[F.avg(m).alias(m) for m in DIRECTIONS])


def metric_table(df: DataFrame, metric: str, datasets: list[str], methods: Column | None = None) -> DataFrame:
    """One metric as method × dataset, missing cells NULL."""
    rows = df if methods is None else df.where(methods)
    return rows.groupBy("method").pivot("dataset", datasets).agg(F.first(metric))


def train_group(method: Column, base: str) -> Column:
    """Text in the final brackets of a method name; ``Base`` and ``Other`` else."""
    return (
        F.when(method == base, "Base")
        .when(method.rlike(r"\(.*\)$"), F.trim(F.regexp_extract(method, r"\(([^(]*)\)$", 1)))
        .otherwise(F.lit("Other"))
    )


def grouped_metric_table(df: DataFrame, metric: str, datasets: list[str], base: str) -> DataFrame:
    """The table per train-set group; every group also shows the base model."""
    tagged = df.withColumn("train_group", train_group(F.col("method"), base))
    groups = tagged.where(~F.col("train_group").isin("Base", "Other")).select("train_group").distinct()
    bases = tagged.where(F.col("train_group") == "Base").drop("train_group").withColumn("__one", F.lit(1))
    repeated = groups.withColumn("__one", F.lit(1)).join(bases, "__one").drop("__one")
    own = tagged.where(~F.col("train_group").isin("Base", "Other"))
    return own.unionByName(repeated).groupBy("train_group", "method").pivot("dataset", datasets).agg(F.first(metric))


def test_group(dataset: Column) -> Column:
    return F.when(dataset.isin(GENERAL_SETS), "General QA").when(dataset.isin(MULTIHOP_SETS), "Multi-Hop QA")


def long_metrics(df: DataFrame) -> DataFrame:
    return df.unpivot(["method", "dataset"], list(DIRECTIONS), "metric", "value")


def signed(metric: Column, value: Column) -> Column:
    """Value turned so that larger is better."""
    down = [m for m, d in DIRECTIONS.items() if d == "down"]
    return F.when(metric.isin(down), -value).otherwise(value)


def win_counts(df: DataFrame) -> DataFrame:
    """How often a method is best per metric; every tie wins."""
    long = long_metrics(df).where(F.col("value").isNotNull()).withColumn(
        "s", signed(F.col("metric"), F.col("value"))
    )
    best = long.groupBy("dataset", "metric").agg(F.max("s").alias("best"))
    flagged = long.join(best, ["dataset", "metric"]).withColumn("win", (F.col("s") == F.col("best")).cast("int"))
    wide = flagged.groupBy("method").agg(
        *[F.sum(F.when(F.col("metric") == m, F.col("win")).otherwise(F.lit(0))).alias(m) for m in DIRECTIONS]
    )
    total = F.lit(0)
    for m in DIRECTIONS:
        total = total + F.col(m)
    return wide.withColumn("total", total)


def best_in_column(df: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Mark the cells within 1e-12 of the best of their dataset and metric."""
    long = long_metrics(df).withColumn("s", signed(F.col("metric"), F.col("value")))
    best = long.groupBy("dataset", "metric").agg(F.max("s").alias("best"))
    near = F.coalesce(F.abs(F.col("s") - F.col("best")) < tolerance, F.lit(False))
    return long.join(best, ["dataset", "metric"]).select("method", "dataset", "metric", "value", near.alias("is_best"))


def simplify_method(method: Column, base: str) -> Column:
    out = F.when(method == base, F.lit("Base")).when(method.rlike("^(Binary Reward|Verbalized Brier) RLOO"), F.trim(method))
    for family in METHOD_ORDER:
        out = out.when(method.startswith(family), F.lit(family))
    return out.otherwise(method)


def method_meta(df: DataFrame, base: str) -> DataFrame:
    """Label, train set, data size and test sizes of a method."""
    method = F.col("method")
    train = (
        F.when(method == base, "-")
        .when(F.contains(F.lower(method), F.lit("triviaqa")), "TriviaQA")
        .when(F.contains(F.lower(method), F.lit("hotpotqa")), "HotpotQA")
        .otherwise(F.lit("TriviaQA"))
    )
    size = F.when((method != base) & F.contains(method, F.lit("RLOO")), "10k / 2k").otherwise(F.lit("-"))
    sizes = F.array_join(F.transform(F.sort_array(F.collect_set("n_samples")), lambda n: n.cast("string")), "/")
    return df.groupBy("method").agg(sizes.alias("s")).select(
        "method",
        simplify_method(method, base).alias("label"),
        train.alias("train_set"),
        size.alias("data_size"),
        F.when(F.col("s") == "", F.lit("-")).otherwise(F.col("s")).alias("test_size"),
    )


def order_methods(df: DataFrame, prefixes: list[str], appearance: str) -> DataFrame:
    """Methods in display order: preferred prefixes first, then appearance."""
    first = df.groupBy("method").agg(F.min(appearance).alias("seen"))
    place = F.lit(len(prefixes))
    for i in reversed(range(len(prefixes))):
        place = F.when(F.col("method").startswith(prefixes[i]), F.lit(i)).otherwise(place)
    return first.withColumn("place", place).orderBy("place", "seen")
