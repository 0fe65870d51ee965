"""Calibration metrics over (confidence, correct).

Everything starts from ``collapse``: one row per group and distinct confidence
with counts. It is a plain hash aggregate, so map-side combining shrinks the
predictions before the only large shuffle; the metrics then read counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.operators.scale import match, running_sum, written

# Numeric guards and grids of the metric definitions.
NLL_EPS = 1e-10
SMOOTH_BANDWIDTH = 0.1
SMOOTH_GRID = [i * (1.0 / 199) for i in range(199)] + [1.0]
CENTER_GRID = [(i + 0.5) / 15 for i in range(15)]
THRESHOLDS = [i * 0.01 for i in range(101)]
CLOSE_ABS, CLOSE_REL = 1e-8, 1e-5

# Confidences are cut at multiples of 1/CELLS before any ordered window.
CELLS = 1 << 16


def _by(by: list[str] | None) -> list[str]:
    return list(by or [])


def collapse(df: DataFrame, by: list[str] | None = None, c: str = "confidence", y: str = "correct") -> DataFrame:
    """``(by…, c, n, pos)``: rows and correct rows per distinct confidence."""
    base = df.select(*_by(by), F.col(c).cast("double").alias("c"), F.col(y).cast("bigint").alias("y"))
    return base.groupBy(*_by(by), "c").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))


def _nll_term(c: Column, y: Column, eps: float) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), c))
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def _per_group(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs)


def brier_score(df: DataFrame, by=None, c="confidence", y="correct") -> DataFrame:
    square = F.pow(F.col(c) - F.col(y).cast("double"), F.lit(2.0))
    return _per_group(df, _by(by), F.coalesce(F.avg(square), F.lit(0.0)).alias("brier"))


def nll(df: DataFrame, by=None, eps: float = NLL_EPS, c="confidence", y="correct") -> DataFrame:
    term = _nll_term(F.col(c), F.col(y).cast("double"), eps)
    return _per_group(df, _by(by), F.coalesce(F.avg(term), F.lit(0.0)).alias("nll"))


def abstention_accuracy(df: DataFrame, by=None, t: float = 0.5, c="confidence", y="correct") -> DataFrame:
    agree = ((F.col(c) >= t) == (F.col(y).cast("int") == 1)).cast("double")
    return _per_group(df, _by(by), F.coalesce(F.avg(agree), F.lit(0.0)).alias("abstention_accuracy"))


def predictive_accuracy(df: DataFrame, by=None, y="correct") -> DataFrame:
    return _per_group(df, _by(by), F.coalesce(F.avg(F.col(y).cast("double")), F.lit(0.0)).alias("predictive_accuracy"))


def ece_from_counts(counts: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Bins ``(lo, hi]``, the first one closed on both sides."""
    upper = [i * (1.0 / bins) for i in range(1, bins)] + [1.0]
    bin_no = F.lit(None).cast("int")
    for i in reversed(range(bins)):
        bin_no = F.when(F.col("c") <= F.lit(upper[i]), F.lit(i)).otherwise(bin_no)
    per_bin = counts.groupBy(*by, bin_no.alias("bin")).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("n") * F.col("c")).alias("conf")
    )
    gap = F.abs(F.col("pos") / F.col("n") - F.col("conf") / F.col("n")) * F.col("n")
    return per_bin.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def ece(df: DataFrame, by=None, bins: int = 10, c="confidence", y="correct") -> DataFrame:
    by = _by(by)
    return ece_from_counts(collapse(df, by, c, y), by, bins).withColumn("ece", F.coalesce("ece", F.lit(0.0)))


def smoothed_ece_from_counts(
    counts: DataFrame, by: list[str], bandwidth: float, grid: list[float], eps: float, fallback: bool = True
) -> DataFrame:
    """Kernel-smoothed calibration error over a fixed grid.

    Each distinct confidence contributes to every grid point, so the expansion
    is linear in the distinct values and is summed map-side before shuffling.
    """
    points = F.array(*[F.lit(g) for g in grid])
    on_grid = counts.withColumn("g", F.explode(points))
    weight = F.col("n") * F.exp(-F.pow(F.col("c") - F.col("g"), F.lit(2.0)) / (2 * bandwidth**2))
    hits = F.col("pos") * F.exp(-F.pow(F.col("c") - F.col("g"), F.lit(2.0)) / (2 * bandwidth**2))
    density = on_grid.groupBy(*by, "g").agg(F.sum(weight).alias("d"), F.sum(hits).alias("h"))
    gap = F.abs(F.col("h") / F.col("d") - F.col("g")) * F.col("d")
    smooth = density.where(F.col("d") > 0).groupBy(*by).agg((F.sum(gap) / (F.sum("d") + eps)).alias("smooth_ece"))
    if not fallback:
        return smooth
    spread = counts.groupBy(*by).agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    constant = spread.select(
        *by, (F.col("hi") - F.col("lo") <= CLOSE_ABS + CLOSE_REL * F.abs(F.col("lo"))).alias("constant")
    )
    binned = ece_from_counts(counts, by)
    joined = _on(_on(smooth, constant, by), binned, by)
    return joined.select(
        *by, F.when(F.col("constant"), F.col("ece")).otherwise(F.col("smooth_ece")).alias("smooth_ece")
    )


def smoothed_ece(
    df: DataFrame, by=None, bandwidth: float = SMOOTH_BANDWIDTH, grid=None, c="confidence", y="correct"
) -> DataFrame:
    by = _by(by)
    return smoothed_ece_from_counts(collapse(df, by, c, y), by, bandwidth, grid or SMOOTH_GRID, 1e-12)


def smoothed_ece_centers(df: DataFrame, by=None, bandwidth: float = SMOOTH_BANDWIDTH, c="confidence", y="correct"):
    """Same kernel at 15 bin centres; no fallback for constant confidence."""
    by = _by(by)
    return smoothed_ece_from_counts(collapse(df, by, c, y), by, bandwidth, CENTER_GRID, 1e-10, fallback=False)


def auc_from_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Exact ROC AUC with ties at one half; one class only gives 0.5."""
    cell = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c"))) * CELLS)
    prepared = counts.withColumn("neg", F.col("n") - F.col("pos")).withColumn("__cell", cell)
    below = running_sum(prepared, by, "__cell", [F.col("c")], {"neg_below": "neg"}, inclusive=False)
    wins = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)
    total = below.groupBy(*by).agg(F.sum(wins).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    pairs = F.col("p").cast("double") * F.col("q").cast("double")
    auc = F.when((F.col("p") > 0) & (F.col("q") > 0), F.try_divide("u", pairs))
    return total.select(*by, F.coalesce(auc, F.lit(0.5)).alias("auc"))


def confidence_auc(df: DataFrame, by=None, c="confidence", y="correct") -> DataFrame:
    by = _by(by)
    return auc_from_counts(collapse(df, by, c, y), by)


def distinct_thresholds(values: list[float], with_zero: bool = True) -> list[float]:
    """Clip to [0, 1], drop duplicates, sort, put 0 in front."""
    clipped = {min(1.0, max(0.0, float(v))) for v in values}
    if with_zero:
        clipped.add(0.0)
    return sorted(clipped)


def stated_thresholds(df: DataFrame, col: str, with_zero: bool = True) -> DataFrame:
    """``distinct_thresholds`` of a column, as rows ``(t, n_rows)``; NULL states nothing."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(col).cast("double")))
    stated = df.where(F.col(col).isNotNull()).groupBy(t.alias("t")).agg(F.count(F.lit(1)).alias("n_rows"))
    if not with_zero:
        return stated
    zero = df.sparkSession.range(1).select(F.lit(0.0).alias("t"), F.lit(0).cast("bigint").alias("n_rows"))
    return stated.unionByName(zero).groupBy("t").agg(F.sum("n_rows").alias("n_rows"))


def threshold_sweep(counts: DataFrame, by: list[str], thresholds: list[float]) -> DataFrame:
    """Per threshold: rows, right and wrong answers with ``confidence >= t``.

    Each distinct confidence is filed under the highest threshold it reaches;
    a reverse running total over those few cells replaces the join of every
    prediction with every threshold.
    """
    steps = sorted(thresholds)
    ladder = F.array(*[F.lit(t) for t in steps])
    level = F.size(F.filter(ladder, lambda t: t <= F.col("c"))) - 1
    filed = counts.groupBy(*by, level.alias("level")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    # Every group gets an empty cell per rung; its cells are then summed from the top.
    groups = filed.groupBy(*by).agg(F.lit(0).cast("long").alias("n"))
    nothing = groups.select(*by, F.posexplode(ladder).alias("level", "t"), "n", F.col("n").alias("pos"))
    cells = filed.unionByName(nothing.drop("t")).groupBy(*by, "level").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    every = W.partitionBy(*by)
    above = every.orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = cells.select(
        *by,
        "level",
        F.get(ladder, F.col("level")).alias("t"),
        F.sum("n").over(every).alias("total"),
        F.sum("pos").over(every).alias("total_pos"),
        F.sum("n").over(above).alias("answered"),
        F.sum("pos").over(above).alias("right"),
    ).where("level >= 0")
    return swept.withColumn("wrong", F.col("answered") - F.col("right"))


def trapz(df: DataFrame, x: str, values: dict[str, str], by: list[str]) -> DataFrame:
    """Area under each value column along ``x`` by the trapezoid rule."""
    along = W.partitionBy(*by).orderBy(x)
    step = F.lead(x).over(along) - F.col(x)
    parts = df.select(
        *by, *[((F.lead(v).over(along) + F.col(v)) / 2 * step).alias(o) for o, v in values.items()]
    )
    return parts.groupBy(*by).agg(*[F.coalesce(F.sum(o), F.lit(0.0)).alias(o) for o in values])


def snr_gain_from_counts(counts: DataFrame, by: list[str], thresholds: list[float]) -> DataFrame:
    swept = threshold_sweep(counts, by, distinct_thresholds(thresholds))
    rates = swept.select(
        *by, "t", (F.col("right") / F.col("total")).alias("acc"), (F.col("wrong") / F.col("total")).alias("hal")
    )
    area = trapz(rates, "t", {"acc_area": "acc", "hal_area": "hal"}, by)
    base = rates.where(F.col("t") == 0.0).select(*by, F.col("acc").alias("acc0"), F.col("hal").alias("hal0"))
    ratio = F.try_divide(F.try_divide("acc_area", "hal_area"), F.try_divide("acc0", "hal0"))
    usable = (F.col("hal0") > 0) & (F.col("hal_area") > 0) & (F.col("acc0") > 0)
    joined = _on(area, base, by)
    return joined.select(*by, F.when(usable, F.ln(ratio)).otherwise(F.lit(0.0)).alias("snr_gain"))


def snr_gain(df: DataFrame, by=None, thresholds=None, c="confidence", y="correct") -> DataFrame:
    by = _by(by)
    return snr_gain_from_counts(collapse(df, by, c, y), by, thresholds or THRESHOLDS)


def _on(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Join two one-row-per-group results; without groups both are one row."""
    if by:
        return match(a, b, by)
    return a.withColumn("__one", F.lit(1)).join(b.withColumn("__one", F.lit(1)), "__one").drop("__one")


def moments_from_counts(counts: DataFrame, by: list[str], t: float, eps: float = NLL_EPS) -> DataFrame:
    """All metrics that are plain sums over the collapsed rows."""
    c, n, pos = F.col("c"), F.col("n"), F.col("pos")
    neg = n - pos
    square = pos * F.pow(c - 1, F.lit(2.0)) + neg * F.pow(c, F.lit(2.0))
    log_loss = pos * _nll_term(c, F.lit(1.0), eps) + neg * _nll_term(c, F.lit(0.0), eps)
    return counts.groupBy(*by).agg(
        F.sum(n).alias("n_samples"),
        (F.sum(square) / F.sum(n)).alias("brier"),
        (F.sum(log_loss) / F.sum(n)).alias("nll"),
        (F.sum(F.when(c >= t, pos).otherwise(neg)) / F.sum(n)).alias("abstention_accuracy"),
        (F.sum(pos) / F.sum(n)).alias("predictive_accuracy"),
        (F.sum(n * c) / F.sum(n)).alias("avg_confidence"),
        F.coalesce(F.sum(F.when(c >= t, n)), F.lit(0)).alias("n_answered"),
        F.coalesce(F.sum(F.when(c < t, n)), F.lit(0)).alias("n_abstained"),
    )


def prediction_summary(
    df: DataFrame, by=None, t: float = 0.5, thresholds=None, c="confidence", y="correct"
) -> DataFrame:
    """The seven calibration metrics with counts, mean confidence and
    abstention rate. Predictions are read once, into a table of collapsed rows."""
    by = _by(by)
    counts = written(collapse(df, by, c, y), "counts")
    out = moments_from_counts(counts, by, t)
    out = _on(out, smoothed_ece_from_counts(counts, by, SMOOTH_BANDWIDTH, SMOOTH_GRID, 1e-12), by)
    out = _on(out, auc_from_counts(counts, by), by)
    out = _on(out, snr_gain_from_counts(counts, by, thresholds or THRESHOLDS), by)
    return out.withColumn("abstention_rate", F.col("n_abstained") / F.col("n_samples"))


REPORT = ["snr_gain", "abstention_accuracy", "predictive_accuracy", "smooth_ece", "brier", "nll", "auc"]


def calibration_report(df: DataFrame, by=None, t: float = 0.5, c="confidence", y="correct") -> DataFrame:
    """The seven metrics in one row per group."""
    return prediction_summary(df, by, t, None, c, y).select(*_by(by), *REPORT)


API_NAMES = {
    "predictive_accuracy": "pred_acc",
    "smooth_ece": "smECE",
    "brier": "brier_score",
    "auc": "conf_auc",
    "abstention_accuracy": "abst_acc",
}


def api_names(summary: DataFrame) -> DataFrame:
    """The short naming scheme used for API models."""
    return summary.withColumnsRenamed(API_NAMES)

