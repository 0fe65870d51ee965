"""Curves over risk thresholds and metrics of explicit abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.calibration import _by, _on, collapse, threshold_sweep, trapz
from plumbline.operators.scale import match


def _rates(df: DataFrame, by: list[str], thresholds: list[float], c: str, y: str) -> DataFrame:
    return threshold_sweep(collapse(df, by, c, y), by, thresholds)


def adaptive_risk(df: DataFrame, thresholds: list[float], by=None, c="confidence", y="correct") -> DataFrame:
    """Share abstained (c < t) and share answered wrongly, per threshold."""
    by = _by(by)
    return _rates(df, by, thresholds, c, y).select(
        *by,
        "t",
        ((F.col("total") - F.col("answered")) / F.col("total")).alias("abstention_rate"),
        (F.col("wrong") / F.col("total")).alias("hallucination_rate"),
    )


def hallucination_curve(df: DataFrame, thresholds: list[float], by=None, c="confidence", y="correct") -> DataFrame:
    """Signal-to-noise per threshold and the gain over the first threshold."""
    by = _by(by)
    rates = _rates(df, by, thresholds, c, y).select(
        *by, "t", (F.col("right") / F.col("total")).alias("acc"), (F.col("wrong") / F.col("total")).alias("hal")
    )
    snr = F.when(F.col("hal") > 0, F.try_divide("acc", "hal")).otherwise(F.lit(float("inf")))
    first = rates.where(F.col("t") == F.lit(min(thresholds))).select(*by, snr.alias("snr0"))
    area = trapz(rates, "t", {"acc_area": "acc", "hal_area": "hal"}, by)
    usable = (F.col("hal_area") > 0) & (F.col("snr0") > 0) & (F.col("snr0") < F.lit(float("inf")))
    gain = F.when(usable, F.ln(F.try_divide(F.try_divide("acc_area", "hal_area"), F.col("snr0"))))
    gains = _on(area, first, by).select(*by, F.coalesce(gain, F.lit(0.0)).alias("snr_gain"))
    return _on(rates.withColumn("snr", snr), gains, by).select(*by, "t", "snr", "snr_gain")


def tp_fn_curve(df: DataFrame, thresholds: list[float], by=None, c="confidence", y="correct") -> DataFrame:
    """Accuracy of the answered and of the abstained, per threshold."""
    by = _by(by)
    answered, right = F.col("answered"), F.col("right")
    return _rates(df, by, thresholds, c, y).select(
        *by,
        "t",
        F.coalesce(F.try_divide(right, answered), F.lit(0.0)).alias("tp"),
        F.coalesce(F.try_divide(F.col("total_pos") - right, F.col("total") - answered), F.lit(0.0)).alias("fn"),
    )


def behavioral_report(df: DataFrame, thresholds: list[float], by=None, c="confidence", y="correct") -> DataFrame:
    """All curves and the accuracy as ``(by…, t, metric, value)``."""
    by = _by(by)
    wide = match(adaptive_risk(df, thresholds, by, c, y), hallucination_curve(df, thresholds, by, c, y), [*by, "t"])
    wide = match(wide, tp_fn_curve(df, thresholds, by, c, y), [*by, "t"])
    names = ["abstention_rate", "hallucination_rate", "snr", "snr_gain", "tp", "fn"]
    curves = wide.unpivot([*by, "t"], names, "metric", "value")
    accuracy = df.groupBy(*by).agg(F.avg(F.col(y).cast("double")).alias("value"))
    scalar = accuracy.select(*by, F.lit(None).cast("double").alias("t"), F.lit("accuracy").alias("metric"), "value")
    return curves.unionByName(scalar)


def _flag_counts(df: DataFrame, by: list[str]) -> DataFrame:
    abstained = F.coalesce(F.col("abstained").cast("boolean"), F.lit(False))
    correct = F.coalesce(F.col("correct").cast("boolean"), F.lit(False))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(~abstained).alias("n_answered"),
        F.count_if(abstained).alias("n_abstained"),
        F.count_if(~abstained & correct).alias("right"),
        F.count_if(~abstained & ~correct).alias("wrong"),
        F.count_if(abstained & ~correct).alias("wrong_abstained"),
    )


def _share(name: str) -> Column:
    return F.coalesce(F.try_divide(F.col(name), F.col("n_samples")), F.lit(0.0))


def policy_metrics(df: DataFrame, by=None) -> DataFrame:
    """Metrics of one abstention policy from its flags, not its confidences."""
    by = _by(by)
    snr = (
        F.when(F.col("wrong") > 0, F.try_divide("right", "wrong"))
        .when(F.col("right") > 0, F.lit(float("inf")))
        .otherwise(F.lit(0.0))
    )
    good = F.coalesce(F.try_divide(F.col("right") + F.col("wrong_abstained"), F.col("n_samples")), F.lit(0.0))
    return _flag_counts(df, by).select(
        *by,
        _share("right").alias("predictive_accuracy"),
        good.alias("abstention_accuracy"),
        _share("wrong").alias("hallucination_rate"),
        _share("n_abstained").alias("abstention_rate"),
        snr.alias("snr"),
        "n_samples",
        "n_answered",
        "n_abstained",
    )


def risk_sweep(
    df: DataFrame,
    t0_df: DataFrame | None = None,
    thresholds: list[float] | None = None,
    abstention_t: float = 0.5,
    by=None,
) -> DataFrame:
    """Summary of rows whose prompts state a risk threshold.

    Rows are grouped by the stated threshold rounded to six places; the gain is
    measured against the separate run at threshold 0. No stated threshold at
    all is an error; a threshold-0 run without right answers gives a NULL gain.
    """
    by = _by(by)
    stated = df.where(F.col("risk_t").isNotNull()).withColumn("t", F.round(F.col("risk_t").cast("double"), 6))
    counts = _flag_counts(stated, [*by, "t"])
    if t0_df is not None:
        zero = _flag_counts(t0_df, by)
        missing = match(zero, counts.where(F.col("t") == 0.0).select(*by), by, "left_anti") if by else zero.where(
            counts.where(F.col("t") == 0.0).agg(F.count(F.lit(1))).scalar() == 0
        )
        counts = counts.unionByName(missing.withColumn("t", F.lit(0.0)))
    used = counts
    if thresholds is not None:
        wanted = [round(float(t), 6) for t in thresholds]
        used = counts.where(F.col("t").isin([*wanted, 0.0, 1.0]))
    rates = used.select(*by, "t", _share("right").alias("acc"), _share("wrong").alias("hal"))
    area = trapz(rates, "t", {"acc_area": "acc", "hal_area": "hal"}, by)
    target = F.lit(round(float(abstention_t), 6))
    good = F.try_divide(F.col("right") + F.col("wrong_abstained"), F.col("n_samples"))
    exact = F.col("t") == target
    rank = F.struct(F.when(exact, F.lit(0.0)).otherwise(F.abs(F.col("t") - target)), F.col("t"))
    nearest = used.groupBy(*by).agg(
        F.min_by(F.struct(good.alias("a"), _share("n_abstained").alias("r"), "n_samples", "n_answered", "n_abstained"), rank).alias("at"),
        F.count(F.lit(1)).alias("n_thresholds"),
    )
    out = _on(area, nearest, by)
    if t0_df is None:
        gain, acc0 = F.lit(0.0), F.lit(0.0)
    else:
        base = zero.select(*by, _share("right").alias("acc0"), _share("wrong").alias("hal0"))
        out = _on(out, base, by)
        ratio = F.try_divide(F.try_divide("acc_area", "hal_area"), F.try_divide("acc0", "hal0"))
        usable = (F.col("hal0") > 0) & (F.col("hal_area") > 0)
        gain = F.when(usable, F.when(F.col("acc0") > 0, F.ln(ratio))).otherwise(F.lit(0.0))
        acc0 = F.col("acc0")
    any_stated = df.agg(F.count("risk_t")).scalar()
    checked = F.when(any_stated == 0, F.raise_error(F.lit("no row states risk_t")).cast("double")).otherwise(gain)
    return out.select(
        *by,
        checked.alias("snr_gain"),
        F.col("at.a").alias("abstention_accuracy"),
        acc0.alias("predictive_accuracy"),
        F.col("at.r").alias("abstention_rate"),
        F.col("at.n_samples").alias("n_samples"),
        F.col("at.n_answered").alias("n_answered"),
        F.col("at.n_abstained").alias("n_abstained"),
        "n_thresholds",
    )


OVERLAID = [
    "snr_gain",
    "abstention_accuracy",
    "predictive_accuracy",
    "abstention_rate",
    "n_samples",
    "n_answered",
    "n_abstained",
]


def overlay(conf_metrics: DataFrame, risk_metrics: DataFrame, by=None) -> DataFrame:
    """Risk-sweep values replace the seven named metrics where present.

    Both inputs are long: ``(by…, metric, value)``.
    """
    by = _by(by)
    risk = risk_metrics.where(F.col("metric").isin(OVERLAID)).select(*by, "metric", F.col("value").alias("__risk"))
    joined = conf_metrics.join(risk, [*by, "metric"], "full")
    return joined.select(*by, "metric", F.coalesce("__risk", "value").alias("value"))


def curve_at(curve: DataFrame, thresholds: list[float], by=None) -> DataFrame:
    """Curve values at key thresholds and the largest gain on the curve."""
    by = _by(by)
    picked = curve.where(F.col("t").isin(thresholds))
    top = curve.groupBy(*by).agg(F.max("snr_gain").alias("max_snr_gain"))
    return _on(picked, top, by)
