"""Validation roll-ups: per prompt first, then per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.basics import hash48
from plumbline.operators.draws import multinomial
from plumbline.operators.scale import attach_group, range_bucket, running_sum, union_all
from plumbline.operators.votes import majority_value

KEYS = ["data_source", "uid"]


def score_by_source(df: DataFrame, responses: str = "responses", scorer=None, score: str = "score") -> DataFrame:
    """Mean over a row's responses, then mean over the rows of a source.

    ``scorer`` maps a response column to a score; without it ``score`` is
    already one row per response of ``row_id``.
    """
    rows = df
    if scorer is not None:
        exploded = df.select("data_source", "row_id", "ground_truth", F.explode(responses).alias("response"))
        rows = exploded.select("data_source", "row_id", scorer(exploded).alias(score))
    per_row = rows.groupBy("data_source", "row_id").agg(F.avg(score).alias("s"))
    return per_row.groupBy("data_source").agg(F.avg("s").alias("test_score"), F.count(F.lit(1)).alias("n_rows"))


def subset_sizes(n: Column) -> Column:
    """2, 4, 8, … below n, then n itself; empty for a single response."""
    powers = F.filter(F.array(*[F.lit(1 << i).cast("bigint") for i in range(1, 63)]), lambda k: k < n)
    return F.when(n > 1, F.array_append(powers, n.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def _long(df: DataFrame, variables: list[str]) -> DataFrame:
    """Numeric variables only, one row per response and variable."""
    kinds = dict(df.dtypes)
    numeric = [v for v in variables if kinds[v] != "string"]
    casted = df.select(*KEYS, *[F.col(v).cast("double").alias(v) for v in numeric])
    return casted.unpivot(KEYS, numeric, "var", "v")


def order_statistics(long: DataFrame) -> DataFrame:
    """Distinct values of a prompt's variable with the ranks they occupy, and the least of them as ``base``."""
    keys = [*KEYS, "var"]
    counts = long.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("v").alias("base"), F.count(F.lit(1)).alias("__size"))
    placed = attach_group(counts, sizes, keys, "__size", ["v"]).drop("__size")
    cut = range_bucket(placed, "v", "__bucket")
    return running_sum(cut, keys, "__bucket", [F.col("v")], {"hi": "c"}).withColumn("lo", F.col("hi") - F.col("c"))


def validation_metrics(df: DataFrame, variables: list[str], vote: str | None = None, draws: int = 1000, seed: int = 42):
    """``(data_source, var, metric, value)`` averaged over prompts.

    mean@N and std@N are exact. best@n and worst@n of n draws with replacement
    have a closed form on order statistics, Σ v·[(hi/N)ⁿ − (lo/N)ⁿ], which
    replaces resampling. maj@n (when ``vote`` names a column) draws counts per
    vote by hash.
    """
    stats = order_statistics(_long(df, variables))
    keys = [*KEYS, "var"]
    spread = stats.withColumn("k", F.explode(subset_sizes(F.col("n"))))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    best = F.pow(F.col("hi") / n, k) - F.pow(F.col("lo") / n, k)
    worst = F.pow(1 - F.col("lo") / n, k) - F.pow(1 - F.col("hi") / n, k)
    # Moments are taken from the least value up, so a large offset costs no digits.
    v, base = F.col("v") - F.col("base"), F.min("base").alias("base")
    per_k = spread.groupBy(*keys, "k").agg(
        base,
        F.sum(v * best).alias("bm"),
        F.sum(v * v * best).alias("bs"),
        F.sum(v * worst).alias("wm"),
        F.sum(v * v * worst).alias("ws"),
    )

    def deviation(square: str, mean: str) -> Column:
        return F.sqrt(F.greatest(F.col(square) - F.col(mean) * F.col(mean), F.lit(0.0)))

    def named(kind: str, part: str, value: Column) -> Column:
        name = F.concat(F.lit(f"{kind}@"), F.col("k").cast("string"), F.lit(f"/{part}"))
        return F.struct(name.alias("metric"), value.alias("value"))

    bests = per_k.select(
        *keys,
        F.inline(
            F.array(
                named("best", "mean", F.col("base") + F.col("bm")),
                named("best", "std", deviation("bs", "bm")),
                named("worst", "mean", F.col("base") + F.col("wm")),
                named("worst", "std", deviation("ws", "wm")),
            )
        ),
    )
    c = F.col("c")
    moments = stats.groupBy(*keys).agg(
        base, F.max("n").alias("k"), (F.sum(c * v) / F.sum(c)).alias("m"), (F.sum(c * v * v) / F.sum(c)).alias("s")
    )
    size = F.col("k").cast("string")
    plain = moments.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.concat(F.lit("mean@"), size).alias("metric"), (F.col("base") + F.col("m")).alias("value")),
                F.struct(
                    F.concat(F.lit("std@"), size).alias("metric"),
                    F.when(F.col("k") > 1, deviation("s", "m")).alias("value"),
                ),
            )
        ),
    ).where(F.col("value").isNotNull())
    frames = [plain, bests]
    if vote is not None:
        kinds = dict(df.dtypes)
        for var in [x for x in variables if kinds[x] != "string"]:
            frames.append(majority_at(df, var, vote, draws, seed).withColumn("var", F.lit(var)))
    per_prompt = union_all(frames)
    return per_prompt.groupBy("data_source", "var", "metric").agg(F.avg("value").alias("value"))


def _requests(values: DataFrame, keys: list[str], draws: int) -> DataFrame:
    """One request per group, subset size k and draw, for k draws."""
    sizes = values.groupBy(*keys).agg(F.sum("c").alias("n"))
    wanted = sizes.withColumn("k", F.explode(subset_sizes(F.col("n"))))
    return wanted.select(*keys, "k", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"), F.col("k").alias("n"))


def bootstrap(df: DataFrame, value: str, draws: int = 1000, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of max, min and mean over the draws.

    Every group is drawn ``draws`` times at each of its subset sizes, with
    replacement. A draw is held as how often it hit each distinct value; NULLs
    are drawn but do not count.
    """
    keys = keys or KEYS
    values = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    drawn = multinomial(values, _requests(values, keys, draws), keys, value, "n", seed)
    known = F.when(F.col(value).isNotNull(), F.col("x"))
    per_draw = drawn.groupBy(*keys, "k", "draw").agg(
        F.max(value).alias("best"), F.min(value).alias("worst"), (F.sum(F.col(value) * F.col("x")) / F.sum(known)).alias("mean")
    )
    aggs = []
    for name in ("best", "worst", "mean"):
        aggs += [F.avg(name).alias(f"{name}_mean"), F.stddev_pop(name).alias(f"{name}_std")]
    return per_draw.groupBy(*keys, "k").agg(*aggs)


def majority_at(df: DataFrame, value: str, vote: str, draws: int, seed: int) -> DataFrame:
    """maj@n: value of the most frequent vote within each draw.

    Counts per vote are drawn; of equally frequent votes any may be seen first in
    a draw with the same chance, so a hash decides. The first value seen with the
    winning vote is one draw from that vote's values.
    """
    rows = df.select(*KEYS, F.col(vote).alias("vote"), F.col(value).cast("double").alias("value"))
    votes = rows.groupBy(*KEYS, "vote").agg(F.count(F.lit(1)).alias("c"))
    drawn = multinomial(votes, _requests(votes, KEYS, draws), KEYS, "vote", "n", seed)
    tie = hash48(*[F.col(c) for c in (*KEYS, "k", "draw", "vote")], F.lit(seed), F.lit("tie"))
    winners = drawn.groupBy(*KEYS, "k", "draw").agg(F.max_by(F.struct("vote"), F.struct("x", tie)).alias("w"))
    asked = winners.select(*KEYS, F.col("w.vote").alias("vote"), "k", "draw", F.lit(1).cast("bigint").alias("n"))
    values = rows.groupBy(*KEYS, "vote", "value").agg(F.count(F.lit(1)).alias("c"))
    picked = multinomial(values, asked, [*KEYS, "vote"], "value", "n", seed)
    per_k = picked.groupBy(*KEYS, "k").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    size = F.col("k").cast("string")
    return per_k.select(
        *KEYS,
        F.inline(
            F.array(
                F.struct(F.concat(F.lit("maj@"), size, F.lit("/mean")).alias("metric"), F.col("m").alias("value")),
                F.struct(F.concat(F.lit("maj@"), size, F.lit("/std")).alias("metric"), F.col("s").alias("value")),
            )
        ),
    )


def val_metric_names(metrics: DataFrame) -> DataFrame:
    """``val-core/…`` or ``val-aux/…`` name for every validation metric.

    Core: the core variable (``acc`` where a source has it, else ``reward``),
    a mean, majority or best metric, at the largest n of that variable.
    """
    sized = metrics.withColumn("__n", F.regexp_extract("metric", r"@(\d+)", 1).cast("bigint"))
    tops = sized.groupBy("data_source", "var").agg(F.max("__n").alias("__top"))
    cores = metrics.groupBy("data_source").agg(
        F.when(F.bool_or(F.col("var") == "acc"), "acc").otherwise(F.lit("reward")).alias("__core")
    )
    joined = sized.join(tops, ["data_source", "var"]).join(cores, "data_source")
    core = (
        (F.col("var") == F.col("__core"))
        & F.col("metric").rlike("^(mean|maj|best)")
        & F.contains(F.col("metric"), F.concat(F.lit("@"), F.col("__top").cast("string")))
    )
    section = F.when(core, F.lit("val-core")).otherwise(F.lit("val-aux"))
    return joined.select(F.concat_ws("/", section, "data_source", "var", "metric").alias("name"), "value")


def turn_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, max and mean of turn and tool-call counts."""
    aggs = []
    for name in columns:
        aggs += [
            F.min(name).alias(f"{name}_min"),
            F.max(name).alias(f"{name}_max"),
            F.avg(name).alias(f"{name}_mean"),
        ]
    return df.agg(*aggs)


def reduce_metrics(metrics: DataFrame) -> DataFrame:
    """One value per name: max if the name says max, min if it says min, else
    the mean. ``max`` wins over ``min``."""
    name = F.col("metric")
    return metrics.groupBy("metric").agg(
        F.when(F.contains(name, F.lit("max")), F.max("value"))
        .when(F.contains(name, F.lit("min")), F.min("value"))
        .otherwise(F.avg("value"))
        .alias("value")
    )


def merge_metrics(frames: list[DataFrame], meta: list[str] | None = None) -> DataFrame:
    """Concatenate metric tables; metadata columns must agree across them."""
    merged = union_all(frames)
    if not meta:
        return merged
    distinct = merged.agg(*[F.count_distinct(m).alias(m) for m in meta])
    worst = distinct.select(F.greatest(*[F.col(m) for m in meta], F.lit(0)).alias("w")).scalar()
    clash = F.raise_error(F.lit(f"conflicting metadata in {meta}")).cast("double")
    return merged.withColumn("value", F.when(worst > 1, clash).otherwise(F.col("value")))


def best_logged_value(lines: DataFrame, key: str = "critic/rewards/mean", target: float | None = None, line: str = "value"):
    """Largest value of a key in training log lines ``a:1 - b:2``."""
    parts = lines.select(F.explode(F.split(F.col(line), " - ", -1)).alias("part"))
    pair = F.split("part", ":", 2)
    values = parts.where(F.trim(F.get(pair, F.lit(0))) == key).select(
        F.trim(F.get(pair, F.lit(1))).try_cast("double").alias("v")
    )
    best = values.agg(F.max("v").alias("best"))
    return best if target is None else best.withColumn("passed", F.col("best") > target)
