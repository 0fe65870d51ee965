"""Deterministic samples, shuffles, splits and resampling.

Random draws are hashes of a row id and a seed: they do not depend on
partitioning and come out the same when a lost task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.basics import hash48, uniform01
from plumbline.operators.draws import multinomial
from plumbline.operators.scale import lowest, range_bucket, running_sum, written

#: Rows, and draws, of one range of weights; draws made by one row of a plan.
RANGE_ROWS, DRAW_BLOCK = 1_000_000, 65_536


def shuffle_key(row_id: str, seed: int, *more) -> Column:
    """Hash order, exact as a double so that it can be bucketed."""
    return hash48(F.col(row_id), F.lit(seed), *more)


def sample_n(df: DataFrame, n: int, row_id: str, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """First n rows by id, or n random rows; the whole table if n is negative.

    The key of the n-th row is found first, then rows are kept by a filter.
    """
    if n < 0:
        return df
    if not shuffle:
        return lowest(df, n, [row_id])
    return lowest(df.withColumn("__k", shuffle_key(row_id, seed)), n, ["__k", row_id]).drop("__k")


def preview(df: DataFrame, n: int, text: str, seed: int = 42) -> DataFrame:
    """A seeded handful of rows for looking at."""
    return df.orderBy(hash48(F.col(text), F.lit(seed)), text).limit(n)


def split_random(df: DataFrame, test_size: float, row_id: str, seed: int = 0) -> DataFrame:
    """``test`` for about a fraction of the rows, by hash of the row id."""
    test = uniform01(F.col(row_id), F.lit(seed)) < test_size
    return df.withColumn("split", F.when(test, "test").otherwise(F.lit("train")))


def epoch_order(df: DataFrame, row_id: str, seed: int, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """Adds the sort key of an epoch: hashed, or the row id itself."""
    key = shuffle_key(row_id, seed, F.lit(epoch)) if shuffle else F.col(row_id)
    return df.withColumn("order_key", key)


def curriculum_order(df: DataFrame, scores: DataFrame, row_id: str) -> DataFrame:
    """Sort key from a score table; rows without a score come last."""
    joined = df.join(scores.select(row_id, "curriculum_score"), row_id, "left")
    return joined.withColumn("order_key", F.coalesce("curriculum_score", F.lit(float("inf"))))


def mini_batches(df: DataFrame, size: int, epochs: int, row_id: str, seed: int = 0) -> DataFrame:
    """Every epoch yields each row once, in seeded order, in equal batches.

    The row count must divide by ``size``.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    uneven = F.raise_error(F.lit(f"row count does not divide by {size}")).cast("bigint")
    copies = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    keyed = copies.withColumn("__k", shuffle_key(row_id, seed, F.col("epoch")))
    cut = range_bucket(keyed, "__k", "__bucket").withColumn("__one", F.lit(1))
    placed = running_sum(
        cut, ["epoch"], "__bucket", [F.col("__k"), F.col(row_id)], {"__i": "__one"}, inclusive=False
    )
    batch = F.floor(F.col("__i") / size).cast("bigint")
    return placed.withColumn("batch", F.when(total % size != 0, uneven).otherwise(batch)).drop(
        "__k", "__bucket", "__one", "__i"
    )


def assign_risk_t(df: DataFrame, row_id: str, override: str | None = None, seed: int = 0) -> DataFrame:
    """Risk threshold in ``[0, 1]``: the given one, else uniform to 3 places.

    A given value that is not a number becomes 0.5.
    """
    drawn = F.round(uniform01(F.col(row_id), F.lit(seed)), 3)
    if override is None:
        return df.withColumn("risk_t", drawn)
    given = F.coalesce(F.col(override).cast("string").try_cast("double"), F.lit(0.5))
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), given))
    return df.withColumn("risk_t", F.when(F.col(override).isNull(), drawn).otherwise(held))


def resample_weights(score: Column, method: str, power: float, lo: Column, hi: Column) -> Column:
    if method == "pow":
        w = F.pow(F.abs(score), F.lit(power))
    elif method == "max_min":
        w = F.when((score == hi) | (score == lo), 1.0).otherwise(0.0)
    elif method == "max_random":
        w = F.when(score == hi, 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown reweighting {method!r}")
    return F.greatest(w + 1e-8, F.lit(1e-8))


def pf_resample(
    df: DataFrame, method: str = "pow", power: float = 2.0, row_id: str = "seq_id", score: str = "score", seed: int = 0, rows: int = RANGE_ROWS
):
    """As many rows as the input has, drawn with replacement by weight: ``(draw, columns…)``.

    Rows are dealt by hash of their id to ranges of about ``rows`` rows, within
    which weights become shares of the range's weight, running up in the order of
    the ids. Ranges get their draws by one multinomial draw. Draw i of a range is a
    uniform number ``hash48(range, i, seed)``; a range with many draws is cut evenly
    into cells of about ``rows`` of them, and a row is listed in each cell its share
    reaches into. In a cell, rows and draws are sorted together and a draw takes the
    last row that starts at or before it. So neither a row that holds most of the
    weight nor many rows that hold none of it meet in one task. Ids are unique.
    """
    facts = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(F.lit(1)).alias("n")).alias("f")).first()["f"]
    weighted = df.select(
        F.struct(*df.columns).alias("__row"),
        F.pmod(hash48(F.col(row_id)), F.lit(max(1, -(-facts["n"] // rows)))).alias("__range"),
        resample_weights(F.col(score), method, power, F.lit(facts["lo"]), F.lit(facts["hi"])).alias("__w"),
    )
    totals = written(weighted.groupBy(F.lit(0).alias("__all"), "__range").agg(F.sum("__w").alias("c")), "ranges")
    asked = totals.groupBy("__all").agg(F.lit(facts["n"]).alias("n"))
    dealt = multinomial(totals, asked, ["__all"], "__range", "n", seed).join(totals, ["__all", "__range"])
    before = F.sum("x").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    cells = F.ceil(F.col("x") / rows).cast("bigint")
    parts = dealt.select("__range", "c", F.col("x").alias("__draws"), F.coalesce(before, F.lit(0)).alias("__first"), cells.alias("__cells"))
    parts = written(parts, "parts")
    # Draws are made in blocks that are dealt out before they become rows.
    blocks = parts.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__draws") - 1, F.lit(DRAW_BLOCK).cast("bigint"))))
    blocks = blocks.repartition("__range", "__from")
    last = F.least(F.col("__from") + DRAW_BLOCK, F.col("__draws")) - 1
    draws = blocks.withColumn("__i", F.explode(F.sequence("__from", last)))
    draws = draws.withColumn("__at", uniform01(F.col("__range"), F.col("__i"), F.lit(seed)))
    draws = draws.select(
        "__range", F.floor(F.col("__at") * F.col("__cells")).alias("__cell"), "__at", (F.col("__first") + F.col("__i")).alias("draw")
    )
    upward = W.partitionBy("__range").orderBy(F.col(f"__row.{row_id}")).rowsBetween(W.unboundedPreceding, -1)
    starts = weighted.withColumn("__lo", F.coalesce(F.sum("__w").over(upward), F.lit(0.0)))
    shares = starts.join(parts.select("__range", "c", "__cells"), "__range").withColumns(
        {"__at": F.col("__lo") / F.col("c"), "__to": (F.col("__lo") + F.col("__w")) / F.col("c")}
    )
    reach = [F.least(F.floor(F.col(c) * F.col("__cells")), F.col("__cells") - 1) for c in ("__at", "__to")]
    listed = shares.select("__range", F.explode(F.sequence(*reach)).alias("__cell"), "__at", "__row")
    order = [F.col("__at"), F.col("draw").isNotNull(), F.col(f"__row.{row_id}")]
    upto = W.partitionBy("__range", "__cell").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    met = listed.unionByName(draws, allowMissingColumns=True).withColumn("__hit", F.last("__row", ignorenulls=True).over(upto))
    return met.where("draw is not null").select("draw", "__hit.*")
