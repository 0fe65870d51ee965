"""Sequences dealt to ranks and micro-batches with near-equal work.

The deal is a snake over sequences sorted by workload: rank order 0…k−1, then
k−1…0, and so on. It is parallel and deterministic; every rank gets the same
number of sequences up to one. Where counts may differ, sequences too large to
share a rank get one of their own and the others fill the rest by running load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.basics import workload
from plumbline.operators.scale import ordered, running_sum, written


def _snake(place: Column, k: Column | int) -> Column:
    """Part of the sequence at a 0-based place in the sorted order."""
    parts = k if isinstance(k, Column) else F.lit(k)
    turn, offset = F.floor(place / parts), F.pmod(place, parts)
    return F.when(turn % 2 == 0, offset).otherwise(parts - 1 - offset).cast("bigint")


def _places(df: DataFrame, keys: list[str], length: str, row_id: str, sums: dict[str, str] | None = None) -> DataFrame:
    """0-based place by falling workload, ties by id, as a written table; ``sums`` are totals of what comes before.

    Rows are put in order once; a place is counted within a bucket and across
    bucket sums, however many sequences have one length.
    """
    keyed = df.withColumns({"__k": -F.col(length), "__one": F.lit(1)})
    cut = ordered(keyed, [*keys, "__k", row_id], "lengths")
    totals = {"__place": "__one", **(sums or {})}
    placed = running_sum(cut, keys, "__bucket", [F.col("__k"), F.col(row_id)], totals, inclusive=False)
    return placed.drop("__k", "__one", "__bucket")


def balance(df: DataFrame, k: int, length: str = "length", row_id: str = "seq_id", minibatch: str | None = None) -> DataFrame:
    """Rank of each sequence, optionally balanced inside every mini-batch.

    ``slot`` orders a rank's sequences with small ones at both ends.
    """
    base = df if minibatch else df.withColumn("__g", F.lit(0))
    keys = [minibatch or "__g"]
    placed = _places(base, keys, length, row_id)
    turn = F.floor(F.col("__place") / k)
    slot = F.when(turn % 2 == 0, -turn).otherwise(turn)
    return (
        placed.withColumn("part", _snake(F.col("__place"), k))
        .withColumn("slot", slot.cast("bigint"))
        .withColumn("workload", workload(F.col(length)))
        .drop("__place", "__g")
    )


def balance_loads(df: DataFrame, k: int, length: str = "length", row_id: str = "seq_id") -> DataFrame:
    """``part`` of each sequence so that the parts' loads are near-equal, whatever their counts.

    A sequence with at least an even share of what is left gets a part of its own,
    largest first; the share of the others is computed anew each time. The rest, in
    falling order, goes to the part its running load reaches. No part is over its
    share by more than its last sequence. At most ``k`` loads come to the driver.
    """
    loaded = df.withColumn("workload", workload(F.col(length)))
    placed = written(_places(loaded.withColumn("__g", F.lit(0)), ["__g"], length, row_id, {"__load": "workload"}).drop("__g"), "loads")
    total = placed.agg(F.sum("workload")).first()[0] or 0
    own, rest = 0, total
    for r in placed.where(F.col("__place") < k).orderBy("__place").select("workload").collect():
        if own == k - 1 or r["workload"] * (k - own) < rest:
            break
        own, rest = own + 1, rest - r["workload"]
    share = max(rest, 1) / (k - own)
    middle = (F.col("__load") - (total - rest) + F.col("workload") / 2) / share
    shared = F.least(F.lit(k - 1), own + F.floor(middle))
    return placed.withColumn("part", F.when(F.col("__place") < own, F.col("__place")).otherwise(shared).cast("bigint")).drop("__place", "__load")


def micro_batches(
    df: DataFrame, max_tokens: int, min_n: int = 1, divisor: int = 1, length: str = "length", row_id: str = "seq_id"
) -> DataFrame:
    """Micro-batch of each sequence; no batch holds more tokens than the budget.

    Their number starts as ``min(rows, ceil(Σlen / max_tokens))``, raised to
    ``min_n`` and rounded up to the divisor. While some batch of the deal is over
    the budget, the number grows by the share it is over, up to one batch per
    sequence. A sequence over the budget is an error.
    """
    placed = written(_places(df.withColumn("__g", F.lit(0)), ["__g"], length, row_id).drop("__g"), "places")
    found = placed.agg(F.sum(length).alias("s"), F.max(length).alias("top"), F.count(F.lit(1)).alias("n")).first()
    if (found["top"] or 0) > max_tokens:
        raise ValueError(f"a sequence exceeds the budget of {max_tokens} tokens")
    rounded = lambda n: -(-max(n, min_n) // divisor) * divisor
    parts = rounded(min(found["n"], -(-(found["s"] or 0) // max_tokens)))
    while found["n"]:
        sums = placed.groupBy(_snake(F.col("__place"), parts).alias("b")).agg(F.sum(length).alias("s"))
        most = sums.agg(F.max("s")).first()[0]
        if most <= max_tokens:
            break
        parts = rounded(max(parts + 1, -(-parts * most // max_tokens)))
    return placed.withColumn("micro_batch", _snake(F.col("__place"), max(1, parts))).drop("__place")
