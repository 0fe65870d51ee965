"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (one category of each margin). The cell weights are
raked to one margin after the other until all margins hold; the ratio of raked
to counted tokens is a cell's calibrated weight, and documents are drawn in
proportion to it: at least ``KEEP`` of all tokens are expected to come out, and a
cell too scarce for its share repeats instead of thinning the others.
"""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, stored

#: Category that holds all values without a target, nulls too.
OTHER = "(other)"
ROUNDS, TOLERANCE = 2000, 1e-10
#: Share of all tokens that comes out at least, in expectation.
KEEP = 0.3

#: Production targets: shares of tokens per margin.
TARGETS = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.55, "de": 0.16, "fr": 0.17, "es": 0.12},
    "topic": {"brief": 0.02, "medium": 0.30, "long": 0.60, "licensed": 0.05, "tabular": 0.03},
}


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column, n_words: Column) -> Column:
    """Stand-in for a topic where a table carries none: what form a text has."""
    return (
        F.when(F.lower(text).contains("licen"), "licensed")
        .when(F.regexp_count(text, F.lit(r" \| ")) * 4 > n_words, "tabular")
        .when(n_words < 100, "brief")
        .when(n_words < 600, "medium")
        .otherwise("long")
    )


def rake(tokens: np.ndarray, margins: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of the cells of ``tokens`` whose sums along every axis are ``margins``.

    Empty cells stay empty. A margin's share of categories without tokens goes to
    its other categories. Margins that empty cells make unreachable are met as
    nearly as ``rounds`` rounds get them, the last one exactly.
    """
    total = tokens.sum()
    if not total > 0:
        return np.zeros_like(tokens, float)
    weights = tokens / total
    axes = range(tokens.ndim)
    wanted = []
    for axis, margin in zip(axes, margins):
        there = tokens.sum(axis=tuple(a for a in axes if a != axis)) > 0
        share = np.where(there, margin, 0.0)
        wanted.append(share / share.sum() if share.sum() > 0 else there / there.sum())
    for _ in range(rounds):
        worst = 0.0
        for axis in axes:
            now = weights.sum(axis=tuple(a for a in axes if a != axis))
            factor = np.divide(wanted[axis], now, out=np.zeros_like(now), where=now > 0)
            worst = max(worst, float(np.abs(now - wanted[axis]).max()))
            weights = weights * factor.reshape([-1 if a == axis else 1 for a in axes])
        if worst < tolerance:
            break
    return weights


def calibrate(docs: DataFrame, tokens: str, targets: dict[str, dict[str, float]], keep: float = KEEP) -> list[tuple]:
    """(category of each margin ..., weight, probability, expected copies) of every cell that has rows.

    There are at most ``(targets + 1)`` categories per margin, whatever the table
    holds, so the cells are bounded by the parameters. Values without a target
    share the category ``OTHER``, which keeps its natural share. ``weight`` is
    raked over counted tokens (1 for cells without tokens). ``probability`` is the
    weight over the largest weight: the most that a draw without repeats allows.
    Expected copies are the weight times ``keep``, or the probability where the
    largest weight lets more through than that; they pass 1 in scarce cells. Both
    give expected tokens the target margins.
    """
    names = list(targets)
    rows = docs.groupBy(*[category(F.col(c), targets[c]).alias(c) for c in names]).agg(F.sum(tokens).alias("n")).collect()
    values = [[*targets[c], OTHER] for c in names]
    place = [{v: i for i, v in enumerate(one)} for one in values]
    counted = np.zeros([len(v) for v in values])
    for row in rows:
        counted[tuple(place[i][row[c]] for i, c in enumerate(names))] = float(row["n"] or 0)
    total, margins = max(counted.sum(), 1.0), []
    for axis, c in enumerate(names):
        natural = counted.sum(axis=tuple(a for a in range(len(names)) if a != axis))[-1] / total
        share = np.array([*targets[c].values(), 0.0], float)
        share = share / max(share.sum(), 1e-300) * (1 - natural)
        share[-1] = natural
        margins.append(share)
    raked = rake(counted, margins) * total
    weight = np.divide(raked, counted, out=np.ones_like(counted), where=counted > 0)
    top = weight[counted > 0].max() if (counted > 0).any() else 1.0
    chance = np.where(counted > 0, weight / max(top, 1e-300), 1.0)
    copies = np.where(counted > 0, weight * max(keep, 1 / max(top, 1e-300)), 1.0)
    at = {tuple(row[c] for c in names) for row in rows}
    return [
        (*key, float(weight[i]), float(chance[i]), float(copies[i]))
        for key, i in zip(product(*values), np.ndindex(*counted.shape))
        if key in at
    ]


def category(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin(list(targets)), value).otherwise(F.lit(OTHER))


def sample(
    docs: DataFrame,
    targets: dict[str, dict[str, float]] = TARGETS,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 9,
    keep: float = KEEP,
) -> DataFrame:
    """``docs`` with ``topic, n_tokens, weight, probability, copies, kept``.

    ``copies`` says how often a row belongs in the mix (``repeated`` writes them
    out) and ``kept`` whether it does: the whole part of its expected copies, and
    one more if a hash of the id falls below the rest. So a task run again draws
    the same rows and rows that repeat an id share their fate (null ids too).
    ``n_tokens`` are words; null and empty texts have none and, alone in a cell,
    are kept once. An existing ``topic`` column is used as it is; columns with one
    of the other names are replaced.
    """
    docs = docs.drop("n_tokens", "weight", "probability", "copies", "kept").withColumn("n_tokens", words_in(F.col(text_col)))
    if "topic" not in docs.columns:
        docs = docs.withColumn("topic", topic_of(F.coalesce(F.col(text_col), F.lit("")), F.col("n_tokens")))
    names = list(targets)
    keys = {c: fresh(docs, f"cell_{c}") for c in names}
    expected = fresh(docs, "expected")
    cells = calibrate(stored(docs.select(*names, "n_tokens"), "cells"), "n_tokens", targets, keep)
    schema = ", ".join(f"`{keys[c]}` string" for c in names) + f", weight double, probability double, `{expected}` double"
    table = docs.sparkSession.createDataFrame(cells, schema)
    for c in names:
        docs = docs.withColumn(keys[c], category(F.col(c), targets[c]))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = F.floor(F.col(expected))
    # The cell table is bounded by the number of targets, so it may be broadcast.
    drawn = docs.join(F.broadcast(table), list(keys.values())).withColumn("copies", whole + (draw < F.col(expected) - whole).cast("long"))
    return drawn.withColumn("kept", F.col("copies") > 0).drop(*keys.values(), expected)


def repeated(mixed: DataFrame) -> DataFrame:
    """Rows of ``sample``, each as often as ``copies`` says."""
    one = fresh(mixed, "copy")
    return mixed.withColumn(one, F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).drop(one)
