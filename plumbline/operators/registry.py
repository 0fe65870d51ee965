"""Named scorers, estimators, losses and row builders.

Entries are functions on columns or DataFrames, so what a user registers is
planned by Spark like everything else. Python code over rows is possible only
through the batch hooks at the end, which run on Arrow batches.
"""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Registry:
    """Name → function; a name cannot be given to another function."""

    def __init__(self, kind: str):
        self.kind = kind
        self._entries: dict[str, Callable] = {}

    def register(self, name: str) -> Callable:
        def add(fn: Callable) -> Callable:
            known = self._entries.get(name)
            if known is not None and known is not fn:
                raise ValueError(f"{self.kind} {name!r} is already registered")
            self._entries[name] = fn
            return fn

        return add

    def get(self, name: str) -> Callable:
        if name not in self._entries:
            raise ValueError(f"unknown {self.kind} {name!r}; have {self.names()}")
        return self._entries[name]

    def names(self) -> list[str]:
        return sorted(self._entries)


SCORERS = Registry("scorer")
ADVANTAGES = Registry("advantage estimator")
LOSSES = Registry("policy loss")
BUILDERS = Registry("row builder")

register_scorer = SCORERS.register
register_advantage = ADVANTAGES.register
register_loss = LOSSES.register


def register_builder(name: str) -> Callable:
    """Register a ``DataFrame -> DataFrame`` builder; a non-callable is an error."""

    def add(fn: Callable) -> Callable:
        if not callable(fn):
            raise TypeError(f"row builder {name!r} must be callable")
        return BUILDERS.register(name)(fn)

    return add


def get_reward_function(strategy: str, **options) -> Callable:
    """Scorer of a strategy with options bound; unknown names are an error."""
    return functools.partial(SCORERS.get(strategy), **options)


def load_function(path: str, **options) -> Callable:
    """``package.module:name`` → callable with options bound."""
    module, _, name = path.partition(":")
    return functools.partial(getattr(importlib.import_module(module), name), **options)


def with_token_ids(
    df: DataFrame, load_tokenizer: Callable[[], Callable[[str], list[int]]], text: str, out: str = "token_ids"
) -> DataFrame:
    """Token ids from the caller's tokeniser, loaded once per Python worker."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load_tokenizer()
        for batch in batches:
            yield batch.map(lambda t: None if t is None else [int(i) for i in tokenizer(t)])

    return df.withColumn(out, encode(F.col(text)))


def score_batch(
    df: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], response: str, gold: str, out: str = "score"
) -> DataFrame:
    """Scores from a vectorised Python scorer over Arrow batches of rows."""

    @F.pandas_udf(T.DoubleType())
    def run(responses: pd.Series, golds: pd.Series) -> pd.Series:
        return pd.Series(scorer(responses.tolist(), golds.tolist()), dtype="float64")

    return df.withColumn(out, run(F.col(response), F.col(gold)))
