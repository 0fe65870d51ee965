"""Small column helpers the parsers and scorers are made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
LOG_RATIO_BOUND = 20.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a text expression that ``body`` uses more than once.

    Without it each use would repeat the whole expression tree.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.trim(c, F.lit(BLANKS))


def none_if_blank(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def number(c: Column) -> Column:
    """Text to double; anything that is not a plain decimal number is NULL."""
    return let(c, lambda v: F.when(v.rlike(NUMBER), strip(v).try_cast("double")))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Bound to ``[lo, hi]``; NaN and NULL stay as they are."""
    bounded = F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    return F.when(c.isNull() | F.isnan(c), c).otherwise(bounded)


def bounded_exp(c: Column, bound: float = LOG_RATIO_BOUND) -> Column:
    return F.exp(clip(c, -bound, bound))


def sigmoid(c: Column) -> Column:
    return F.when(c >= 0, 1 / (1 + F.exp(-c))).otherwise(F.exp(c) / (1 + F.exp(c)))


def log_sigmoid(c: Column) -> Column:
    return F.least(c, F.lit(0.0)) - F.log1p(F.exp(-F.abs(c)))


def last_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The last match of a pattern, or NULL."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(1))


def last_match_of(c: Column, patterns: list[str]) -> Column:
    """Over several patterns the match that starts latest.

    A later pattern wins when two start together.
    """

    def latest(text: Column) -> Column:
        found = []
        for rank, pattern in enumerate(patterns):
            greedy = f"(?s)^(.*)(?:{pattern})"
            before = F.try_element_at(F.regexp_extract_all(text, F.lit(greedy), F.lit(1)), F.lit(1))
            value = F.try_element_at(F.regexp_extract_all(text, F.lit(greedy), F.lit(2)), F.lit(1))
            found.append(
                F.when(
                    before.isNotNull(),
                    F.struct(F.length(before).alias("at"), F.lit(rank).alias("rank"), value.alias("value")),
                )
            )
        return F.array_max(F.array_compact(F.array(*found)))["value"]

    return latest(c)


def count_literal(c: Column, text: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(text), F.lit("")))) / len(text)).cast("int")


def workload(length: Column) -> Column:
    """Attention-aware cost of a sequence: linear term plus square."""
    return F.lit(24576) * length + length * length


def hash48(*parts: Column) -> Column:
    """48 bits of a digest of the inputs: the same on any engine, and exact as a double."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def uniform01(*parts: Column) -> Column:
    """Deterministic uniform number in [0, 1) from a hash of its inputs."""
    return hash48(*parts).cast("double") / F.lit(float(1 << 48))
