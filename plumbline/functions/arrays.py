"""Token arrays: padding, truncation, masks and packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_array(c: Column, length: int, value, left: bool = False) -> Column:
    """Pad to ``length``; a longer array is left as it is."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(c), F.lit(0)))
    return F.concat(fill, c) if left else F.concat(c, fill)


def unpad_left(ids: Column, mask: Column) -> Column:
    """Drop left padding: keep as many trailing ids as the mask has ones."""
    kept = F.aggregate(mask, F.lit(0), lambda a, b: a + b.cast("int"))
    return F.when(kept == 0, F.slice(ids, F.lit(1), F.lit(0))).otherwise(F.slice(ids, -kept, kept))


def truncate_tokens(c: Column, limit: int, mode: str = "right") -> Column:
    """Fit to ``limit`` tokens: keep last (left), first (right), both ends
    (middle), or fail (error)."""
    if mode == "left":
        cut = F.slice(c, F.lit(-limit), F.lit(limit))
    elif mode == "right":
        cut = F.slice(c, F.lit(1), F.lit(limit))
    elif mode == "middle":
        head = limit // 2
        tail = limit - head
        cut = F.concat(F.slice(c, F.lit(1), F.lit(head)), F.slice(c, F.lit(-tail), F.lit(tail)))
    elif mode == "error":
        message = F.concat(F.lit("sequence longer than limit: "), F.size(c).cast("string"))
        cut = F.raise_error(message).cast("array<bigint>")
    else:
        raise ValueError(f"unknown truncation {mode!r}")
    return F.when(F.size(c) > limit, cut).otherwise(c)


def truncate_keep_tail(c: Column, limit: int, tail: int = 4) -> Column:
    """Over the limit: the first ``limit − tail`` tokens and the last ``tail``."""
    cut = F.concat(F.slice(c, F.lit(1), F.lit(limit - tail)), F.slice(c, F.lit(-tail), F.lit(tail)))
    return F.when(F.size(c) > limit, cut).otherwise(c)


def response_mask(ids: Column, eos_ids: list[int]) -> Column:
    """1 up to and including the first end token, 0 after it."""
    ends = F.array_compact(F.array(*[F.nullif(F.array_position(ids, e), F.lit(0)) for e in eos_ids]))
    stop = F.coalesce(F.array_min(ends), F.size(ids).cast("bigint"))
    return F.transform(ids, lambda _, i: (i < stop).cast("int"))


def slice_mask(mask: Column, response_length: int) -> Column:
    """The last ``response_length`` entries, or all if there are fewer."""
    return F.slice(mask, F.greatest(F.size(mask) - response_length + 1, F.lit(1)), F.lit(response_length))


def position_ids(mask: Column) -> Column:
    """Running count of valid tokens minus one, never below zero."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        n = s["n"] + m.cast("int")
        return F.struct(n.alias("n"), F.array_append(s["out"], F.greatest(n - 1, F.lit(0))).alias("out"))

    return F.aggregate(mask, start, step, lambda s: s["out"])


def pieces(c: Column, n: int) -> Column:
    """Cut an array into ``n`` equal runs."""
    width = (F.size(c) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(c, i * width + 1, width))


def token_diff(a: Column, b: Column, mask: Column) -> Column:
    """Valid positions where two token arrays differ."""
    cells = F.arrays_zip(a.alias("a"), b.alias("b"), mask.alias("m"))
    return F.aggregate(
        cells, F.lit(0), lambda n, x: n + F.when((x["m"] == 1) & (x["a"] != x["b"]), 1).otherwise(0)
    )


def whitespace_tokens(c: Column) -> Column:
    """Stand-in tokeniser: 31-bit hashes of white-space separated words."""
    words = F.filter(F.split(c, r"\s+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(1 << 31)))
