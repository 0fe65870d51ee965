"""Normal forms and matching rules for open-question answers."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.basics import let, number, strip

ARTICLES = r"(?U)\b(a|an|the)\b"


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_answer(c: Column) -> Column:
    """Lower case, punctuation deleted, then articles, then white space."""
    return squeeze(F.regexp_replace(F.translate(F.lower(c), string.punctuation, ""), ARTICLES, " "))


def normalize_text(c: Column) -> Column:
    """Articles first, then punctuation to blanks: differs on ``the-cat``."""
    blanks = " " * len(string.punctuation)
    return squeeze(F.translate(F.regexp_replace(F.lower(c), ARTICLES, " "), string.punctuation, blanks))


def normalize_basic(c: Column) -> Column:
    return squeeze(F.translate(F.lower(strip(c)), ",.!?;:", ""))


def em_check(pred: Column, golds: Column) -> Column:
    """Any gold answer equals the prediction in normal form."""
    hit = let(normalize_answer(pred), lambda p: F.exists(golds, lambda g: normalize_answer(g) == p))
    return F.coalesce(hit, F.lit(False))


def subem_check(pred: Column, golds: Column) -> Column:
    """Any gold answer is contained in the prediction in normal form."""
    hit = let(normalize_answer(pred), lambda p: F.exists(golds, lambda g: F.contains(p, normalize_answer(g))))
    return F.coalesce(hit, F.lit(False))


def _comparable(c: Column) -> Column:
    return F.struct(
        number(F.regexp_replace(c, r"[,\s]", "")).alias("number"), normalize_text(strip(c)).alias("text")
    )


def answers_equal(pred: Column, golds: Column) -> Column:
    """Any gold answer equal as a number within 1e-6, else as normalised text."""

    def same(p: Column, g: Column) -> Column:
        by_number = F.abs(p["number"] - g["number"]) < 1e-6
        return F.coalesce(by_number, p["text"] == g["text"])

    filled = F.transform(F.filter(golds, lambda g: g != ""), _comparable)
    hit = let(_comparable(pred), lambda p: F.exists(filled, lambda g: same(p, g)))
    return F.coalesce((pred != "") & hit, F.lit(False))
