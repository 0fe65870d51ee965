"""Answers, confidences and tags read out of response text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.basics import (
    clip,
    count_literal,
    first_match,
    last_match,
    last_match_of,
    let,
    none_if_blank,
    number,
    strip,
)

# Response formats that the prompts ask for.
ANSWER_LINE = r"(?iU)Answer\s*:\s*([^\n]+)"
CONFIDENCE_LINE = r"(?iU)Confidence\s*:\s*([^\n]+)"
FINAL_ANSWER_LINE = r"(?iU)Final\s*Answer\s*:\s*([^\n]+)"
BEST_GUESS_LINE = r"(?iU)Best\s*Guess\s*:\s*([^\n]+)"
ANSWER_IS = r"(?iU)(?:My\s+answer\s+is|The\s+answer\s+is)\s*([^\n.]+)"
ANSWER_LINE_START = r"(?imU)^Answer\s*:\s*([^\n]+)"
FINAL_ANSWER_LINE_START = r"(?imU)^Final\s*Answer\s*:\s*([^\n]+)"
BEST_GUESS_LINE_START = r"(?imU)^Best\s*Guess\s*:\s*([^\n]+)"
ANSWER_IS_START = r"(?imU)^(?:My\s+answer\s+is|The\s+answer\s+is)\s*([^\n.]+)"
CLAIM_VALUE = r"(?iU)<\s*Confidence\b[^>]*\bvalue\s*=\s*([0-9]+(?:\.[0-9]+)?)"
CLAIM_BLOCK = r"(?isU)<\s*Confidence\b[^>]*\bvalue\s*=\s*[0-9]+(?:\.[0-9]+)?[^>]*>(.*?)<\s*/\s*Confidence\s*>"
LOOSE_CONFIDENCE = [
    r"[Cc]onfidence[:\s]+([0-9]*\.?[0-9]+)",
    r"置信度[:\s：]+([0-9]*\.?[0-9]+)",
]
API_CONFIDENCE = [
    r"(?i)confidence\s*(?:score)?\s*(?:is|=|:)\s*([0-9]*\.?[0-9]+)",
    r"(?i)confidence[:\s]+([0-9]*\.?[0-9]+)",
    r"置信度[:\s：]+([0-9]*\.?[0-9]+)",
]
SOLVED_NUMBER = r"#### (\-?[0-9\.\,]+)"
ANY_NUMBER = r"(\-?[0-9\.\,]+)"
CHOICE_LINE = r"(?iU)Answer[ \t]*:[ \t]*\$?([A-D])\$?"
THINK_THEN_ANSWER = r"(?sU)^\s*<think>(?:(?!</?(?:think|answer)>).)*</think>\s*<answer>(?:(?!</?(?:think|answer)>).)*</answer>\s*$"
THINK_THEN_BOX = r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"
IDK_TOKEN = "<IDK>"
IDK_SPELLINGS = ["<idk>", "<idk/>", "idk", "i don't know", "i do not know", "unknown"]
QUESTION_MARKERS = ["Question:", "Question："]
TRAINING_MARKERS = ["Question:", "Question：", "Problem:", "Problem："]
SOLUTION_MARK = "Solution:"
NO_ANSWER = "[INVALID]"


def extract_tag(c: Column, tag: str = "answer") -> Column:
    """Content of the last ``<tag>…</tag>``, trimmed; NULL if there is none."""
    return strip(last_match(c, f"(?s)<{tag}>(.*?)</{tag}>"))


def count_tags(c: Column, tag: str = "answer") -> Column:
    return F.struct(
        count_literal(c, f"<{tag}>").alias("opening"), count_literal(c, f"</{tag}>").alias("closing")
    )


def _balanced_prefix(text: Column) -> Column:
    """Text up to the brace that closes an already open one; NULL if none does."""
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("seen"), F.lit(-1).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        depth = s["depth"] + count_literal(piece, "{") - 1
        at = s["seen"] + F.length(piece)
        return F.struct(
            depth.alias("depth"),
            (at + 1).alias("seen"),
            F.when((s["end"] < 0) & (depth == 0), at).otherwise(s["end"]).alias("end"),
        )

    def closing(pieces: Column) -> Column:
        closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        return F.aggregate(closed, start, step, lambda s: s["end"])

    def prefix(after_open: Column) -> Column:
        end = let(F.split(after_open, r"\}", -1), closing)
        return let(end, lambda e: F.when(e >= 0, F.substring(after_open, F.lit(1), e)))

    return let(text, prefix)


def last_boxed(c: Column, loose: bool = False) -> Column:
    r"""Content of the last ``\boxed{…}`` with balanced braces, else NULL.

    ``loose`` also takes ``\boxed x`` up to the next dollar sign and ``\fbox{…}``.
    """
    boxed = F.when(c.contains("\\boxed{"), _balanced_prefix(F.substring_index(c, "\\boxed{", -1)))
    if not loose:
        return boxed
    spaced = F.when(
        c.contains("\\boxed "), F.substring_index(F.substring_index(c, "\\boxed ", -1), "$", 1)
    )
    framed = F.when(c.contains("\\fbox{"), _balanced_prefix(F.substring_index(c, "\\fbox{", -1)))
    return F.coalesce(spaced, F.when(c.contains("\\boxed{"), boxed).otherwise(framed))


def extract_answer_simple(c: Column) -> Column:
    """Unnested box, else first ``Answer:`` up to a bar, else the last line."""
    last_line = strip(F.substring_index(strip(c), "\n", -1))
    return F.coalesce(
        strip(first_match(c, r"\\boxed\{([^}]+)\}")),
        strip(first_match(c, r"(?iU)Answer:\s*([^|\n]+)")),
        strip(F.substring_index(last_line, "|", 1)),
    )


def answer_with_fallbacks(c: Column) -> Column:
    """Last answer line at a line start, with the looser wordings after it."""
    text = strip(c)
    return F.coalesce(
        none_if_blank(last_match(text, ANSWER_LINE_START)),
        none_if_blank(last_match(text, FINAL_ANSWER_LINE_START)),
        none_if_blank(last_match(text, BEST_GUESS_LINE_START)),
        none_if_blank(last_match(text, ANSWER_IS_START)),
        none_if_blank(extract_tag(text)),
    )


def qa_answer(c: Column) -> Column:
    """Answer of an open question: any wording anywhere, then the answer tag."""
    return F.coalesce(
        none_if_blank(last_match(c, ANSWER_LINE)),
        none_if_blank(last_match(c, FINAL_ANSWER_LINE)),
        none_if_blank(last_match(c, BEST_GUESS_LINE)),
        none_if_blank(last_match(c, ANSWER_IS)),
        none_if_blank(extract_tag(c)),
    )


def maths_answer(c: Column, fallbacks: bool = True) -> Column:
    """Answer line of a maths response; ``[INVALID]`` if nothing is found."""
    first = last_match(c, ANSWER_LINE)
    if not fallbacks:
        return F.coalesce(first, F.lit(NO_ANSWER))
    return F.coalesce(
        none_if_blank(first),
        none_if_blank(last_match(c, FINAL_ANSWER_LINE_START)),
        none_if_blank(last_match(c, BEST_GUESS_LINE_START)),
        none_if_blank(last_match(c, ANSWER_IS_START)),
        F.lit(NO_ANSWER),
    )


def confidence(c: Column, mode: str = "strict") -> Column:
    """Stated confidence in one of three modes.

    ``strict``: last ``Confidence:`` line; not a number → 1.0, absent → 0.5.
    ``loose``: first loose wording; percent allowed; absent → NULL.
    ``api``: text after ``</think>``, latest loose wording; absent → 0.5.
    """
    if mode == "strict":
        stated = last_match(c, CONFIDENCE_LINE)
        value = let(stated, lambda v: F.when(v.isNull(), F.lit(0.5)).otherwise(F.coalesce(number(v), F.lit(1.0))))
        return let(value, lambda v: clip(v, 0.0, 1.0))
    if mode == "loose":
        raw = F.coalesce(*[number(first_match(c, p)) for p in LOOSE_CONFIDENCE])
        return let(raw, lambda v: clip(F.when(v > 1, v / 100).otherwise(v), 0.0, 1.0))
    if mode == "api":
        after = strip(F.substring_index(c, "</think>", -1))
        raw = number(let(after, lambda t: last_match_of(t, API_CONFIDENCE)))
        value = let(raw, lambda v: F.when(v > 1, v / 100).otherwise(v))
        return let(value, lambda v: F.when(v.between(0.0, 1.0), v).otherwise(F.lit(0.5)))
    raise ValueError(f"unknown confidence mode {mode!r}")


def claim_part(c: Column) -> Column:
    """Text after the last ``Solution:``; NULL without one."""
    return F.when(c.contains(SOLUTION_MARK), F.substring_index(c, SOLUTION_MARK, -1))


def claim_values(c: Column) -> Column:
    """All claim confidences in the text, clipped; possibly empty."""
    found = F.regexp_extract_all(c, F.lit(CLAIM_VALUE), F.lit(1))
    return F.transform(found, lambda v: F.least(F.coalesce(number(v), F.lit(1.0)), F.lit(1.0)))


def claim_confidences(c: Column) -> Column:
    """Claim confidences of the final solution; ``[0.0]`` when there are none."""
    return let(
        claim_values(claim_part(c)),
        lambda values: F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(0.0))),
    )


def count_claims(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CLAIM_VALUE))


def claim_product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda a, b: a * b)


def claim_minimum(values: Column) -> Column:
    return F.array_min(values)


def parse_claim_labels(reply: Column, expected: Column) -> Column:
    """0/1 labels in a judge's reply, padded with 0 or cut to ``expected``.

    Takes ``{"steps": [{"acc": …}]}`` or a bare array; any other reply gives
    all zeros.
    """
    body = first_match(reply, r"(?s)(\{.*\})")
    steps = F.from_json(body, "steps ARRAY<STRUCT<acc: STRING>>")["steps"]
    bare = F.from_json(first_match(reply, r"(?s)(\[.*\])"), "ARRAY<STRING>")

    def bit(v: Column) -> Column:
        truthy = F.coalesce(number(v) > 0, F.lower(strip(v)) == "true", F.lit(False))
        return truthy.cast("int")

    labels = F.coalesce(
        F.transform(steps, lambda s: bit(s["acc"])),
        F.transform(bare, bit),
        F.array().cast("array<int>"),
    )
    return fit_labels(labels, expected)


def fit_labels(labels: Column, expected: Column) -> Column:
    """Pad with zeros or cut to the number of claims."""
    return F.slice(F.concat(labels, F.array_repeat(F.lit(0), expected)), F.lit(1), expected)


def parse_grade_letter(c: Column) -> Column:
    """First of A, B or C anywhere in a judge's reply, mapped to its label."""
    letter = F.regexp_extract(c, "(A|B|C)", 1)
    return (
        F.when(letter == "A", "correct").when(letter == "B", "incorrect").otherwise(F.lit("not_attempted"))
    )


def parse_boxed_verdict(c: Column) -> Column:
    return F.coalesce((last_boxed(c) == "True").cast("int"), F.lit(0))


def is_idk(c: Column) -> Column:
    """One of the fixed "I don't know" spellings."""
    norm = F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")
    return F.coalesce(norm.isin(IDK_SPELLINGS), F.lit(False))


def gsm8k_answer(c: Column, mode: str = "strict") -> Column:
    """Final number of a worked solution, wherever it stands."""
    if mode == "strict":
        found = last_match(c, SOLVED_NUMBER)
        return F.replace(F.replace(found, F.lit(","), F.lit("")), F.lit("$"), F.lit(""))
    numbers = F.regexp_extract_all(c, F.lit(ANY_NUMBER), F.lit(1))
    return let(
        numbers,
        lambda all_: F.coalesce(
            F.try_element_at(F.filter(all_, lambda n: n != "."), F.lit(-1)), F.try_element_at(all_, F.lit(1))
        ),
    )


def choice_answer(c: Column) -> Column:
    """Letter of a multiple-choice answer line."""
    return first_match(c, CHOICE_LINE)


def is_valid_think_answer(c: Column) -> Column:
    """Exactly one think block followed by one answer block, blanks between."""
    return c.rlike(THINK_THEN_ANSWER)


def think_boxed_format(c: Column) -> Column:
    return c.rlike(THINK_THEN_BOX).cast("double")


def clean_brackets(c: Column) -> Column:
    """Trim, turn title marks into full stops and drop bracketed notes."""
    titled = F.replace(strip(c), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(titled, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def ensure_question_mark(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?s)^(.*[^?])$", "$1?")


def strip_to_question(c: Column, markers: list[str] = QUESTION_MARKERS) -> Column:
    """First line after the last occurrence of the first marker that occurs."""

    def pick(text: Column) -> Column:
        lines = []
        for marker in markers:
            after = strip(F.substring_index(text, marker, -1))
            lines.append(F.when(text.contains(marker), strip(F.substring_index(after, "\n", 1))))
        return F.coalesce(*lines, text)

    return let(strip(c), pick)
