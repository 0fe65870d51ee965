"""Reward rules: response table in, scored table out.

A scorer maps a DataFrame to one struct column ``score, acc, confidence,
abstention, pred``. Input columns are ``data_source, response, ground_truth``
(``ARRAY<STRING>``) and, by rule, ``risk_t``, ``critic_value``, ``num_turns``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.basics import clip, let
from plumbline.functions.maths import (
    is_equiv,
    lenient_answer,
    lenient_equal,
    minerva,
    normalize_final_answer,
    strict_box_pred,
)
from plumbline.functions.qa import em_check, subem_check
from plumbline.functions.text import (
    NO_ANSWER,
    choice_answer,
    claim_confidences,
    claim_minimum,
    claim_part,
    claim_product,
    confidence,
    count_tags,
    extract_tag,
    gsm8k_answer,
    is_idk,
    is_valid_think_answer,
    last_boxed,
    qa_answer,
    think_boxed_format,
)
from plumbline.operators.filters import is_maths, is_qa, norm_source
from plumbline.operators.registry import SCORERS, register_scorer

NOTHING = "<NO_ANSWER>"


def score(df: DataFrame, strategy: str, out: str = "result", strict: bool = True, **options) -> DataFrame:
    """Add the struct of a named reward rule.

    A data source the rule does not know is an error, or gives NULL if not ``strict``.
    """
    result = SCORERS.get(strategy)(df, **options)
    if not strict and strategy in KNOWN_SOURCES:
        result = F.when(KNOWN_SOURCES[strategy](F.col("data_source")), result)
    return df.withColumn(out, result)


def _result(score_: Column, acc: Column, pred: Column, conf: Column | None = None, abstained: Column | None = None):
    return F.struct(
        score_.cast("double").alias("score"),
        acc.cast("boolean").alias("acc"),
        (F.lit(None) if conf is None else conf).cast("double").alias("confidence"),
        (F.lit(None) if abstained is None else abstained).cast("boolean").alias("abstention"),
        pred.cast("string").alias("pred"),
    )


def _response() -> Column:
    return F.col("response")


def _gold() -> Column:
    return F.try_element_at("ground_truth", F.lit(1))


def _unsupported(rule: str) -> Column:
    message = F.concat(F.lit(f"{rule} has no rule for data source "), F.coalesce("data_source", F.lit("NULL")))
    return F.raise_error(message).cast("struct<score:double,acc:boolean,confidence:double,abstention:boolean,pred:string>")


def _sign(ok: Column) -> Column:
    return F.when(ok, 1.0).otherwise(-1.0)


def _unit(ok: Column) -> Column:
    return F.when(ok, 1.0).otherwise(0.0)


def _qa_attempt(answer: Column) -> Column:
    """``STRUCT<answer, idk, correct>`` of an extracted answer."""
    return let(
        answer,
        lambda a: F.struct(
            a.alias("answer"),
            is_idk(a).alias("idk"),
            (a.isNotNull() & ~is_idk(a) & em_check(a, F.col("ground_truth"))).alias("correct"),
        ),
    )


@register_scorer("baseline")
def score_binary(df: DataFrame) -> Column:
    """+1 for right, −1 for everything else, abstention included."""
    maths = let(
        minerva(_response(), _gold()),
        lambda m: _result(_sign(m["correct"]), m["correct"], m["pred"], abstained=m["abstained"]),
    )
    qa = let(
        _qa_attempt(qa_answer(_response())),
        lambda a: _result(
            _sign(a["correct"]), a["correct"], F.coalesce(a["answer"], F.lit(NOTHING)), abstained=a["idk"]
        ),
    )
    source = F.col("data_source")
    return F.when(is_maths(source), maths).when(is_qa(source), qa).otherwise(score_router(df))


def _risk(df: DataFrame, ceiling: float) -> Column:
    t = F.col("risk_t").cast("double") if "risk_t" in df.columns else F.lit(None).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(ceiling), F.coalesce(F.nanvl(t, F.lit(0.5)), F.lit(0.5))))


@register_scorer("explicit_risk")
def score_explicit_risk(df: DataFrame) -> Column:
    """1 for right, 0 for abstaining, −t/(1 − t) for wrong.

    Open questions are answered only inside the answer tag; no tag is wrong.
    """
    # Largest usable threshold for mathematics and for questions.
    t_maths, t_qa = _risk(df, 0.999999), _risk(df, 0.999)
    maths = let(
        minerva(_response(), _gold()),
        lambda m: _result(
            F.when(m["abstained"], 0.0).when(m["correct"], 1.0).otherwise(-t_maths / (1 - t_maths)),
            m["correct"],
            m["pred"],
            abstained=m["abstained"],
        ),
    )
    qa = let(
        _qa_attempt(extract_tag(_response())),
        lambda a: _result(
            F.when(a["idk"], 0.0).when(a["correct"], 1.0).otherwise(-t_qa / (1 - t_qa)),
            a["correct"],
            F.coalesce(a["answer"], F.lit(NOTHING)),
            abstained=a["idk"],
        ),
    )
    source = F.col("data_source")
    return F.when(is_maths(source), maths).when(is_qa(source), qa).otherwise(score_router(df))


def brier_rule(p: Column, ok: Column) -> Column:
    return 2 * p * _unit(ok) - p * p


def cross_entropy_rule(p: Column, ok: Column, eps: float = 0.01) -> Column:
    e = min(0.49, max(1e-6, float(eps)))
    q = F.greatest(F.lit(e), F.least(F.lit(1 - e), p))
    gain = F.when(ok, F.ln(q / e)).otherwise(F.ln((1 - q) / (1 - e)))
    return gain / math.log((1 - e) / e)


def jeffreys_rule(p: Column, ok: Column) -> Column:
    return (2 / math.pi) * (_sign(ok) * F.asin(F.sqrt(p)) + F.sqrt(p * (1 - p)))


def _confidence_rule(rule, name: str, qa_allowed: bool = True) -> Column:
    """Apply a proper scoring rule to the stated confidence of a response."""
    tail = _response()
    maths = let(
        F.struct(minerva(tail, _gold(), fallbacks=True).alias("m"), confidence(tail).alias("p")),
        lambda x: _result(rule(x["p"], x["m"]["correct"]), x["m"]["correct"], x["m"]["pred"], x["p"]),
    )
    qa = let(
        F.struct(_qa_attempt(qa_answer(_response())).alias("a"), confidence(_response()).alias("p")),
        lambda x: _result(
            rule(x["p"], x["a"]["correct"]),
            x["a"]["correct"],
            F.coalesce(x["a"]["answer"], F.lit(NO_ANSWER)),
            x["p"],
        ),
    )
    source = F.col("data_source")
    chain = F.when(is_maths(source), maths)
    if qa_allowed:
        chain = chain.when(is_qa(source), qa)
    return chain.otherwise(_unsupported(name))


@register_scorer("verbalized_brier")
def score_brier(df: DataFrame) -> Column:
    return _confidence_rule(brier_rule, "verbalized_brier")


@register_scorer("verbalized_ce")
def score_cross_entropy(df: DataFrame, eps: float = 0.01) -> Column:
    return _confidence_rule(lambda p, ok: cross_entropy_rule(p, ok, eps), "verbalized_ce")


@register_scorer("jeffreys")
def score_jeffreys(df: DataFrame) -> Column:
    return _confidence_rule(jeffreys_rule, "jeffreys", qa_allowed=False)


@register_scorer("critic_value")
def score_critic_value(df: DataFrame, rescale: bool = True) -> Column:
    """A logged value as confidence; rows without one get the binary rule."""
    if "critic_value" not in df.columns:
        return score_binary(df)
    v = F.col("critic_value").cast("double")
    mapped = F.when((v < 0) | (v > 1), (v + 1) / 2).otherwise(v) if rescale else v
    valued = let(
        minerva(_response(), _gold()),
        lambda m: let(
            clip(mapped, 0.0, 1.0),
            lambda p: _result(brier_rule(p, m["correct"]), m["correct"], m["pred"], p, m["abstained"]),
        ),
    )
    return F.when(v.isNull(), score_binary(df)).otherwise(valued)


def _claim_rule(pooled, name: str) -> Column:
    part = claim_part(_response())
    graded = let(
        F.struct(
            minerva(F.coalesce(part, F.lit("")), _gold()).alias("m"),
            pooled(claim_confidences(_response())).alias("p"),
            part.isNotNull().alias("solved"),
        ),
        lambda x: let(
            F.struct((x["solved"] & (x["m"]["pred"] == _normal_gold())).alias("ok"), x["p"].alias("p"), x["m"]["pred"].alias("pred")),
            lambda g: _result(brier_rule(g["p"], g["ok"]), g["ok"], g["pred"], g["p"]),
        ),
    )
    return F.when(is_maths(F.col("data_source")), graded).otherwise(_unsupported(name))


def _normal_gold() -> Column:
    return normalize_final_answer(_gold())


@register_scorer("claim_product")
def score_claim_product(df: DataFrame) -> Column:
    return _claim_rule(claim_product, "claim_product")


@register_scorer("claim_minimum")
def score_claim_minimum(df: DataFrame) -> Column:
    return _claim_rule(claim_minimum, "claim_minimum")


def _tagged_match(check, format_score: float, full: float, quarter_on_spam: bool) -> Column:
    tags = count_tags(_response())
    spam = (tags["opening"] > 10) | (tags["closing"] > 10)
    top = F.when(spam, full / 4).otherwise(F.lit(full)) if quarter_on_spam else F.lit(full)
    return let(
        extract_tag(_response()),
        lambda a: let(
            check(a, F.col("ground_truth")),
            lambda ok: _result(
                F.when(a.isNull(), 0.0).when(ok, top).otherwise(F.lit(format_score)), F.coalesce(ok, F.lit(False)), a
            ),
        ),
    )


@register_scorer("qa_em")
def score_em(df: DataFrame, format_score: float = 0.0, full: float = 1.0) -> Column:
    """Exact match; quartered when the response repeats its answer tags."""
    return _tagged_match(em_check, format_score, full, True)


@register_scorer("qa_subem")
def score_subem(df: DataFrame, format_score: float = 0.0, full: float = 1.0) -> Column:
    return _tagged_match(subem_check, format_score, full, False)


@register_scorer("gsm8k")
def score_gsm8k(df: DataFrame, mode: str = "strict", format_score: float = 0.0, full: float = 1.0) -> Column:
    return let(
        gsm8k_answer(_response(), mode),
        lambda a: _result(
            F.when(a.isNull(), 0.0).when(a == _gold(), full).otherwise(F.lit(format_score)),
            F.coalesce(a == _gold(), F.lit(False)),
            a,
        ),
    )


@register_scorer("math")
def score_math_boxed(df: DataFrame) -> Column:
    return let(
        last_boxed(_response(), loose=True),
        lambda b: let(b.isNotNull() & is_equiv(b, _gold()), lambda ok: _result(_unit(ok), ok, b)),
    )


@register_scorer("math_dapo")
def score_math_dapo(df: DataFrame, strict: bool = False) -> Column:
    """±1 by answer line, or by strict box."""
    if strict:
        return let(
            strict_box_pred(_response()),
            lambda b: let(F.coalesce(b == _gold(), F.lit(False)), lambda ok: _result(_sign(ok), ok, b)),
        )
    tail = _response()
    return let(
        minerva(tail, _gold()),
        lambda m: let(
            (m["pred"] == _normal_gold()), lambda ok: _result(_sign(ok), F.coalesce(ok, F.lit(False)), m["pred"])
        ),
    )


@register_scorer("geo3k")
def score_geo(df: DataFrame, format_score: float = 0.1) -> Column:
    """Accuracy 0.9 and format 0.1, equality without symbolic algebra."""
    return let(
        last_boxed(_response()),
        lambda b: let(
            lenient_equal(b, _gold()) == "correct",
            lambda ok: _result(
                (1 - format_score) * _unit(ok) + format_score * think_boxed_format(_response()), ok, b
            ),
        ),
    )


@register_scorer("prime_math")
def score_math_lenient(df: DataFrame) -> Column:
    """1 for right; ``acc`` is NULL where only algebra could decide."""
    return let(
        lenient_answer(_response()),
        lambda a: let(
            lenient_equal(a["answer"], _gold()),
            lambda v: _result(
                _unit(v == "correct"), F.when(v == "correct", True).when(v == "wrong", False), a["answer"]
            ),
        ),
    )


@register_scorer("gpqa")
def score_choice(df: DataFrame) -> Column:
    return let(
        choice_answer(_response()),
        lambda a: let(F.coalesce(a == _gold(), F.lit(False)), lambda ok: _result(_unit(ok), ok, a)),
    )


@register_scorer("char_count")
def score_char_count(df: DataFrame) -> Column:
    return let(
        last_boxed(_response()),
        lambda b: let(F.coalesce(b == _gold(), F.lit(False)), lambda ok: _result(_unit(ok), ok, b)),
    )


def format_and_answer(df: DataFrame) -> DataFrame:
    """The two parts of the think/answer rule as columns."""
    answer = extract_tag(_response())
    gold = F.transform("ground_truth", lambda g: F.trim(g))
    right = let(answer, lambda a: (a != "") & F.array_contains(gold, a))
    return df.withColumn("format_reward", _unit(is_valid_think_answer(_response()))).withColumn(
        "answer_reward", _unit(F.coalesce(right, F.lit(False)))
    )


@register_scorer("fact_naive")
def score_format_answer(df: DataFrame) -> Column:
    """Format point plus answer point, answers compared as plain text."""
    gold = F.transform("ground_truth", lambda g: F.trim(g))
    return let(
        extract_tag(_response()),
        lambda a: let(
            F.coalesce((a != "") & F.array_contains(gold, a), F.lit(False)),
            lambda ok: _result(_unit(is_valid_think_answer(_response())) + _unit(ok), ok, a),
        ),
    )


@register_scorer("tool_math")
def score_tool_bonus(df: DataFrame) -> Column:
    """Strict box; a wrong answer earns back a little per tool turn, up to 0."""
    bonus = (F.col("num_turns") - 2) / 2 * 0.1
    return let(
        strict_box_pred(_response()),
        lambda b: let(
            F.coalesce(b == _gold(), F.lit(False)),
            lambda ok: _result(
                F.when(ok, 1.0).otherwise(F.least(F.lit(0.0), bonus - 1.0)), ok, F.coalesce(b, F.lit(""))
            ),
        ),
    )


def overlong_penalty(df: DataFrame, max_length: int, buffer: int, factor: float, length: str = "response_length"):
    """Linear penalty inside the last ``buffer`` tokens, added to ``score``."""
    over = F.col(length) - (max_length - buffer)
    penalty = F.least(-over / F.lit(buffer) * factor, F.lit(0.0))
    return (
        df.withColumn("overlong_reward", penalty)
        .withColumn("score", F.col("score") + F.col("overlong_reward"))
        .withColumn("overlong", F.col("overlong_reward") < 0)
    )


# Data sources of each rule.
ROUTES = {
    "gsm8k": ["openai/gsm8k"],
    "math": ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"],
    "math_dapo": ["math_dapo", "math", "math_dapo_reasoning"],
    "prime_math": [
        "numina_aops_forum",
        "numina_synthetic_math",
        "numina_amc_aime",
        "numina_synthetic_amc",
        "numina_cn_k12",
        "numina_olympiads",
    ],
    "geo3k": ["hiyouga/geometry3k"],
    "qa_em": [
        "searchR1_nq",
        "searchR1_triviaqa",
        "searchR1_popqa",
        "searchR1_hotpotqa",
        "searchR1_2wikimultihopqa",
        "searchR1_musique",
        "searchR1_bamboogle",
    ],
}


@register_scorer("by_source")
def score_router(df: DataFrame) -> Column:
    """Rule picked by data source; an unknown source is an error."""
    source = F.col("data_source")
    chain = F.when(source.isNull(), _unsupported("by_source"))
    for rule, names in ROUTES.items():
        here = source.isin(names)
        if rule == "math_dapo":
            here = here | source.startswith("aime")
        chain = chain.when(here, SCORERS.get(rule)(df))
    return chain.otherwise(_unsupported("by_source"))


#: Data sources of the rules that do not know every one.
KNOWN_SOURCES = {
    "jeffreys": is_maths,
    "claim_product": is_maths,
    "claim_minimum": is_maths,
    "by_source": lambda source: source.isin([n for names in ROUTES.values() for n in names]) | source.startswith("aime"),
}


def normalized_source(df: DataFrame) -> DataFrame:
    return df.withColumn("data_source", norm_source(F.col("data_source")))


def submission_penalty(df: DataFrame, dialogue: str = "conv_id", turn: str = "turn", score: str = "score"):
    """0 where a submission beats the previous one (start 0), else −0.05.

    One window per dialogue: a dialogue is as long as its turns.
    """
    before = F.lag(score, 1, 0.0).over(W.partitionBy(dialogue).orderBy(turn))
    return df.withColumn("penalty", F.when(F.col(score) > before, 0.0).otherwise(-0.05))


def last_assistant(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Last assistant message of each dialogue; blank without one."""
    text = F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn")))
    return turns.groupBy(key).agg(F.coalesce(text, F.lit("")).alias("response"))
