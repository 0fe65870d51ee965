"""Predictions from responses: parse, grade, decide on abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.basics import let
from plumbline.functions.maths import minerva
from plumbline.functions.qa import answers_equal, em_check
from plumbline.functions.text import IDK_TOKEN, answer_with_fallbacks, confidence

# Contest sets graded as mathematics, and sets graded by exact match.
CONTEST_SETS = ["aime", "aime_2024", "aime_2025", "beyondaime"]
QA_SETS = ["simpleqa", "hotpotqa", "hotpot_qa", "nq_hotpotqa_searchr1"]
EM_SETS = [
    "nq_hotpotqa_searchr1",
    "hotpotqa",
    "hotpot_qa",
    "flashrag_nq",
    "flashrag_triviaqa",
    "flashrag_popqa",
    "flashrag_hotpotqa",
    "flashrag_2wikimultihopqa",
    "flashrag_musique",
    "flashrag_bamboogle",
]


def grade(
    df: DataFrame, t: float = 0.5, strategy: str = "verbalized_brier", dataset: str = "dataset", labels: str | None = None
) -> DataFrame:
    """Adds predicted answer, confidence, abstained, correct and is_correct.

    A grade label decides for QA sets that have one; contest sets use the maths
    rule, search-style sets exact match, all others lenient equality. Under
    ``explicit_risk`` only the IDK mark and the rule's own flag abstain.
    """
    response, golds = F.col("response"), F.col("ground_truth")
    gold = F.try_element_at(golds, F.lit(1))
    name = F.col(dataset)
    idk = F.contains(response, F.lit(IDK_TOKEN))
    label = F.col(labels) if labels else F.lit(None).cast("string")
    labelled = name.isin([*QA_SETS, *EM_SETS]) & label.isNotNull()
    contest = name.isin(CONTEST_SETS)
    stated = F.when(idk, 0.0).otherwise(1.0) if strategy == "explicit_risk" else confidence(response)
    bad = F.concat(F.lit("unknown grade label "), label)

    def by_label() -> Column:
        known = F.when(label == "correct", True).when(label.isin("incorrect", "not_attempted"), False)
        return F.coalesce(known, F.raise_error(bad).cast("boolean"))

    parsed = df.withColumn(
        "__p",
        let(
            F.struct(
                answer_with_fallbacks(response).alias("answer"),
                F.when(contest, minerva(response, gold)).alias("m"),
                F.when(idk, 0.0).otherwise(stated).alias("c"),
            ),
            lambda p: F.struct(
                F.when(contest & ~labelled, p["m"]["pred"]).otherwise(p["answer"]).alias("answer"),
                F.when(labelled & (label == "not_attempted"), 0.0).otherwise(p["c"]).alias("c"),
                F.when(labelled, label == "not_attempted")
                .when(contest, p["m"]["abstained"])
                .otherwise(F.lit(False))
                .alias("flag"),
                F.when(labelled, by_label())
                .when(contest, p["m"]["correct"])
                .when(name.isin(EM_SETS), p["answer"].isNotNull() & em_check(p["answer"], golds))
                .otherwise(p["answer"].isNotNull() & answers_equal(p["answer"], golds))
                .alias("correct"),
            ),
        ),
    )
    low = F.lit(False) if strategy == "explicit_risk" else F.col("__p.c") < t
    return (
        parsed.withColumn("predicted_answer", F.col("__p.answer"))
        .withColumn("confidence", F.col("__p.c").cast("double"))
        .withColumn("abstained", low | idk | F.col("__p.flag"))
        .withColumn("correct", F.col("__p.correct"))
        .withColumn("is_correct", F.col("correct") & ~F.col("abstained"))
        .drop("__p")
    )
