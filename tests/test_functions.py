"""Hand-worked parsing and normal-form cases."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import arrays as Y
from plumbline.functions import dialogue as D
from plumbline.functions import maths as M
from plumbline.functions import prompts, qa
from plumbline.functions import text as X
from plumbline.operators import scoring


@pytest.mark.parametrize(
    "text, mode, expected",
    [
        ("no line", "strict", 0.5),
        ("Confidence: high", "strict", 1.0),
        ("Confidence: 85", "strict", 1.0),
        ("Confidence: 85", "loose", 0.85),
        ("Confidence: -1", "strict", 0.0),
        ("nothing", "loose", None),
        ("x</think>my confidence is 90", "api", 0.9),
        ("nothing", "api", 0.5),
    ],
)
def test_confidence_modes(one, text, mode, expected):
    assert one(X.confidence(F.lit(text), mode)) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        (r"a \boxed{1} b \boxed{\frac{1}{2}} c", r"\frac{1}{2}"),
        (r"\boxed{1", None),
        ("none", None),
    ],
)
def test_last_boxed(one, text, expected):
    assert one(X.last_boxed(F.lit(text))) == expected


def test_answer_lines(one):
    assert one(X.answer_with_fallbacks(F.lit("Answer: 1\nAnswer: 2"))) == "2"
    assert one(X.answer_with_fallbacks(F.lit("Answer:\nBest guess: 5"))) == "Best guess: 5"
    assert one(X.extract_tag(F.lit("<answer>a</answer><answer> b </answer>"))) == "b"
    assert one(X.extract_tag(F.lit("no tag"))) is None


def test_two_qa_normal_forms_differ(one):
    assert one(qa.normalize_answer(F.lit("The-Cat!"))) == "thecat"
    assert one(qa.normalize_text(F.lit("The-Cat!"))) == "cat"
    assert one(qa.em_check(F.lit("The  Cat!"), F.array(F.lit("cat"))))
    assert one(qa.answers_equal(F.lit("1,000"), F.array(F.lit("1000.0"))))
    assert not one(qa.answers_equal(F.lit(""), F.array(F.lit("x"))))


@pytest.mark.parametrize(
    "text, expected",
    [
        (r"x = \frac12", r"\frac{1}{2}"),
        ("$1,234$", "1234"),
        ("5 dollars", "5"),
        (r"\text{7}", "7"),
    ],
)
def test_final_answer_form(one, text, expected):
    assert one(M.normalize_final_answer(F.lit(text))) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        (r"\frac12", r"\frac{1}{2}"),
        ("1/2", r"\frac{1}{2}"),
        (".5", r"\frac{1}{2}"),
        (r"\sqrt3", r"\sqrt{3}"),
        (r"3 \text{ cm}", "3"),
        ("x=4", "4"),
        (r"1 \text{ a} \text{ b}", None),
    ],
)
def test_boxed_form(one, text, expected):
    assert one(M.strip_math_string(F.lit(text))) == expected


def test_lenient_verdicts(one):
    def verdict(a, b):
        return one(M.lenient_equal(F.lit(a), F.lit(b)))

    assert verdict("50", "0.5") == "correct"
    assert verdict("7 3/4 meters", "7+3/4") == "correct"
    assert verdict("x+1", "1+x") == "undecided"
    assert verdict("(1,2)", "(1,3)") == "wrong"
    assert one(M.normalize_expr(F.lit("1,000.0"))) == "1000"
    assert one(M.split_tuple(F.lit("(1,234, 5)"))) == ["1234", "5"]


def test_idk_is_an_abstention(one):
    assert one(M.minerva(F.lit("Answer: <IDK>"), F.lit("4"))).asDict()["abstained"]
    assert one(M.minerva(F.lit("nothing"), F.lit("4"))).pred == "[INVALID]"


def test_claims(one):
    text = 'Solution: <Confidence value=0.9 text="a">s</Confidence> <Confidence value=0.5 text="b">t</Confidence>'
    values = X.claim_confidences(F.lit(text))
    assert one(X.claim_product(values)) == pytest.approx(0.45)
    assert one(X.claim_minimum(values)) == 0.5
    assert one(X.claim_confidences(F.lit("none"))) == [0.0]
    assert one(X.parse_claim_labels(F.lit("[1]"), F.lit(3))) == [1, 0, 0]
    assert one(X.parse_claim_labels(F.lit("unreadable"), F.lit(2))) == [0, 0]


def test_formats(one):
    assert one(X.is_valid_think_answer(F.lit("<think>a</think>\n<answer>b</answer>")))
    assert not one(X.is_valid_think_answer(F.lit("<think>a</think>x<answer>b</answer>")))
    assert not one(X.is_valid_think_answer(F.lit("<think>a</think><answer>b</answer><answer>c</answer>")))
    assert one(X.parse_grade_letter(F.lit("CORRECT"))) == "not_attempted"
    assert one(X.gsm8k_answer(F.lit("#### 1,234"))) == "1234"


def test_arrays(one):
    ids = F.array(*[F.lit(i) for i in (5, 6, 2, 7)])
    assert one(Y.response_mask(ids, [2, 9])) == [1, 1, 1, 0]
    assert one(Y.truncate_tokens(ids, 3, "middle")) == [5, 2, 7]
    assert one(Y.pad_array(ids, 6, 0, left=True)) == [0, 0, 5, 6, 2, 7]
    assert one(Y.position_ids(F.array(*[F.lit(i) for i in (0, 1, 1, 0)]))) == [0, 0, 1, 1]


def test_tool_turns(one):
    good = "a<code>1</code>b<interpreter>2</interpreter><answer>3</answer>"
    assert [t.kind for t in one(D.tool_turns(F.lit(good)))] == ["code", "output", "answer"]
    assert one(D.tool_turns(F.lit("<code>1</code><answer>3</answer>"))) is None


def test_risk_prompt_states_percent_and_penalty(one):
    text = one(prompts.build_prompt(F.lit("q?"), "explicit_risk", F.lit(False), F.lit(0.8)))
    assert "80 percent" in text and "4.00 points" in text and "q?" in text
    assert "inf points" in one(prompts.build_prompt(F.lit("q"), "explicit_risk", F.lit(True), F.lit(1.0)))


def test_long_tails_are_read_whole(spark, one):
    """What follows an answer, however long, does not hide it."""
    tail = " and so the matter is closed" * 250
    assert one(X.gsm8k_answer(F.lit("#### 42" + tail))) == "42"
    assert one(M.strict_box(F.lit("\\boxed{7}" + tail), F.lit("7"))) == 1
    row = ("Answer: 42\n" + tail, ["42"], "math_dapo", "Confidence: 0.5\nAnswer: 42\n" + tail)
    df = spark.createDataFrame([row], "response STRING, ground_truth ARRAY<STRING>, data_source STRING, long STRING")
    assert scoring.score(df, "math_dapo").first()["result"]["score"] == 1.0
    stated = df.drop("response").withColumnRenamed("long", "response")
    assert scoring.score(stated, "verbalized_brier").first()["result"]["score"] == 0.75
