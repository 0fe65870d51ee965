"""Prompt text per answering strategy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt formats. {q} is the question, {percent} and {penalty}
# come from the stated risk threshold.
RESPONSE_MATHS = (
    "Solve the following math problem step by step. The last second line of your response should be of the form\n"
    "Answer: $Answer (without quotes), where $Answer is the answer to the problem. The last line of your\n"
    "response should be of the form Confidence: $Confidence (without quotes), where $Confidence is a\n"
    "number between 0 and 1.\n"
    "{q}\n"
    'Please provide your best guess. Remember to put your answer on its own line after "Answer:" in the second\n'
    'last line and put the confidence score on its own line after "Confidence:" in the last line.'
)
RESPONSE_QA = (
    "Answer the following question.\n\n"
    "Your final output must end with exactly these two lines:\n\n"
    "Answer: <your short answer>\n"
    "Confidence: <a number between 0 and 1>\n\n"
    "Rules:\n"
    "- The second last line must start with `Answer:`\n"
    "- The last line must start with `Confidence:`\n"
    "- Do not output anything after the `Confidence:` line\n"
    "- If unsure, still provide your best guess and a low confidence\n\n"
    "Example:\n"
    "Answer: Paris\n"
    "Confidence: 0.62\n\n"
    "Question:\n"
    "{q}"
)
RISK_MATHS = (
    "Solve the following math problem step by step. Answer only if you are more than {percent} percent\n"
    "confident in your solution, since mistakes are penalized {penalty} points, while correct answers\n"
    "receive 1 point, and an answer of <IDK> receives 0 points. The last line of your response should be\n"
    "of the form Answer: $Answer (without quotes), where $Answer is the answer to the problem. If you are\n"
    "not confident enough, respond with Answer: <IDK>.\n"
    "{q}\n"
    'Remember to put your answer or <IDK> on its own line after "Answer:".'
)
RISK_QA = (
    "Answer the given question. Answer only if you are more than {percent} percent confident in your answer, "
    "since mistakes are penalized {penalty} points, while correct answers receive 1 point, and an answer of "
    "<answer> <IDK> </answer> receives 0 points. "
    "The reasoning process is enclosed within <think> and </think>. During your thinking, you must estimate your "
    "confidence level and provide it within <confidence> and </confidence> tags. Use your confidence to decide "
    "whether to answer or ABSTAIN. After your thinking, you can directly provide the answer inside <answer> and "
    "</answer>, without detailed illustrations. For example, <answer> Beijing </answer>. If you decide to ABSTAIN, "
    "respond with <answer> <IDK> </answer>. "
    "Question: {q}"
)
# The claim format states the tags; a worked example may be put in front of it.
CLAIM_MATHS = (
    "Solve the following math problem step by step. After your reasoning write a line \"Solution:\" and give each "
    "step of the final solution in one tag:\n"
    '<Confidence value=$Confidence text="$Analysis">$Step</Confidence>\n'
    "Finally, output one last line exactly of the form Answer:$Answer.\n"
    "{q}"
)
VALUE_PROMPT = "Question: {q}\n\nAnswer:"
BASELINE_PROMPT = "Question: {q}\n\nPlease put your final short answer inside <answer>...</answer>.\nAnswer:"
QUERY_PROMPT = "Question: {q}\nAnswer:"

# Strategy names hidden in a model path, first match wins.
PATH_RULES = [
    ("confidence_brier", "verbalized_brier"),
    ("confidence_ce", "verbalized_ce"),
    ("confidence_prod", "claim_product"),
    ("confidence_min", "claim_minimum"),
    ("ppo_value", "ppo_value"),
    ("baseline", "baseline"),
    ("explicit_risk", "explicit_risk"),
]


def fill(template: str, **values: Column) -> Column:
    """Template with ``{name}`` slots to one concatenation."""
    parts: list[Column] = []
    rest = template
    while rest:
        slots = [(rest.find("{" + name + "}"), name) for name in values if "{" + name + "}" in rest]
        if not slots:
            parts.append(F.lit(rest))
            break
        at, name = min(slots)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def whole(c: Column) -> Column:
    """No decimals, halves to even."""
    return F.bround(c, 0).cast("bigint").cast("string")


def risk_penalty(t: Column) -> Column:
    """t / (1 − t), infinite at 1."""
    return F.when(t >= 1.0, F.lit(float("inf"))).otherwise(F.try_divide(t, 1 - t))


def build_prompt(
    question: Column, strategy: str, is_qa: Column, risk_t: Column | None = None, claim_example: str = ""
) -> Column:
    """Prompt of a strategy, in its question or its mathematics form."""
    if strategy == "explicit_risk":
        t = F.coalesce(F.lit(0.5) if risk_t is None else risk_t, F.lit(0.5))
        r = risk_penalty(t)
        penalty = F.when(t >= 1.0, F.lit("inf")).otherwise(F.format_string("%.2f", r))
        slots = {"percent": whole(100 * t), "penalty": penalty, "q": question}
        return F.when(is_qa, fill(RISK_QA, **slots)).otherwise(fill(RISK_MATHS, **slots))
    if strategy in ("claim_product", "claim_minimum"):
        return fill(claim_example + CLAIM_MATHS, q=question)
    if strategy == "ppo_value":
        return fill(VALUE_PROMPT, q=question)
    return F.when(is_qa, fill(RESPONSE_QA, q=question)).otherwise(fill(RESPONSE_MATHS, q=question))


def infer_strategy(path: Column, strategy: str = "auto") -> Column:
    if strategy != "auto":
        return F.lit(strategy)
    name = F.lower(path)
    hits = [F.when(F.contains(name, F.lit(mark)), F.lit(rule)) for mark, rule in PATH_RULES]
    return F.coalesce(*hits, F.lit("verbalized_brier"))
