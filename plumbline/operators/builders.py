"""Dataset building: raw question/answer tables to one training-row layout.

A builder is a ``DataFrame -> DataFrame`` function registered by name; all but
the supervised ones return the ``RL_ROWS`` columns. The caller supplies
``index`` (a row id), so no builder orders or numbers the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.basics import strip, uniform01
from plumbline.functions.dialogue import tool_turns
from plumbline.functions.prompts import BASELINE_PROMPT, build_prompt, fill
from plumbline.functions.text import (
    TRAINING_MARKERS,
    clean_brackets,
    ensure_question_mark,
    first_match,
    last_boxed,
    strip_to_question,
)
from plumbline.operators.filters import is_qa_row
from plumbline.operators.registry import BUILDERS, register_builder
from plumbline.operators.rows import fill_ground_truth, prompt_text
from plumbline.operators.sampling import assign_risk_t
from plumbline.schemas import RL_ROWS, conforms

# Instruction texts of the training prompts.
THINK_ANSWER = (
    "Answer the given question. You should first have a reasoning process in mind and then provides the answer. "
    "Show your reasoning in <think> </think> tags and return the final answer in <answer> </answer> tags, "
    "for example <answer> Beijing </answer>. Question: {q}\n"
)
THINK_ANSWER_CONTEXT = (
    "Answer the given question with some potentially useful context. You should analyze the question carefully, "
    "evaluate the given context (which may or may not be useful), and then generate an accurate and well-reasoned "
    "response. You should first have a reasoning process in mind and then provides the answer. Show your reasoning "
    "in <think> </think> tags and return the final answer in <answer> </answer> tags, for example "
    "<answer> Beijing </answer>. Question: {q} Context: {context} \n"
)
STEP_BY_STEP = 'Let\'s think step by step and output the final answer after "####".'
STEP_BY_STEP_BOX = "Let's think step by step and output the final answer within \\boxed{}."
THINK_FIRST_BOX = (
    "You FIRST think about the reasoning process as an internal monologue and then provide the final answer. "
    "The reasoning process MUST BE enclosed within <think> </think> tags. The final answer MUST BE put in \\boxed{}."
)
BOX_FORMAT = "\nThe answer format must be: \\boxed{'The final answer goes here.'}"
CHOICE_PROMPT = (
    "Answer the following multiple choice question. The last line of your response should be of the following "
    "format: 'Answer: $LETTER' (without quotes) where LETTER is one of ABCD. Think step by step before "
    "answering.\n\n{q}\n\nA) {a}\nB) {b}\nC) {c}\nD) {d}"
)
CODE_WINDOW = ("2024-08-00T00:00:00", "2025-01-00T00:00:00")
USER_QUESTION = "*user question:*"


def build_rows(df: DataFrame, name: str, **options) -> DataFrame:
    return BUILDERS.get(name)(df, **options)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _or_null(value: Column | None) -> Column:
    return F.lit(None).cast("string") if value is None else value.cast("string")


def rl_row(
    source: Column,
    messages: list[Column],
    ability: str,
    truth: Column,
    split: str,
    style: str = "rule",
    question: Column | None = None,
    answer: Column | None = None,
    extra: Column | None = None,
    agent: str | None = None,
) -> list[Column]:
    """The columns of one training row, in the order of ``RL_ROWS``."""
    return [
        source.cast("string").alias("data_source"),
        F.array(*messages).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.cast("array<string>").alias("ground_truth")).alias("reward_model"),
        F.struct(
            F.lit(split).alias("split"),
            F.col("index").cast("bigint").alias("index"),
            _or_null(question).alias("question"),
            _or_null(answer).alias("answer"),
            _or_null(extra).alias("json"),
        ).alias("extra_info"),
        _or_null(None if agent is None else F.lit(agent)).alias("agent_name"),
    ]


def check_rows(df: DataFrame) -> DataFrame:
    """A builder's result must have the row layout."""
    if not conforms(df, RL_ROWS):
        raise TypeError(f"builder result is {df.schema.simpleString()}")
    return df


@register_builder("nq")
def qa_rows(df: DataFrame, source: str = "nq", split: str = "train") -> DataFrame:
    question = ensure_question_mark(F.col("question"))
    prompt = _message("user", fill(THINK_ANSWER, q=question))
    return df.select(*rl_row(F.lit(source), [prompt], "fact-reasoning", F.col("golden_answers"), split))


@register_builder("nq_rag")
def rag_rows(df: DataFrame, source: str = "nq_rag", split: str = "train") -> DataFrame:
    question = ensure_question_mark(F.col("question"))
    prompt = _message("user", fill(THINK_ANSWER_CONTEXT, q=question, context=F.col("context")))
    return df.select(*rl_row(F.lit(source), [prompt], "fact-reasoning", F.col("golden_answers"), split))


@register_builder("search_r1")
def search_rows(df: DataFrame, system: str, user_prefix: str, split: str = "train") -> DataFrame:
    """System and user prompt, tagged source, tool arguments as JSON."""
    tagged = F.concat(F.lit("searchR1_"), F.coalesce("data_source", F.lit("")))
    kwargs = F.to_json(
        F.struct(
            F.lit(True).alias("need_tools_kwargs"),
            F.struct(
                F.struct(
                    F.struct(
                        F.col("golden_answers").alias("ground_truth"),
                        F.col("question").alias("question"),
                        tagged.alias("data_source"),
                    ).alias("create_kwargs")
                ).alias("search")
            ).alias("tools_kwargs"),
        )
    )
    user = F.concat(F.lit(user_prefix.rstrip("\n")), F.col("question"))
    messages = [_message("system", F.lit(system)), _message("user", user)]
    return df.select(
        *rl_row(
            tagged, messages, "fact-reasoning", F.col("golden_answers"), split, question=F.col("question"), extra=kwargs
        )
    )


@register_builder("crag")
def crag_rows(df: DataFrame, source: str = "crag", split: str = "train") -> DataFrame:
    """Answer with its alternatives; knowledge flag carried as JSON.

    Wants ``prompt_text`` already cut to length and ``out_of_knowledge``.
    """
    truth = F.concat(F.array("answer"), F.coalesce("alt_ans", F.array().cast("array<string>")))
    flag = F.to_json(F.struct(F.col("out_of_knowledge")))
    return df.select(
        *rl_row(
            F.lit(source),
            [_message("user", F.col("prompt_text"))],
            "fact-reasoning",
            truth,
            split,
            question=ensure_question_mark(F.col("query")),
            extra=flag,
        )
    )


@register_builder("gsm8k")
def gsm8k_rows(
    df: DataFrame, source: str = "openai/gsm8k", split: str = "train", system: str | None = None, agent: str | None = None
) -> DataFrame:
    """Number after ``####`` as gold; tool variants add a system prompt."""
    raw = first_match(F.col("answer"), r"#### (\-?[0-9\.\,]+)")
    gold = F.replace(raw, F.lit(","), F.lit(""))
    user = _message("user", F.concat("question", F.lit(" " + STEP_BY_STEP)))
    messages = [user] if system is None else [_message("system", F.lit(system)), user]
    kwargs = None
    if agent is not None:
        kwargs = F.to_json(F.struct(F.lit(True).alias("need_tools_kwargs"), gold.alias("ground_truth")))
    return df.select(
        *rl_row(
            F.lit(source),
            messages,
            "math",
            F.array(gold),
            split,
            question=F.col("question"),
            answer=F.col("answer"),
            extra=kwargs,
            agent=agent,
        )
    )


@register_builder("math")
def math_rows(df: DataFrame, source: str = "DigitalLearningGmbH/MATH-lighteval", split: str = "train") -> DataFrame:
    prompt = _message("user", F.concat("problem", F.lit(" " + STEP_BY_STEP_BOX)))
    return df.select(
        *rl_row(F.lit(source), [prompt], "math", F.array(last_boxed(F.col("solution"), loose=True)), split)
    )


@register_builder("geo3k")
def geo_rows(df: DataFrame, source: str = "hiyouga/geometry3k", split: str = "train") -> DataFrame:
    """Images, where present, are carried along unread."""
    prompt = _message("user", F.concat("problem", F.lit(" " + THINK_FIRST_BOX)))
    row = rl_row(
        F.lit(source), [prompt], "math", F.array("answer"), split, question=F.col("problem"), answer=F.col("answer")
    )
    return df.select(*row, *[c for c in ("images",) if c in df.columns])


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


@register_builder("hellaswag")
def hellaswag_rows(df: DataFrame, source: str = "Rowan/hellaswag", split: str = "train") -> DataFrame:
    """Cleaned context and endings; rows without a label are dropped."""
    text = F.concat(F.col("activity_label"), F.lit(": "), F.col("ctx_a"), F.lit(" "), capitalize(F.col("ctx_b")))
    choices = F.to_json(F.struct(F.transform("endings", clean_brackets).alias("choices")))
    labelled = df.where(F.length("label") > 0)
    return labelled.select(
        *rl_row(
            F.lit(source),
            [_message("user", clean_brackets(text))],
            "nlp",
            F.array("label"),
            split,
            style="model",
            extra=choices,
        )
    )


@register_builder("tool")
def tool_rows(df: DataFrame, tool: str) -> DataFrame:
    """Existing rows get tool arguments with their ground truth."""
    kwargs = F.to_json(
        F.struct(
            F.lit(True).alias("need_tools_kwargs"),
            F.create_map(
                F.lit(tool), F.struct(F.struct(F.col("reward_model.ground_truth")).alias("create_kwargs"))
            ).alias("tools_kwargs"),
        )
    )
    return df.withColumn("extra_info", F.col("extra_info").withField("json", kwargs))


@register_builder("aime2024")
def aime_rows(df: DataFrame, source: str = "Maxwell-Jia/AIME_2024") -> DataFrame:
    prompt = _message("user", F.col("Problem"))
    return df.select(*rl_row(F.lit(source), [prompt], "English", F.array(F.col("Answer").cast("string")), "test"))


@register_builder("cnmo")
def cnmo_rows(df: DataFrame, language: str = "en") -> DataFrame:
    prompt = _message("user", F.col("question"))
    source = F.lit(f"opencompass/cnmo2024_{language}")
    return df.select(*rl_row(source, [prompt], "Math", F.array(F.col("answer").cast("string")), "test"))


@register_builder("gpqa")
def choice_rows(df: DataFrame, source: str = "Idavidrein/gpqa", seed: int = 0) -> DataFrame:
    """Four choices in hash order with the letter of the right one."""
    options = F.array(
        *[
            F.struct(F.xxhash64(F.col("index"), F.lit(i), F.lit(seed)).alias("k"), F.col(c).alias("text"), F.lit(c == "correct").alias("gold"))
            for i, c in enumerate(["correct", "wrong1", "wrong2", "wrong3"])
        ]
    )
    dealt = df.withColumn("__o", F.array_sort(options))
    texts = {k: F.get("__o", F.lit(i))["text"] for i, k in enumerate("abcd")}
    letter = F.substring(F.lit("ABCD"), F.array_position(F.col("__o.gold"), F.lit(True)).cast("int"), F.lit(1))
    prompt = _message("user", fill(CHOICE_PROMPT, q=F.col("question"), **texts))
    return dealt.select(*rl_row(F.lit(source), [prompt], "Math", F.array(letter), "test"))


@register_builder("lcb")
def code_rows(df: DataFrame, source: str = "livecodebench/code_generation_lite") -> DataFrame:
    """Contest problems in a date window; test cases pass through unread."""
    lo, hi = CODE_WINDOW
    kept = df.where((F.col("contest_date") >= lo) & (F.col("contest_date") < hi))
    starter = F.when(
        F.length("starter_code") > 0,
        F.concat(F.lit("Starter code:\n```python\n"), F.col("starter_code"), F.lit("\n```")),
    ).otherwise(F.lit("```python\n# YOUR CODE HERE\n```"))
    text = F.concat(F.lit("Write a correct Python program.\n\nQuestion: "), F.col("question_content"), F.lit("\n\n"), starter)
    return kept.select(*rl_row(F.lit(source), [_message("user", text)], "Code", F.array("test_cases"), "test"))


@register_builder("hh_sft")
def hh_sft_rows(df: DataFrame) -> DataFrame:
    """prompt→chosen and prompt→rejected as supervised pairs."""
    return df.select("prompt", F.explode(F.array("chosen", "rejected")).alias("response"))


@register_builder("hh_rm")
def hh_rm_rows(df: DataFrame, train: float = 0.75, seed: int | None = None) -> DataFrame:
    """Chosen and rejected columns with a 75/25 split.

    By position over a dense ``index``, or by hash of it when a seed is given.
    """
    if seed is None:
        total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        first = F.col("index") < F.floor(total * train)
    else:
        first = uniform01(F.col("index"), F.lit(seed)) < train
    return df.select("prompt", "chosen", "rejected", F.when(first, "train").otherwise(F.lit("test")).alias("split"))


@register_builder("hh_rl")
def hh_rl_rows(df: DataFrame, source: str = "Dahoas/full-hh-rlhf", split: str = "train") -> DataFrame:
    row = rl_row(
        F.lit(source), [_message("user", F.col("prompt"))], "alignment", F.array("response"), split, style="model"
    )
    return df.select(*row)


@register_builder("retool_sft")
def retool_rows(df: DataFrame, tools: str = "[]") -> DataFrame:
    """Problem after the user-question mark, then tool turns; bad rows NULL."""
    marked = F.substring_index("user", USER_QUESTION, -1)
    problem = strip(F.replace(F.replace(marked, F.lit("<answer>"), F.lit("")), F.lit("</answer>"), F.lit("")))
    first = F.array(F.struct(F.lit("user").alias("role"), F.lit("question").alias("kind"), problem.alias("content")))
    return df.select("index", F.concat(first, tool_turns(F.col("assistant"))).alias("messages"), F.lit(tools).alias("tools"))


@register_builder("answer_format")
def add_answer_format(df: DataFrame, agent: str = "tool_agent") -> DataFrame:
    """Boxed instruction on the first message, agent name set."""
    prompt = F.transform(
        "prompt",
        lambda m, i: F.when(
            i == 0,
            F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit(BOX_FORMAT)).alias("content")),
        ).otherwise(m),
    )
    return df.withColumn("prompt", prompt).withColumn("agent_name", F.lit(agent))


@register_builder("char_count")
def char_count_rows(df: DataFrame, lo: int = 5, hi: int = 20, seed: int = 0) -> DataFrame:
    """One counting exercise per ``index``: word, worked solution and count.

    Length, target letter and letters are hashes of the index, so a row never
    depends on the others.
    """

    def pick(n: int | Column, *salt) -> Column:
        bound = F.lit(n) if isinstance(n, int) else n
        return F.floor(uniform01(F.col("index"), F.lit(seed), *salt) * bound).cast("int")

    shaped = df.select("index").withColumn("n", F.lit(lo) + pick(hi - lo + 1, F.lit("len")))
    shaped = shaped.withColumn("k", 1 + pick(F.col("n"), F.lit("k"))).withColumn("t", pick(26, F.lit("t")))

    def letter(i: Column) -> Column:
        other = F.pmod(F.col("t") + 1 + pick(25, F.lit("c"), i), F.lit(26))
        code = F.when(i <= F.col("k"), F.col("t")).otherwise(other)
        return F.struct(F.xxhash64("index", F.lit(seed), F.lit("o"), i).alias("o"), F.char(F.lit(97) + code).alias("c"))

    letters = F.array_sort(F.transform(F.sequence(F.lit(1), F.col("n")), letter))["c"]
    lettered = shaped.withColumn("chars", letters).withColumn("target", F.char(F.lit(97) + F.col("t")))
    word = F.array_join("chars", "-")
    lines = F.transform(
        "chars",
        lambda c: F.concat(c, F.when(c == F.col("target"), " = ").otherwise(F.lit(" != ")), F.col("target"), F.lit(".")),
    )
    end = F.concat(F.lit("\\boxed{"), F.col("k").cast("string"), F.lit("} "), F.col("target"), F.lit(" in "), word, F.lit("."))
    return lettered.select(
        "index",
        F.concat(F.lit("How many "), F.col("target"), F.lit(" are there in word "), word, F.lit("?")).alias("prompt"),
        F.concat(F.array_join(lines, "\n"), F.lit("\n"), end).alias("response"),
        F.col("k").cast("string").alias("ground_truth"),
        F.when(uniform01(F.col("index"), F.lit(seed), F.lit("split")) < 0.9, "train").otherwise(F.lit("test")).alias("split"),
    )


@register_builder("behavioral")
def behavioral_rows(df: DataFrame, strategy: str, row_id: str = "index", risk: str | None = None, seed: int = 0) -> DataFrame:
    """Ground truth, question, risk threshold, template, messages.

    The threshold is kept as ``risk_t``; QA rows get the question form.
    """
    filled = fill_ground_truth(df)
    texts = prompt_text(filled, "last_user", out="__text")
    asked = texts.withColumn("__q", strip_to_question(F.col("__text"), TRAINING_MARKERS))
    with_t = assign_risk_t(asked, row_id, risk, seed)
    qa = is_qa_row(F.col("data_source"), F.col("__text"))
    if strategy in ("baseline", "ppo_value"):
        text = fill(BASELINE_PROMPT, q=F.col("__q"))
    else:
        text = build_prompt(F.col("__q"), strategy, qa, F.col("risk_t"))
    return with_t.withColumn("messages", F.array(_message("user", text))).drop("__text", "__q")


def to_rl_columns(df: DataFrame, source: str) -> DataFrame:
    """prompt and solution columns under their training names."""
    return df.select(
        F.col("prompt"),
        F.struct(F.lit("rule").alias("style"), F.array("solution").alias("ground_truth")).alias("reward_model"),
        F.lit(source).alias("data_source"),
    )


def eval_tasks(frames: dict[str, DataFrame]) -> DataFrame:
    """Union of the chosen evaluation tasks, each through its builder."""
    built = [build_rows(frame, name) for name, frame in frames.items()]
    out = built[0]
    for frame in built[1:]:
        out = out.unionByName(frame)
    return out
