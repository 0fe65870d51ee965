"""Queries that read text: extraction, normal forms, scoring, grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import maths as M
from plumbline.functions import prompts, qa
from plumbline.functions import text as X
from plumbline.functions.arrays import whitespace_tokens
from plumbline.functions.basics import clip, last_match, last_match_of, number
from plumbline.functions.dialogue import tool_calls, tool_turns
from plumbline.operators import filters, joins, registry, scoring, training
from plumbline.operators.grading import grade
from plumbline.operators.validation import score_by_source
from plumbline.plans.carriers import MESSAGES, RESPONSES, derive, plain, r, rounded, table
from plumbline.plans.registry import query
from plumbline.session import shared_folder
from plumbline.sources import readers
from plumbline.sources.sinks import export_claims

E = f"with e as {plain(RESPONSES)}"
NL, BS = "chr(10)", "chr(92)"


def responses(spark, sf):
    return derive(spark, sf, RESPONSES).withColumn("ground_truth", F.array("gold"))


def pick(spark, sf, *cols):
    return rounded(responses(spark, sf).select("event_id", *cols))


def last(text: str, pattern: str, flags: str = "i") -> str:
    return f"list_extract(regexp_extract_all({text}, '{pattern}', 1, '{flags}'), -1)"


def blank(expr: str) -> str:
    return f"nullif(trim({expr}, ' ' || chr(10) || chr(9)), '')"


ANS = r"answer\s*:\s*([^\n]+)"
CONF = r"confidence\s*:\s*([^\n]+)"
STRICT = f"""case when {last('response', CONF)} is null then 0.5e0
  else greatest(0, least(1, coalesce(try_cast({last('response', CONF)} as double), 1e0))) end"""

# extraction ------------------------------------------------------------------


@query("last_match", f"{E} select event_id, {last('response', ANS)} as answer from e")
def last_match_query(spark, sf):
    return pick(spark, sf, last_match(F.col("response"), X.ANSWER_LINE).alias("answer"))


@query(
    "find_last_match_multi",
    f"{E} select event_id, coalesce({last('response', 'confidence *:([0-9. ]+)')}, {last('response', 'item ([0-9]+)')}) as found from e",
)
def find_last_match_multi(spark, sf):
    patterns = ["(?i)item ([0-9]+)", "(?i)confidence *:([0-9. ]+)"]
    return pick(spark, sf, last_match_of(F.col("response"), patterns).alias("found"))


TAG = r"<answer>((?:[^<]|<[^/])*?)</answer>"


@query("extract_tag", f"{E} select event_id, trim({last('tagged', '<answer>([^<]*)</answer>', 'c')}) as answer from e")
def extract_tag(spark, sf):
    return pick(spark, sf, X.extract_tag(F.col("tagged")).alias("answer"))


@query(
    "count_tags",
    f"{E} select event_id, cast(len(regexp_extract_all(tagged, '<answer>')) as int) as opening, cast(len(regexp_extract_all(tagged, '</answer>')) as int) as closing from e",
)
def count_tags(spark, sf):
    return responses(spark, sf).select("event_id", X.count_tags(F.col("tagged")).alias("t")).select("event_id", "t.*")


@query(
    "last_boxed",
    E
    + " select event_id, case when ends_with(boxed, '} end') then substr(split_part(boxed, 'boxed{', -1), 1, len(split_part(boxed, 'boxed{', -1)) - 5) end as content from e",
)
def last_boxed(spark, sf):
    return pick(spark, sf, X.last_boxed(F.col("boxed")).alias("content"))


@query(
    "extract_answer_simple",
    f"{E} select event_id, coalesce(trim(list_extract(regexp_extract_all(response, 'answer:\\s*([^|\\n]+)', 1, 'i'), 1)), trim(split_part(trim(response, ' ' || chr(10)), chr(10), -1))) as answer from e",
)
def extract_answer_simple(spark, sf):
    return pick(spark, sf, X.extract_answer_simple(F.col("response")).alias("answer"))


@query("extract_confidence_colon", f"{E} select event_id, {r(STRICT)} as confidence from e")
def extract_confidence_colon(spark, sf):
    return pick(spark, sf, X.confidence(F.col("response")).alias("confidence"))


@query(
    "extract_confidence_loose",
    f"{E}, x as (select event_id, try_cast(regexp_extract(response, '[Cc]onfidence[:\\s]+([0-9]*\\.?[0-9]+)', 1) as double) as v from e) select event_id, {r('case when v is not null then least(1, case when v > 1 then v / 100 else v end) end')} as confidence from x",
)
def extract_confidence_loose(spark, sf):
    return pick(spark, sf, X.confidence(F.col("response"), "loose").alias("confidence"))


@query(
    "extract_confidence_api",
    f"{E}, x as (select event_id, try_cast({last('response', 'confidence *: *([0-9]*[.]?[0-9]+)')} as double) as v from e) select event_id, {r('coalesce(case when v > 1 then v / 100 else v end, 0.5e0)')} as confidence from x",
)
def extract_confidence_api(spark, sf):
    return pick(spark, sf, X.confidence(F.col("response"), "api").alias("confidence"))


VALUES = r"list_transform(regexp_extract_all(split_part(claimed, 'Solution:', -1), '<confidence value=([0-9.]+)', 1, 'i'), lambda x: least(1, cast(x as double)))"
HELD = f"case when len({VALUES}) = 0 then [0e0] else {VALUES} end"


@query("claim_confidences", f"{E} select event_id, len({HELD}) as n, {r(f'list_sum({HELD})')} as total from e")
def claim_confidences(spark, sf):
    values = X.claim_confidences(F.col("claimed"))
    held = responses(spark, sf).select("event_id", values.alias("v"))
    return rounded(held.select("event_id", F.size("v").cast("bigint").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("total")))


@query("count_claims", f"{E} select event_id, cast(len(regexp_extract_all(claimed, '<confidence value=', 0, 'i')) as int) as n from e")
def count_claims(spark, sf):
    return pick(spark, sf, X.count_claims(F.col("claimed")).alias("n"))


@query("claim_aggregate", f"{E} select event_id, {r(f'list_product({HELD})')} as product, {r(f'list_min({HELD})')} as minimum from e")
def claim_aggregate(spark, sf):
    v = responses(spark, sf).select("event_id", X.claim_confidences(F.col("claimed")).alias("v"))
    return rounded(v.select("event_id", X.claim_product(F.col("v")).alias("product"), X.claim_minimum(F.col("v")).alias("minimum")))


REPLY = """select event_id, case when event_id % 4 = 0 then concat('{"steps": [{"acc": ', cast(event_id % 2 as string), '}, {"acc": 1}]}')
  when event_id % 4 = 1 then concat('labels [', cast(event_id % 3 as string), ', true, 0] ok')
  when event_id % 4 = 2 then 'cannot tell' else '[1]' end as reply from {events}"""


@query(
    "parse_claim_reply",
    "select event_id, case when event_id % 4 = 0 then concat(case when event_id % 2 > 0 then '1' else '0' end, ',1,0') "
    "when event_id % 4 = 1 then concat(case when event_id % 3 > 0 then '1' else '0' end, ',1,0') when event_id % 4 = 2 then '0,0,0' else '1,0,0' end as labels from events",
)
def parse_claim_reply(spark, sf):
    df = derive(spark, sf, REPLY)
    labels = X.parse_claim_labels(F.col("reply"), F.lit(3))
    return df.select("event_id", F.array_join(F.transform(labels, lambda v: v.cast("string")), ",").alias("labels"))


@query(
    "parse_grade_letter",
    "select doc_id, case regexp_extract(text, '(A|B|C)', 1) when 'A' then 'correct' when 'B' then 'incorrect' else 'not_attempted' end as label from documents",
)
def parse_grade_letter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.parse_grade_letter(F.col("text")).alias("label"))


@query("parse_boxed_verdict", "select event_id, cast(case when event_id % 3 = 0 then 1 else 0 end as int) as verdict from events")
def parse_boxed_verdict(spark, sf):
    word = F.when(F.col("event_id") % 3 == 0, F.lit("True")).otherwise(F.lit("False"))
    reply = F.concat(F.lit("Judged \\boxed{False} then \\boxed{"), word, F.lit("}"))
    return table(spark, sf, "events").select("event_id", X.parse_boxed_verdict(reply).alias("verdict"))


# normal forms ----------------------------------------------------------------

MATHS_TEXT = """select event_id, case when event_id % 8 = 0 then concat('x = ', cast(user_id as string), ' km')
  when event_id % 8 = 1 then concat(chr(92), 'frac12', cast(user_id as string))
  when event_id % 8 = 2 then concat('$', cast(user_id as string), ',000$')
  when event_id % 8 = 3 then concat(chr(92), 'text{', cast(user_id as string), '} degrees')
  when event_id % 8 = 4 then concat(chr(92), 'sqrt', cast(user_id % 10 as string), 'a')
  when event_id % 8 = 5 then concat(cast(user_id as string), '/7')
  when event_id % 8 = 6 then concat('k=.', cast(user_id + 1 as string))
  else concat('The ', cast(user_id as string), ' cm square') end as t, user_id, event_id % 8 as kind from {events}"""
MT = f"with m as {plain(MATHS_TEXT)}"
U = "cast(user_id as varchar)"


@query(
    "normalize_math_answer",
    f"""{MT} select event_id, case kind when 0 then {U} when 1 then concat(chr(92), 'frac{{1}}{{2}}', {U})
  when 2 then concat({U}, '000') when 3 then {U} when 4 then concat(chr(92), 'sqrt{{', cast(user_id % 10 as varchar), '}}a')
  when 5 then concat({U}, '/7') when 6 then concat('.', cast(user_id + 1 as varchar)) else concat('The', {U}) end as normal from m""",
)
def normalize_math_answer(spark, sf):
    return derive(spark, sf, MATHS_TEXT).select("event_id", M.normalize_final_answer(F.col("t")).alias("normal"))


@query(
    "strip_math_string",
    f"""{MT} select event_id, case kind when 0 then concat({U}, 'km') when 1 then concat(chr(92), 'frac{{1}}{{2}}', {U})
  when 2 then concat('$', {U}, ',000$') when 3 then concat(chr(92), 'text{{', {U}, '}}degrees')
  when 4 then concat(chr(92), 'sqrt{{', cast(user_id % 10 as varchar), '}}a') when 5 then concat(chr(92), 'frac{{', {U}, '}}{{7}}')
  when 6 then concat('.', cast(user_id + 1 as varchar))
  else concat('The', {U}, 'cmsquare') end as normal from m""",
)
def strip_math_string(spark, sf):
    """A one-letter left side goes; the point after it then stays as it is."""
    return derive(spark, sf, MATHS_TEXT).select("event_id", M.strip_math_string(F.col("t")).alias("normal"))


EXPR = """select event_id, case when event_id % 5 = 0 then concat(cast(user_id as string), ' meters')
  when event_id % 5 = 1 then concat(cast(user_id + 1 as string), ' 3/4') when event_id % 5 = 2 then concat(cast(user_id + 1 as string), ',000')
  when event_id % 5 = 3 then concat(cast(user_id as string), '.0') else concat('A ', cast(user_id as string), ' or B') end as t,
  user_id, event_id % 5 as kind from {events}"""


@query(
    "normalize_expr",
    f"with m as {plain(EXPR)} select event_id, case kind when 0 then {U} when 1 then concat(cast(user_id + 1 as varchar), '+3/4') when 2 then concat(cast(user_id + 1 as varchar), '000') when 3 then {U} else concat('a ', {U}, ' , b') end as normal from m",
)
def normalize_expr(spark, sf):
    return derive(spark, sf, EXPR).select("event_id", F.trim(M.normalize_expr(F.col("t"))).alias("normal"))


@query("split_tuple", "select event_id, cast(user_id + 1 as varchar) || '000|' || cast(event_id % 9 as varchar) as elements, 2 as n from events")
def split_tuple(spark, sf):
    text = F.format_string("(%d,000, %d)", F.col("user_id") + 1, F.col("event_id") % 9)
    e = table(spark, sf, "events").select("event_id", M.split_tuple(text).alias("x"))
    return e.select("event_id", F.array_join("x", "|").alias("elements"), F.size("x").alias("n"))


@query("numeric_equal", "select event_id, (user_id % 3 <> 2 or user_id = 0) as same from events")
def numeric_equal(spark, sf):
    u = F.col("user_id")
    a = u.cast("string")
    b = F.when(u % 3 == 0, a).when(u % 3 == 1, (u * 100).cast("string")).otherwise((u + 5).cast("string"))
    return table(spark, sf, "events").select("event_id", M.numeric_equal(a, b).alias("same"))


PUNCT = "[!-/:-@\\[-`{-~]"
SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def words_sql(clean: str) -> str:
    """White-space separated words without articles."""
    return f"array_to_string(list_filter(regexp_split_to_array({clean}, '\\s+'), lambda w: w not in ('', 'a', 'an', 'the')), ' ')"


@query("normalize_qa_answer", f"select item_id, {words_sql(f"regexp_replace(lower(text), '{PUNCT}', '', 'g')")} as normal from benchmark")
def normalize_qa_answer(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", qa.normalize_answer(F.col("text")).alias("normal"))


@query("normalize_text_eval", f"select item_id, {words_sql(f"regexp_replace(lower(text), '{PUNCT}', ' ', 'g')")} as normal from benchmark")
def normalize_text_eval(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", qa.normalize_text(F.col("text")).alias("normal"))


@query("normalize_answer_basic", f"select doc_id, {SQUEEZE.format('''regexp_replace(lower(text), '[,.!?;:]', '', 'g')''')} as normal from documents")
def normalize_answer_basic(spark, sf):
    return table(spark, sf, "documents").select("doc_id", qa.normalize_basic(F.col("text")).alias("normal"))


@query(
    "em_check",
    f"{E} select event_id, coalesce(regexp_extract({last('tagged', '<answer>([^<]*)</answer>', 'c')}, '[pb][0-9]*') = 'p' || gold, false) as em, coalesce({last('tagged', '<answer>([^<]*)</answer>', 'c')} like '%p' || gold || '%', false) as subem from e",
)
def em_check(spark, sf):
    df = responses(spark, sf).withColumn("golds", F.array(F.concat(F.lit("P"), "gold"), F.concat(F.lit("a p"), "gold", F.lit("."))))
    answer = X.extract_tag(F.col("tagged"))
    return df.select("event_id", qa.em_check(answer, F.col("golds")).alias("em"), qa.subem_check(answer, F.col("golds")).alias("subem"))


@query("answers_equal_lenient", f"{E} select event_id, gold <> '0' as hit from e")
def answers_equal_lenient(spark, sf):
    """``n,000.0`` against ``n000`` for n > 0, blank text for n = 0."""
    pred = F.when(F.col("gold") == "0", F.lit("")).otherwise(F.concat("gold", F.lit(",000.0")))
    return pick(spark, sf, qa.answers_equal(pred, F.array(F.lit("zero"), F.concat("gold", F.lit("000")))).alias("hit"))


NORM = f"regexp_replace(coalesce({last('response', ANS)}, '[INVALID]'), '\\s', '', 'g')"


@query("math_equal_minerva", f"{E} select event_id, {NORM} = gold as correct, contains({NORM}, '<IDK>') as abstained, {NORM} as pred from e")
def math_equal_minerva(spark, sf):
    m = responses(spark, sf).select("event_id", M.minerva(F.col("response"), F.col("gold")).alias("m"))
    return m.select("event_id", "m.*")


BOX_OK = "event_id % 8 <> 0 and split_part(boxed, 'boxed{', -1) = concat(chr(92), 'frac{', gold, '}{7}} end')"


@query("strict_box_equal", f"{E} select event_id, cast(case when {BOX_OK} then 1 else -1 end as int) as score from e")
def strict_box_equal(spark, sf):
    gold = F.concat(F.lit("\\frac{"), "gold", F.lit("}{7}"))
    return pick(spark, sf, M.strict_box(F.col("boxed"), gold).alias("score"))


@query("is_idk", f"{E} select event_id, coalesce({last('response', ANS)} = '<IDK>', false) as idk from e")
def is_idk(spark, sf):
    return pick(spark, sf, X.is_idk(last_match(F.col("response"), X.ANSWER_LINE)).alias("idk"))


@query("gsm8k_answer", f"{E} select event_id, replace({last('worked', '#### ([0-9,]+)')}, ',', '') as strict, replace({last('worked', '([0-9.,]+)')}, 'x', '') as flexible from e")
def gsm8k_answer(spark, sf):
    return pick(spark, sf, X.gsm8k_answer(F.col("worked")).alias("strict"), X.gsm8k_answer(F.col("worked"), "flexible").alias("flexible"))


@query("choice_answer", "select event_id, case when event_id % 6 < 4 then substr('ABCD', cast(event_id % 6 + 1 as int), 1) end as letter from events")
def choice_answer(spark, sf):
    letter = F.substring(F.lit("ABCDEF"), (F.col("event_id") % 6 + 1).cast("int"), F.lit(1))
    text = F.concat(F.lit("so\nAnswer : $"), letter, F.lit("$ done"))
    return table(spark, sf, "events").select("event_id", X.choice_answer(text).alias("letter"))


@query("think_answer_format", f"{E} select event_id, event_id % 9 <> 0 and event_id % 15 <> 0 as valid from e")
def think_answer_format(spark, sf):
    return pick(spark, sf, X.is_valid_think_answer(F.col("tagged")).alias("valid"))


@query("think_boxed_format", f"{E} select event_id, case when event_id % 8 <> 0 then 1e0 else 1e0 end as format from e")
def think_boxed_format(spark, sf):
    text = F.concat(F.lit("<think>"), "response", F.lit("</think>"), "boxed")
    return pick(spark, sf, X.think_boxed_format(text).alias("format"))


@query("clean_brackets", "select doc_id, replace(regexp_replace(replace(trim(text, ' ' || chr(10) || chr(9)), ' [title]', '. '), '\\[[^\\n]*?\\]', '', 'g'), '  ', ' ') as clean from documents")
def clean_brackets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_brackets(F.col("text")).alias("clean"))


@query("ensure_question_mark", "select item_id, case when ends_with(trim(text, ' ' || chr(10)), '?') then trim(text, ' ' || chr(10)) else trim(text, ' ' || chr(10)) || '?' end as q from benchmark")
def ensure_question_mark(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.ensure_question_mark(F.col("text")).alias("q"))


CALL = """select conv_id, turn, concat(case when turn % 2 = 0 then concat('<tool_call>{"name": "find", "arguments": {"id": ', cast(conv_id as string), '}}</tool_call>') else '<tool_call>oops</tool_call>' end, text) as said, text from {conversations}"""


@query("extract_tool_calls", f"with c as {plain(CALL)} select conv_id, turn, cast(case when turn % 2 = 0 then 1 else 0 end as int) as n_calls, case when turn % 2 = 0 then 'find' end as name, text as rest from c")
def extract_tool_calls(spark, sf):
    df = derive(spark, sf, CALL).select("conv_id", "turn", tool_calls(F.col("said")).alias("t"))
    return df.select("conv_id", "turn", F.size("t.calls").alias("n_calls"), F.get("t.calls", F.lit(0))["name"].alias("name"), F.col("t.rest").alias("rest"))


@query("segment_tool_turns", "select event_id, cast(3 as int) as n_turns, 'code,output,answer' as kinds, cast(value as varchar) is not null as has_value from events where event_id % 4 <> 0 union all select event_id, null, null, true from events where event_id % 4 = 0")
def segment_tool_turns(spark, sf):
    code = F.concat(F.lit("First.<code>print("), F.col("user_id").cast("string"), F.lit(")</code>"))
    output = F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.lit("<interpreter>1</interpreter>"))
    text = F.concat(code, output, F.lit("<answer>done</answer>"))
    t = table(spark, sf, "events").select("event_id", tool_turns(text).alias("t"), F.col("value").isNotNull().alias("has_value"))
    return t.select("event_id", F.when(F.col("t").isNotNull(), F.size("t")).alias("n_turns"), F.array_join(F.transform("t", lambda x: x["kind"]), ",").alias("kinds"), "has_value")


@query("linear_prob_clip", "select event_id, " + r("greatest(0, least(1, value / 50 - 0.2e0))") + " as p from events")
def linear_prob_clip(spark, sf):
    return rounded(table(spark, sf, "events").select("event_id", clip(F.col("value") / 50 - 0.2, 0.0, 1.0).alias("p")))


# prompts ---------------------------------------------------------------------


@query("strip_to_question", "select item_id, trim(split_part(trim(text, ' ' || chr(10)), chr(10), 1)) as q from benchmark")
def strip_to_question(spark, sf):
    text = F.concat(F.lit("Rules Question: none\nQuestion: "), F.ltrim("text"))
    return table(spark, sf, "benchmark").select("item_id", X.strip_to_question(text).alias("q"))


@query("format_simple_prompt", "select item_id, concat('Question: ', text, chr(10), 'Answer:') as prompt from benchmark")
def format_simple_prompt(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", prompts.fill(prompts.QUERY_PROMPT, q=F.col("text")).alias("prompt"))


RISK_TEXT = "'" + prompts.RISK_MATHS.replace("'", "''") + "'"
QA_TEXT = "'" + prompts.RISK_QA.replace("'", "''") + "'"
PERCENT = "cast(cast(round_even(risk_t * 100, 0) as bigint) as varchar)"
PENALTY = "case when risk_t >= 1 then 'inf' else printf('%.2f', risk_t / (1 - risk_t)) end"


def filled(text: str) -> str:
    return f"replace(replace(replace({text}, '{{percent}}', {PERCENT}), '{{penalty}}', {PENALTY}), '{{q}}', gold)"


@query("build_prompt", f"{E} select event_id, case when data_source in ('nq', 'triviaqa') then {filled(QA_TEXT)} else {filled(RISK_TEXT)} end as prompt from e")
def build_prompt(spark, sf):
    is_qa = F.col("data_source").isin("nq", "triviaqa")
    return pick(spark, sf, prompts.build_prompt(F.col("gold"), "explicit_risk", is_qa, F.col("risk_t")).alias("prompt"))


@query("build_prompt_response", f"{E} select event_id, replace('{prompts.RESPONSE_MATHS.replace(chr(39), chr(39) * 2)}', '{{q}}', gold) as prompt from e")
def build_prompt_response(spark, sf):
    return pick(spark, sf, prompts.build_prompt(F.col("gold"), "verbalized_brier", F.lit(False)).alias("prompt"))


@query("infer_strategy", "select event_id, case event_id % 4 when 0 then 'verbalized_ce' when 1 then 'claim_minimum' when 2 then 'baseline' else 'verbalized_brier' end as strategy from events")
def infer_strategy(spark, sf):
    names = F.array(*[F.lit(f"/models/{n}") for n in ("X_Confidence_CE", "confidence_min_2", "my-baseline", "other")])
    path = F.get(names, (F.col("event_id") % 4).cast("int"))
    return table(spark, sf, "events").select("event_id", prompts.infer_strategy(path).alias("strategy"))


# predicates ------------------------------------------------------------------


@query("drop_math_sources", f"{E} select event_id, data_source from e where data_source not in ('math_dapo', 'aime_2024', 'nq')")
def drop_math_sources(spark, sf):
    return filters.drop_math_sources(responses(spark, sf), ["NQ"]).select("event_id", "data_source")


@query("is_qa_row", f"{E} select event_id, data_source in ('nq', 'triviaqa') or event_id % 2 = 0 as qa from e")
def is_qa_row(spark, sf):
    prompt = F.when(F.col("event_id") % 2 == 0, F.lit("What now? ")).otherwise(F.lit("Compute."))
    return pick(spark, sf, filters.is_qa_row(F.col("data_source"), prompt).alias("qa"))


@query("source_predicates", f"{E} select event_id, data_source like 'searchR1%' as search, data_source in ('nq', 'triviaqa') as openqa, case when data_source = 'nq' then 'math_dapo' else data_source end as norm from e")
def source_predicates(spark, sf):
    s = F.col("data_source")
    renamed = F.when(s == "nq", F.lit("dapo_math")).otherwise(s)
    return pick(spark, sf, filters.is_searchr1(s).alias("search"), filters.is_openqa(s).alias("openqa"), filters.norm_source(renamed).alias("norm"))


# scoring ---------------------------------------------------------------------


def scored(df, strategy, *fields, **options):
    out = scoring.score(df, strategy, **options)
    return rounded(out.select("event_id", *[F.col(f"result.{f}").alias(f) for f in fields]))


QA_ANS = f"""coalesce({blank(last('response', ANS))}, {blank(last('response', 'best guess: ([^' + chr(10) + ']+)'))},
  {blank(last('response', 'my answer is *([^.' + chr(10) + ']+)'))}, {blank(last('response', '<answer>([^<]*)</answer>'))})"""
MATHS = "(data_source in ('math_dapo', 'aime_2024'))"
NOR = "trim(lower(regexp_replace(coalesce(qa, ''), '[<>]', '', 'g')))"
BASEX = f"""x as (select e.*, {NORM} as np, {QA_ANS} as qa, {STRICT} as conf,
  {blank(last('response', '<answer>([^<]*)</answer>'))} as tg from e),
y as (select *, case when {MATHS} then np = gold else qa is not null and qa <> '<IDK>' and trim(qa) = gold end as ok,
  case when {MATHS} then contains(np, '<IDK>') else coalesce(qa = '<IDK>', false) end as idk,
  case when {MATHS} then least(0.999999e0, risk_t) else least(0.999e0, risk_t) end as t from x)"""


@query("score_binary", f"{E}, {BASEX} select event_id, case when ok then 1e0 else -1e0 end as score, ok as acc, idk as abstention from y")
def score_binary(spark, sf):
    return scored(responses(spark, sf), "baseline", "score", "acc", "abstention")


@query(
    "score_explicit_risk",
    f"""{E}, {BASEX}, z as (select y.*, case when {MATHS} then ok else coalesce(tg <> '<IDK>' and tg = gold, false) end as ok2,
  case when {MATHS} then idk else coalesce(tg = '<IDK>', false) end as idk2 from y)
select event_id, {r('case when idk2 then 0 when ok2 then 1 else -(t / (1 - t)) end', 4)} as score, ok2 as acc from z""",
)
def score_explicit_risk(spark, sf):
    return rounded(scored(responses(spark, sf), "explicit_risk", "score", "acc"), 4)


FALL = f"""coalesce({blank(last('response', ANS))}, {blank(last('response', 'best guess: ([^' + chr(10) + ']+)'))},
  {blank(last('response', 'my answer is *([^.' + chr(10) + ']+)'))}, '[INVALID]')"""
CONFX = f"""x as (select e.*, regexp_replace({FALL}, '\\s', '', 'g') as np, {QA_ANS} as qa, {STRICT} as p from e),
y as (select *, case when {MATHS} then np = gold else qa is not null and qa <> '<IDK>' and trim(qa) = gold end as ok from x)"""


@query("score_brier", f"{E}, {CONFX} select event_id, {r('case when ok then 2 * p - p * p else -p * p end')} as score, ok as acc, {r('p')} as confidence from y")
def score_brier(spark, sf):
    return scored(responses(spark, sf), "verbalized_brier", "score", "acc", "confidence")


PC = "greatest(0.01e0, least(0.99e0, p))"


@query("score_cross_entropy", f"{E}, {CONFX} select event_id, {r(f'case when ok then ln({PC} / 0.01e0) else ln((1 - {PC}) / 0.99e0) end / ln(99e0)')} as score from y")
def score_cross_entropy(spark, sf):
    return scored(responses(spark, sf), "verbalized_ce", "score")


@query(
    "score_jeffreys",
    f"{E}, {CONFX} select event_id, {r('2 / pi() * (case when ok then 1 else -1 end * asin(sqrt(p)) + sqrt(p * (1 - p)))')} * case when {MATHS} then 1 end as score from y",
)
def score_jeffreys(spark, sf):
    """Sources without a rule get no score."""
    return scored(responses(spark, sf), "jeffreys", "score", strict=False)


@query(
    "score_critic_value",
    f"{E}, x as (select *, {NORM} = gold as ok, greatest(0, least(1, case when critic_value < 0 or critic_value > 1 then (critic_value + 1) / 2 else critic_value end)) as p from e) select event_id, {r('case when ok then 2 * p - p * p else -p * p end')} as score, {r('p')} as confidence from x",
)
def score_critic_value(spark, sf):
    return scored(responses(spark, sf), "critic_value", "score", "confidence")


CLAIMX = f"x as (select e.*, {HELD} as v, split_part(claimed, 'Answer: ', -1) = gold as ok, case when {MATHS} then 1 end as known from e)"


@query(
    "score_claims",
    f"{E}, {CLAIMX}, y as (select event_id, ok, known, list_product(v) as a, list_min(v) as b from x) select event_id, {r('case when ok then 2 * a - a * a else -a * a end')} * known as product_score, {r('case when ok then 2 * b - b * b else -b * b end')} * known as minimum_score from y",
)
def score_claims(spark, sf):
    df = responses(spark, sf).withColumn("response", F.col("claimed"))
    both = scoring.score(scoring.score(df, "claim_product", "a", strict=False), "claim_minimum", "b", strict=False)
    return rounded(both.select("event_id", F.col("a.score").alias("product_score"), F.col("b.score").alias("minimum_score")))


TAGX = f"x as (select e.*, trim({last('tagged', '<answer>([^<]*)</answer>', 'c')}) as a from e)"


def tagged(spark, sf):
    gold = F.array(F.concat(F.lit("the P"), "gold"))
    return responses(spark, sf).withColumn("response", F.col("tagged")).withColumn("ground_truth", gold)


@query("score_em", f"{E}, {TAGX} select event_id, case when a is null then 0e0 when a = 'The p' || gold || '!' then 1e0 else 0.1e0 end as score from x")
def score_em(spark, sf):
    return scored(tagged(spark, sf), "qa_em", "score", format_score=0.1)


@query("score_subem", f"{E}, {TAGX} select event_id, case when a like '%p' || gold || '%' then 1e0 else 0e0 end as score from x")
def score_subem(spark, sf):
    df = tagged(spark, sf).withColumn("ground_truth", F.array(F.concat(F.lit("P"), "gold")))
    return scored(df, "qa_subem", "score")


@query("score_gsm8k", f"{E} select event_id, case when replace({last('worked', '#### ([0-9,]+)')}, ',', '') = gold || '0' || gold || '0' then 1e0 else 0e0 end as score from e")
def score_gsm8k(spark, sf):
    df = responses(spark, sf).withColumn("response", F.col("worked"))
    gold = F.array(F.concat("gold", F.lit("0"), "gold", F.lit("0")))
    return scored(df.withColumn("ground_truth", gold), "gsm8k", "score")




def boxed(spark, sf, gold):
    return responses(spark, sf).withColumn("response", F.col("boxed")).withColumn("ground_truth", F.array(gold))


@query("score_math_boxed", f"{E} select event_id, case when {BOX_OK} then 1e0 else 0e0 end as score from e")
def score_math_boxed(spark, sf):
    return scored(boxed(spark, sf, F.concat("gold", F.lit("/7"))), "math", "score")


@query("score_math_dapo", f"{E} select event_id, case when {NORM} = gold then 1e0 else -1e0 end as score, {NORM} as pred from e")
def score_math_dapo(spark, sf):
    return scored(responses(spark, sf), "math_dapo", "score", "pred")


@query("score_geo", f"{E} select event_id, {r(f'case when {BOX_OK} then 0.9e0 else 0 end')} as score from e")
def score_geo(spark, sf):
    return scored(boxed(spark, sf, F.concat(F.lit("\\frac{"), "gold", F.lit("}{7}"))), "geo3k", "score")


@query("score_math_lenient", f"{E} select event_id, case when {BOX_OK} then 1e0 else 0e0 end as score from e")
def score_math_lenient(spark, sf):
    df = boxed(spark, sf, F.concat(F.lit("\\frac{"), "gold", F.lit("}{7}")))
    return scored(df, "prime_math", "score")


@query("score_choice", "select event_id, case when event_id % 4 = user_id % 4 then 1e0 else 0e0 end as score from events")
def score_choice(spark, sf):
    letter = [F.substring(F.lit("ABCD"), (F.col(c) % 4 + 1).cast("int"), F.lit(1)) for c in ("event_id", "user_id")]
    df = table(spark, sf, "events").withColumn("response", F.concat(F.lit("Answer: "), letter[0]))
    return scored(df.withColumn("ground_truth", F.array(letter[1])), "gpqa", "score")


@query("score_char_count", f"{E} select event_id, case when {BOX_OK} then 1e0 else 0e0 end as score from e")
def score_char_count(spark, sf):
    return scored(boxed(spark, sf, F.concat(F.lit("\\frac{"), "gold", F.lit("}{7}"))), "char_count", "score")


FMT = "case when event_id % 9 <> 0 and event_id % 15 <> 0 then 1e0 else 0e0 end"


@query("score_format_answer", f"{E}, {TAGX} select event_id, {FMT} + case when a = 'The p' || gold || '!' then 1e0 else 0e0 end as score from x")
def score_format_answer(spark, sf):
    gold = F.array(F.concat(F.lit("The p"), "gold", F.lit("!")))
    return scored(tagged(spark, sf).withColumn("ground_truth", gold), "fact_naive", "score")


@query(
    "fact_batch_metrics",
    f"{E}, {TAGX}, y as (select {FMT} as f, case when a = 'The p' || gold || '!' then 1e0 else 0e0 end as s from x) select {r('avg(f)')} as format_mean, {r('avg(s)')} as answer_mean, {r('avg(f + s)')} as total_mean, cast(sum(f) as bigint) as n_well_formed, count(*) as n_rows from y",
)
def fact_batch_metrics(spark, sf):
    gold = F.array(F.concat(F.lit("The p"), "gold", F.lit("!")))
    df = scoring.format_and_answer(tagged(spark, sf).withColumn("ground_truth", gold))
    return rounded(training.fact_metrics(df))


@query("score_tool_bonus", f"{E} select event_id, {r(f'case when {BOX_OK} then 1 else least(0, -1 + (num_turns - 2) / 2 * 0.1e0) end')} as score from e")
def score_tool_bonus(spark, sf):
    return scored(boxed(spark, sf, F.concat(F.lit("\\frac{"), "gold", F.lit("}{7}"))), "tool_math", "score")


@query("overlong_penalty", f"{E} select event_id, {r('least(-(len(response) - 40) / 20e0 * 0.5e0, 0)')} as overlong_reward, {r('1 + least(-(len(response) - 40) / 20e0 * 0.5e0, 0)')} as score, len(response) > 40 as overlong from e")
def overlong_penalty(spark, sf):
    df = responses(spark, sf).select("event_id", F.lit(1.0).alias("score"), F.length("response").alias("response_length"))
    out = scoring.overlong_penalty(df, 60, 20, 0.5)
    return rounded(out.select("event_id", "overlong_reward", "score", "overlong"))


@query("score_router", f"{E} select event_id, data_source, case when data_source in ('nq', 'triviaqa') then null when data_source = 'searchR1_nq' then case when {last('response', '<answer>([^<]*)</answer>')} is not null and trim({last('response', '<answer>([^<]*)</answer>')}) = gold then 1e0 else 0e0 end when {NORM} = gold then 1e0 else -1e0 end as score from e")
def score_router(spark, sf):
    out = scoring.score(responses(spark, sf), "by_source", strict=False)
    return rounded(out.select("event_id", "data_source", F.col("result.score").alias("score")))


@query(
    "score_by_source",
    f"{E}, x as (select data_source, cast(floor(event_id / 3) as bigint) as row_id, case when {NORM} = gold then 1e0 else -1e0 end as s from e), y as (select data_source, row_id, avg(s) as s from x group by 1, 2) select data_source, {r('avg(s)')} as test_score, count(*) as n_rows from y group by 1",
)
def score_by_source_query(spark, sf):
    """Responses listed per row, exploded, scored, averaged twice."""
    exploded = scoring.score(responses(spark, sf).withColumn("row_id", F.floor(F.col("event_id") / 3)), "math_dapo")
    return rounded(score_by_source(exploded.withColumn("score", F.col("result.score"))))


@query(
    "grade_predictions",
    f"""{E}, x as (select e.*, case when data_source = 'math_dapo' then 'aime' when data_source = 'nq' then 'flashrag_nq' else 'other' end as dataset,
  {NORM} as np, contains(response, '<IDK>') as idk, {STRICT} as cs,
  coalesce({blank(last('response', '(?m)^answer *: *([^' + chr(10) + ']+)'))}, {blank(last('response', '(?m)^best guess: ([^' + chr(10) + ']+)'))},
  {blank(last('response', '(?m)^my answer is *([^.' + chr(10) + ']+)'))}, {blank(last('response', '<answer>([^<]*)</answer>'))}) as pa from e),
y as (select *, case when idk then 0 else cs end as c, case when dataset = 'aime' then np = gold else coalesce(pa = gold, false) end as ok from x)
select event_id, dataset, case when dataset = 'aime' then np else pa end as predicted_answer, {r('c')} as confidence, c < 0.5 or idk as abstained, ok as correct, ok and not (c < 0.5 or idk) as is_correct from y""",
)
def grade_predictions(spark, sf):
    s = F.col("data_source")
    name = F.when(s == "math_dapo", "aime").when(s == "nq", "flashrag_nq").otherwise(F.lit("other"))
    out = grade(responses(spark, sf).withColumn("dataset", name))
    return rounded(out.select("event_id", "dataset", "predicted_answer", "confidence", "abstained", "correct", "is_correct"))


@query(
    "grade_predictions_with_labels",
    f"{E} select event_id, event_id % 3 = 1 as correct, event_id % 3 = 0 as not_attempted from e where event_id % 3 < 3",
)
def grade_predictions_with_labels(spark, sf):
    labels = F.array(F.lit("not_attempted"), F.lit("correct"), F.lit("incorrect"))
    df = responses(spark, sf).withColumn("dataset", F.lit("simpleqa"))
    df = df.withColumn("label", F.get(labels, (F.col("event_id") % 3).cast("int")))
    out = grade(df, t=0.0, strategy="explicit_risk", labels="label")
    idk = F.col("response").contains(X.IDK_TOKEN)
    return out.select("event_id", "correct", (F.col("abstained") & ~idk | (F.col("label") == "not_attempted")).alias("not_attempted"))


SUBS = "with s as (select conv_id, turn, cast((turn * 7 + conv_id) % 5 as double) / 4 as score from conversations where role = 'assistant')"


@query("submission_penalty", f"{SUBS} select conv_id, turn, case when score > lag(score, 1, 0) over (partition by conv_id order by turn) then 0e0 else -0.05e0 end as penalty from s")
def submission_penalty(spark, sf):
    turns = derive(spark, sf, MESSAGES).where("role = 'assistant'")
    df = turns.withColumn("score", ((F.col("turn") * 7 + F.col("conv_id")) % 5).cast("double") / 4)
    return rounded(scoring.submission_penalty(df).select("conv_id", "turn", "penalty"))


@query("last_assistant_turn", "select conv_id, coalesce(arg_max(text, turn) filter (where role = 'assistant'), '') as response from conversations group by 1")
def last_assistant_turn(spark, sf):
    return scoring.last_assistant(derive(spark, sf, MESSAGES))


# claims and grades -----------------------------------------------------------


@query("explode_claims", f"{E}, x as (select event_id, unnest(regexp_extract_all(claimed, '<confidence value=([0-9.]+)', 1, 'i')) as v, generate_subscripts(regexp_extract_all(claimed, '<confidence value=([0-9.]+)', 1, 'i'), 1) - 1 as i from e) select event_id, cast(i as int) as claim_idx, {r('least(1, cast(v as double))')} as claim_confidence from x")
def explode_claims(spark, sf):
    return rounded(joins.explode_claims(responses(spark, sf), "event_id", "claimed").select("event_id", "claim_idx", "claim_confidence"))


@query(
    "join_claim_labels",
    f"{E}, x as (select event_id, unnest(regexp_extract_all(claimed, '<confidence value=([0-9.]+)', 1, 'i')) as v, generate_subscripts(regexp_extract_all(claimed, '<confidence value=([0-9.]+)', 1, 'i'), 1) - 1 as i from e) select event_id as index, cast(i as int) as claim_idx, {r('least(1, cast(v as double))')} as claim_confidence, cast(case when event_id % 5 <> 0 and i < 2 then 1 else 0 end as int) as claim_label from x",
)
def join_claim_labels(spark, sf):
    preds = responses(spark, sf).select(F.col("event_id").alias("index"), F.col("claimed").alias("full_response"))
    labels = preds.where(F.col("index") % 5 != 0).select("index", F.array(F.lit(1), F.lit(1)).alias("claim_labels"))
    return rounded(joins.join_claim_labels(preds, labels))


@query("export_claims_for_labeling", f"{E} select event_id as index, gold as question, event_id % 2 = 0 as final_answer_correct, cast(len(regexp_extract_all(claimed, '<confidence value=', 0, 'i')) as int) as n_claims from e where event_id % 6 > 0 or true")
def export_claims_for_labeling(spark, sf):
    df = responses(spark, sf).select(
        F.col("event_id").alias("index"),
        F.col("gold").alias("question"),
        (F.col("event_id") % 2 == 0).alias("correct"),
        F.col("claimed").alias("full_response"),
    )
    out = export_claims(df)
    return out.select("index", "question", "final_answer_correct", F.size("claim_confidences").alias("n_claims"))


GRADES = f"{E}, p as (select event_id, sha1(concat('{{\"a\": \"', pred_text, '\", \"q\": \"', gold, '\", \"r\": \"', data_source, '\"}}')) as key from (select *, concat('r', user_id) as pred_text from e) z)"


@query("lookup_grades", f"{GRADES}, c as (select key, max(event_id % 2) as bit from p where event_id % 3 = 0 group by 1) select p.event_id, p.key, case when c.bit = 1 then 'correct' when c.bit = 0 then 'incorrect' end as grading_label from p left join c using (key)")
def lookup_grades(spark, sf):
    df = responses(spark, sf).select(
        "event_id", F.col("gold").alias("question"), F.col("data_source").alias("reference"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("model_answer")
    )
    keyed = df.withColumn("key", joins.grade_key(F.col("question"), F.col("reference"), F.col("model_answer")))
    known = keyed.where(F.col("event_id") % 3 == 0).groupBy("key").agg(F.max(F.col("event_id") % 2).alias("bit"))
    labels = known.select("key", F.when(F.col("bit") == 1, "correct").otherwise(F.lit("incorrect")).alias("label"))
    return joins.lookup_grades(df, labels).select("event_id", "key", "grading_label")


@query("read_label_cache", "select 'k' || user_id as key, arg_max(event_type, event_id) as label from events where event_type <> 'view' group by 1")
def read_label_cache(spark, sf):
    """Last write wins; lines without a label are dropped."""
    path = shared_folder(spark, "grades")
    label = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.col("event_type"))
    cache = table(spark, sf, "events").orderBy("event_id").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), label.alias("label"))
    cache.write.json(path)
    return readers.read_label_cache(spark, path)


# Python hooks ----------------------------------------------------------------


def _load_counter():
    return lambda text: [len(word) for word in text.split()]


@query("tokenizer_hook", "select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) as n_tokens from documents")
def tokenizer_hook(spark, sf):
    docs = table(spark, sf, "documents")
    return registry.with_token_ids(docs, _load_counter, "text").select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"))


def _same(responses_: list[str], golds: list[str]) -> list[float]:
    return [1.0 if g in a else 0.0 for a, g in zip(responses_, golds, strict=True)]


@query("batch_scorer", f"{E} select event_id, case when contains(response, gold) then 1e0 else 0e0 end as score from e")
def batch_scorer(spark, sf):
    return registry.score_batch(responses(spark, sf), _same, "response", "gold").select("event_id", "score")


@query("strategy_factory", f"{E}, {CONFX} select event_id, {r(f'case when ok then ln(greatest(0.1e0, least(0.9e0, p)) / 0.1e0) else ln((1 - greatest(0.1e0, least(0.9e0, p))) / 0.9e0) end / ln(9e0)')} as score from y")
def strategy_factory(spark, sf):
    df = responses(spark, sf)
    rule = registry.get_reward_function("verbalized_ce", eps=0.1)
    return rounded(df.select("event_id", rule(df)["score"].alias("score")))


@query("register_scorer", "select doc_id, cast(len(text) as double) as score from documents")
def register_scorer(spark, sf):
    """A user's own column rule registered and looked up by name."""
    scorers = registry.Registry("scorer")
    scorers.register("length")(lambda df: F.length("text").cast("double"))
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", scorers.get("length")(docs).alias("score"))


@query("drop_overlong_prompts", "select doc_id from documents where len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 200")
def drop_overlong_prompts(spark, sf):
    docs = table(spark, sf, "documents")
    sized = docs.withColumn("n_tokens", F.size(whitespace_tokens(F.col("text"))))
    return filters.drop_overlong(sized, 200, "n_tokens").select("doc_id")


@query("numeric_text", "select event_id, " + r("try_cast(case when event_id % 7 = 0 then 'x' else cast(user_id as varchar) || '.5' end as double)") + " as n from events")
def numeric_text(spark, sf):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("1d")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".5")))
    return rounded(table(spark, sf, "events").select("event_id", number(text).alias("n")))
