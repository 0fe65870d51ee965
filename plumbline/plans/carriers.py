"""Input tables of the registered queries, derived from the driver's tables.

Each is plain SQL that means the same in Spark and in other engines; braces
mark driver tables. All arithmetic that decides a value is on integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTIONS = """
select event_id, user_id as uid, event_type as data_source,
       concat('m', cast(event_id % 4 as string)) as method,
       cast((event_id * 7919) % 1001 as double) / cast(1000 as double) as confidence,
       case when (event_id * 104729 + user_id * 31) % 1000 < ((event_id * 7919) % 1001) then 1 else 0 end as correct,
       case when (event_id * 31) % 10 < 2 then true else false end as abstained,
       cast((event_id * 13) % 11 as double) / cast(10 as double) as risk_t,
       ts
from {events}
"""

SAMPLES = """
select cast(floor(event_id / 8) as bigint) as question_id, event_id % 8 as sample_idx,
       case when event_id % 13 = 0 then '' else concat('a', cast((event_id * 31 + user_id) % 4 as string)) end as answer,
       cast((event_id * 7919) % 1001 as double) / cast(1000 as double) as confidence,
       case when event_id % 13 <> 0 and (event_id * 31 + user_id) % 4 = cast(floor(event_id / 8) as bigint) % 4
            then 1 else 0 end as is_correct
from {events}
"""

ROLLOUTS = """
select event_id as seq_id,
       case when event_id % 50 = 0 then -event_id - 1 else user_id end as uid,
       event_type as data_source, event_id % 7 as step,
       cast((event_id * 7919 + user_id) % 5 as double) / cast(4 as double) as score,
       cast((event_id * 7919 + user_id) % 5 as double) / cast(4 as double)
         - cast(event_id % 3 as double) / cast(10 as double) as reward,
       case when (event_id * 104729) % 3 = 0 then cast(1 as double) else cast(0 as double) end as acc,
       concat('p', cast((event_id * 31) % 4 as string)) as pred,
       20 + event_id % 97 as prompt_length,
       case when event_id % 41 = 0 then 0 else 1 + (event_id * 37) % 200 end as response_length,
       1 + event_id % 6 as num_turns,
       cast((event_id * 53) % 701 as double) / cast(10 as double) as generate_seconds,
       cast((event_id * 29) % 307 as double) / cast(10 as double) as tool_seconds,
       -cast((event_id * 11) % 97 as double) / cast(10 as double) as log_prob_sum,
       -cast((event_id * 17) % 89 as double) / cast(10 as double) as ref_log_prob_sum
from {events}
"""

TOKENS = """
select o_custkey as uid, seq_id, pos,
       pk % 50 as token_id, (pk + q) % 50 as other_token_id,
       case when pk % 5 = 0 then 0 else 1 end as mask,
       case when pk % 7 = 0 then cast(1 as double) else cast(d as double) / cast(100 as double) end as reward,
       cast(d as double) / cast(100 as double) as value,
       -cast(q as double) / cast(50 as double) as old_log_prob,
       -cast(q as double) / cast(50 as double) + cast(3 * d - 15 as double) / cast(100 as double) as log_prob,
       -cast(q as double) / cast(50 as double) + cast(4 * t - 14 as double) / cast(100 as double) as rollout_log_prob,
       -cast(q as double) / cast(50 as double) - cast(2 * t - 7 as double) / cast(100 as double) as ref_log_prob,
       cast(10 + t as double) / cast(100 as double) as entropy,
       cast(10 * d - 53 as double) / cast(100 as double) as advantage,
       cast(d + t as double) / cast(100 as double) as ret,
       cast(3 * d as double) / cast(100 as double) as vpred
from (select l_orderkey as seq_id, cast(l_linenumber - 1 as bigint) as pos,
             cast(sum(l_partkey) as bigint) as pk,
             cast(sum(cast(l_quantity as bigint)) as bigint) as q,
             cast(sum(cast(round(l_discount * 100) as bigint)) as bigint) as d,
             cast(sum(cast(round(l_tax * 100) as bigint)) as bigint) as t
      from {lineitem} group by l_orderkey, l_linenumber) l
join {orders} on seq_id = o_orderkey
"""

RESPONSES = """
select event_id, user_id, gold, data_source, num_turns, risk_t, critic_value,
       concat('Working on item ', cast(user_id as string), '.', chr(10), body, chr(10), stated) as response,
       concat('<think>case ', cast(user_id as string), '</think>', gap, '<answer> The p', pred, '! </answer>', tail) as tagged,
       concat('Draft. <Confidence value=0.5 text="x">old</Confidence>', chr(10), 'Solution:', chr(10),
              claims, 'Answer: ', pred) as claimed,
       concat('Thus ', chr(92), 'boxed{1} and ', chr(92), 'boxed{', chr(92), 'frac{', pred, '}{7}', closing) as boxed,
       concat('Add up.', chr(10), '#### ', pred, ',0', pred, '0') as worked
from (select event_id, user_id, cast((event_id * 17) % 5 as string) as gold,
             cast((event_id * 17 + case when user_id % 3 = 0 then 1 else 0 end) % 5 as string) as pred,
             case when event_id % 7 = 0 then 'aime_2024' when event_id % 7 = 1 then 'nq'
                  when event_id % 7 = 2 then 'triviaqa' when event_id % 7 = 3 then 'searchR1_nq'
                  else 'math_dapo' end as data_source,
             2 + event_id % 5 as num_turns,
             cast((event_id * 13) % 11 as double) / cast(10 as double) as risk_t,
             cast((event_id * 19) % 41 as double) / cast(20 as double) - cast(1 as double) as critic_value,
             case when event_id % 12 = 0 then 'No line here'
                  when event_id % 12 = 1 then 'Answer: <IDK>'
                  when event_id % 12 = 2 then concat('Best Guess: ', cast((event_id * 17) % 5 as string))
                  when event_id % 12 = 3 then concat('<answer> ', cast((event_id * 17) % 5 as string), ' </answer>')
                  when event_id % 12 = 4 then concat('My answer is ', cast((event_id * 17) % 5 as string), '. Done')
                  when event_id % 12 = 5 then concat('Answer: 9', chr(10), 'so answer :  ', cast((event_id * 17) % 5 as string))
                  else concat('Answer: ', cast((event_id * 17 + case when user_id % 3 = 0 then 1 else 0 end) % 5 as string))
             end as body,
             case when event_id % 10 = 0 then ''
                  when event_id % 10 = 1 then 'Confidence: high'
                  when event_id % 10 = 2 then 'Confidence: 85'
                  when event_id % 10 = 3 then 'Confidence: -1'
                  else concat('confidence :0.', lpad(cast((event_id * 7919) % 1000 as string), 3, '0')) end as stated,
             case when event_id % 9 = 0 then ' oops ' else chr(10) end as gap,
             case when event_id % 15 = 0 then '<answer>b</answer>' else '' end as tail,
             case when event_id % 6 = 0 then ''
                  else concat('<Confidence value=0.', cast(1 + event_id % 9 as string), ' text="a">one</Confidence>', chr(10),
                              '<confidence value=', case when event_id % 4 = 0 then '1.7' else '0.8' end,
                              ' text="b">two</confidence>', chr(10)) end as claims,
             case when event_id % 8 = 0 then '' else '} end' end as closing
      from {events}) e
"""

RESULTS = """
select concat(case when method_id = 0 then 'Plain Model (Base)' when method_id = 1 then 'Binary Reward (TriviaQA)'
                   when method_id = 2 then 'Verbalized Brier (NQ+HotpotQA)' else 'Verbalized CE RLOO (TriviaQA)' end) as method,
       dataset, method_id,
       cast(n as bigint) as n_samples,
       cast(s1 % 97 as double) / cast(97 as double) as snr_gain,
       cast(s1 % 89 as double) / cast(89 as double) as auc,
       cast(s2 % 83 as double) / cast(83 as double) as abstention_accuracy,
       cast(s2 % 5 as double) / cast(10 as double) as smooth_ece,
       cast(s1 % 7 as double) / cast(10 as double) as brier,
       cast(s2 % 71 as double) / cast(50 as double) as nll,
       cast(s1 % 3 as double) / cast(4 as double) as predictive_accuracy
from (select event_id % 4 as method_id, event_type as dataset, count(*) as n,
             cast(sum(event_id * 13 + user_id) as bigint) as s1, cast(sum(user_id * 7) as bigint) as s2
      from {events} where not (event_id % 4 = 3 and event_type = 'view') group by event_id % 4, event_type) g
"""

MESSAGES = """
select conv_id, turn, role, text from {conversations}
"""

CORPUS = """
select doc_id, concat('Title ', cast(doc_id as string), chr(10), text) as contents, text, lang, source, n_chars
from {documents}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TABLES = ["events", "lineitem", "orders", "conversations", "documents", "benchmark", "embeddings", "labels"]


def _named(text: str, name_of: Callable[[str], str]) -> str:
    for name in TABLES:
        text = text.replace("{" + name + "}", name_of(name))
    return text


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(_named(text, lambda name: f"parquet.`{sf_dir}/{name}.parquet`"))


def plain(text: str) -> str:
    """The same text with bare table names."""
    return "(" + _named(text, str).strip() + ")"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded at the edge; sums depend on the order of adding."""
    return df.select(
        *[
            (F.round(F.col(c), places) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def r(expr: str, places: int = 6) -> str:
    return f"(round({expr}, {places}) + 0)"


def hash48(*parts):
    """The draw of ``functions.basics.hash48`` in SQL."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(map(str, parts))})), 1, 12))::bigint"
