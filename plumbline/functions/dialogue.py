"""Tool calls and tool turns inside assistant text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.basics import strip

TOOL_CALL = r"(?s)<tool_call>(.*?)</tool_call>"
REASONING = r"(?s)<\|channel\|>analysis<\|message\|>.*?<\|end\|>"
CHANNEL_CALL = r"(?s)<\|start\|>assistant<\|channel\|>commentary to=functions\.(\w+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"
TOOL_PART = r"(?s)(<code>.*?</code>|<interpreter>.*?</interpreter>|<answer>.*?</answer>)"


def tool_calls(c: Column, dialect: str = "tagged") -> Column:
    """``STRUCT<calls ARRAY<STRUCT<name, arguments>>, rest>`` of a message.

    A call whose JSON does not parse or lacks a name is dropped.
    """
    if dialect == "tagged":
        bodies = F.regexp_extract_all(c, F.lit(TOOL_CALL), F.lit(1))
        parsed = F.transform(
            bodies,
            lambda b: F.struct(
                F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")
            ),
        )
        calls = F.filter(parsed, lambda x: x["name"].isNotNull() & x["arguments"].isNotNull())
        return F.struct(calls.alias("calls"), F.regexp_replace(c, TOOL_CALL, "").alias("rest"))
    if dialect == "channel":
        text = F.regexp_replace(c, REASONING, "")
        names = F.regexp_extract_all(text, F.lit(CHANNEL_CALL), F.lit(1))
        bodies = F.regexp_extract_all(text, F.lit(CHANNEL_CALL), F.lit(2))
        parsed = F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), b.alias("arguments")))
        calls = F.filter(parsed, lambda x: F.get_json_object(x["arguments"], "$").isNotNull())
        return F.struct(calls.alias("calls"), F.regexp_replace(text, CHANNEL_CALL, "").alias("rest"))
    raise ValueError(f"unknown tool dialect {dialect!r}")


def tool_turns(c: Column) -> Column:
    """Code, interpreter output and answer parts as a list of messages.

    Code becomes an assistant tool call and interpreter output a tool message.
    The list must alternate and end with the answer; if not, it is NULL.
    """
    parts = F.regexp_extract_all(c, F.lit(TOOL_PART), F.lit(1))

    def inner(p: Column) -> Column:
        return strip(F.regexp_extract(p, r"(?s)^<\w+>(.*)</\w+>$", 1))

    turns = F.transform(
        parts,
        lambda p: F.when(
            p.startswith("<code>"),
            F.struct(F.lit("assistant").alias("role"), F.lit("code").alias("kind"), inner(p).alias("content")),
        )
        .when(
            p.startswith("<interpreter>"),
            F.struct(F.lit("tool").alias("role"), F.lit("output").alias("kind"), inner(p).alias("content")),
        )
        .otherwise(F.struct(F.lit("assistant").alias("role"), F.lit("answer").alias("kind"), inner(p).alias("content"))),
    )
    shape = F.array_join(F.transform(turns, lambda t: t["kind"]), ",")
    return F.when(shape.rlike("^(code,output,)*answer$"), turns)
