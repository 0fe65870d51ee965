"""Token rows for supervised and preference training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import pad_array, truncate_tokens


def _fit(c: Column, limit: int, pad, mode: str) -> Column:
    return pad_array(truncate_tokens(c, limit, mode), limit, pad)


def sft_rows(
    df: DataFrame,
    limit: int,
    truncation: str = "right",
    pad_id: int = 0,
    eos_id: int = 2,
    prompt: str = "prompt_ids",
    response: str = "response_ids",
) -> DataFrame:
    """Prompt, response and end token in one padded array.

    The loss mask is 0 on the prompt but for its last position, 1 on the
    response, and 0 on the final token, so that position i predicts i + 1.
    """
    ids = F.concat(F.col(prompt), F.col(response), F.array(F.lit(eos_id).cast("bigint")))
    n_prompt, n = F.size(prompt), F.size("__ids")
    mask = F.transform("__ids", lambda _, i: ((i >= n_prompt - 1) & (i < n - 1)).cast("int"))
    attention = F.transform("__ids", lambda _: F.lit(1))
    return (
        df.withColumn("__ids", ids)
        .withColumn("input_ids", _fit(F.col("__ids"), limit, pad_id, truncation))
        .withColumn("loss_mask", _fit(mask, limit, 0, truncation))
        .withColumn("attention_mask", _fit(attention, limit, 0, truncation))
        .drop("__ids")
    )


def build_conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(conv, turn, role, text)`` to one row of ordered messages."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    messages = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return turns.groupBy(key).agg(messages.alias("messages"))


def multiturn_rows(
    turns: DataFrame, ids: str, prefix: int = 0, limit: int | None = None, mode: str = "right", pad_id: int | None = None, key: str = "conv_id"
) -> DataFrame:
    """Token ids of whole dialogues with a loss mask on assistant tokens.

    Each message is tokenised on its own (column ``ids``); the first ``prefix``
    tokens of an assistant message are the generation prompt and stay masked.
    """
    loss = F.transform(
        ids, lambda _, i: ((F.col("role") == "assistant") & (i >= F.lit(prefix))).cast("int")
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.col(ids).alias("ids"), loss.alias("loss"))))
    packed = turns.groupBy(key).agg(ordered.alias("__m"))
    rows = packed.select(
        key, F.flatten(F.col("__m.ids")).alias("input_ids"), F.flatten(F.col("__m.loss")).alias("loss_mask")
    )
    if limit is not None:
        rows = rows.select(
            key,
            truncate_tokens(F.col("input_ids"), limit, mode).alias("input_ids"),
            truncate_tokens(F.col("loss_mask"), limit, mode).alias("loss_mask"),
        )
    rows = rows.withColumn("position_ids", F.transform("input_ids", lambda _, i: i))
    if limit is None or pad_id is None:
        return rows
    return rows.select(
        key,
        pad_array(F.col("input_ids"), limit, pad_id).alias("input_ids"),
        pad_array(F.col("loss_mask"), limit, 0).alias("loss_mask"),
        pad_array(F.col("position_ids"), limit, 0).alias("position_ids"),
    )


def preference_rows(
    df: DataFrame, limit: int, eos_id: int | None = None, pad_id: int = 0, prompt: str = "prompt_ids"
) -> DataFrame:
    """prompt+chosen and prompt+rejected rows, cut or right-padded."""
    ending = [] if eos_id is None else [F.array(F.lit(eos_id).cast("bigint"))]
    sides = F.array(
        *[
            F.struct(F.lit(side).alias("side"), F.concat(F.col(prompt), F.col(f"{side}_ids"), *ending).alias("ids"))
            for side in ("chosen", "rejected")
        ]
    )
    exploded = df.withColumn("__s", F.explode(sides))
    keep = [c for c in df.columns if c not in (prompt, "chosen_ids", "rejected_ids")]
    ids = F.slice(F.col("__s.ids"), F.lit(1), F.lit(limit))
    return exploded.select(
        *keep,
        F.col("__s.side").alias("side"),
        pad_array(ids, limit, pad_id).alias("input_ids"),
        pad_array(F.transform(ids, lambda _: F.lit(1)), limit, 0).alias("attention_mask"),
    )
