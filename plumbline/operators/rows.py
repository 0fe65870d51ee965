"""Row-shape operators: fields, prompts, repeats, chunks, folds, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import pieces
from plumbline.functions.text import QUESTION_MARKERS, strip_to_question
from plumbline.operators.scale import row_index, union_all


def coalesce_fields(df: DataFrame, names: list[str], out: str, default: str | None = "") -> DataFrame:
    """First present, non-null column of a list; absent columns are skipped."""
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    return df.withColumn(out, F.coalesce(*have, F.lit(default)))


def prompt_text(df: DataFrame, mode: str = "first", prompt: str = "prompt", out: str = "prompt_text") -> DataFrame:
    """First non-empty content of a message list, or the last user message.

    In ``last_user`` mode a non-blank ``question`` column wins.
    """
    messages = F.col(prompt)
    if mode == "first":
        text = F.try_element_at(F.filter(messages, lambda m: m["content"] != ""), F.lit(1))["content"]
        return df.withColumn(out, F.coalesce(text, F.lit("")))
    if mode == "last_user":
        text = F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]
        if "question" in df.columns:
            text = F.when(F.length(F.trim("question")) > 0, F.col("question")).otherwise(text)
        return df.withColumn(out, F.coalesce(text, F.lit("")))
    raise ValueError(f"unknown prompt mode {mode!r}")


# Field names looked up in evaluation sets.
QUESTION_FIELDS = ["question", "problem", "Problem"]
TRUTH_FIELDS = ["answer", "Answer", "solution", "golden_answers", "ground_truth"]


def extract_question(df: DataFrame, is_qa: bool = False, out: str = "question_text") -> DataFrame:
    """Question field, else the prompt's text; QA prompts are cut to the question."""
    named = coalesce_fields(df, QUESTION_FIELDS, "__q", None)
    if "prompt" not in df.columns:
        return named.withColumn(out, F.coalesce("__q", F.lit(""))).drop("__q")
    filled = prompt_text(named, "first", out="__p")
    from_prompt = strip_to_question(F.col("__p"), QUESTION_MARKERS) if is_qa else F.col("__p")
    return filled.withColumn(out, F.coalesce("__q", from_prompt)).drop("__q", "__p")


def extract_ground_truth(df: DataFrame, strict: bool = True, out: str = "truth") -> DataFrame:
    """Answer field, else ``reward_model.ground_truth`` as JSON text.

    Of a JSON object ``target``, ``answer``, ``text`` and ``value`` are tried. A
    plain string there is ignored unless ``strict`` is off.
    """
    named = coalesce_fields(df, TRUTH_FIELDS, "__a", None)
    if "reward_ground_truth" not in df.columns:
        return named.withColumn(out, F.col("__a")).drop("__a")
    raw = F.col("reward_ground_truth")
    keys = [F.get_json_object(raw, f"$.{k}") for k in ("target", "answer", "text", "value")]
    fallback = [] if strict else [F.when(~raw.startswith("{"), raw)]
    return named.withColumn(out, F.coalesce("__a", *keys, *fallback)).drop("__a")


def normalize_ground_truth(raw: Column, keys: tuple[str, ...] = ("target", "answer", "golden_answer")) -> Column:
    """JSON-ish ground truth to ``ARRAY<STRING>`` without nulls and blanks.

    Takes a scalar, a list or an object whose first known key holds either.
    """
    inner = F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in keys], raw)
    as_list = F.when(inner.startswith("["), F.from_json(inner, "ARRAY<STRING>"))
    return F.filter(F.coalesce(as_list, F.array(inner)), lambda x: x.isNotNull() & (x != ""))


def fill_ground_truth(df: DataFrame, out: str = "ground_truth") -> DataFrame:
    """Missing ground truth: first golden answer, else ``answer``, else blank."""
    options = []
    if out in df.columns:
        options.append(F.col(out))
    if "golden_answers" in df.columns:
        options.append(F.try_element_at("golden_answers", F.lit(1)))
    if "answer" in df.columns:
        options.append(F.col("answer"))
    return df.withColumn(out, F.coalesce(*options, F.lit("")))


def slim_predictions(df: DataFrame) -> DataFrame:
    names = ["confidence", "correct", "abstained", "predicted_answer", "risk_t"]
    return df.select(*[n for n in names if n in df.columns])


def rename_columns(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("old and new names differ in number")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def pop_columns(df: DataFrame, names: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Table without the columns, and the columns with their row key."""
    return df.drop(*names), df.select(key, *names)


def repeat_rows(df: DataFrame, n: int | str, row: str, interleave: bool = True) -> DataFrame:
    """Each row n times (or as often as a column says) with an ``ordinal``.

    Interleaved order keeps copies together (a, a, b, b); the other order
    repeats the whole table (a, b, a, b).
    """
    times = F.col(n) if isinstance(n, str) else F.lit(n)
    copies = df.where(times > 0).withColumn("rep", F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))))
    if isinstance(n, str):
        return copies.withColumn("ordinal", F.struct(F.col(row), F.col("rep")))
    if interleave:
        return copies.withColumn("ordinal", F.col(row) * n + F.col("rep"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return copies.withColumn("ordinal", F.col("rep") * total + F.col(row))


def unfold_columns(df: DataFrame, n: int, cols: list[str]) -> DataFrame:
    """Array columns cut into n runs, one row per run; the rest repeated."""
    rest = [c for c in df.columns if c not in cols]
    zipped = F.arrays_zip(*[pieces(F.col(c), n).alias(c) for c in cols])
    return df.select(*rest, F.posexplode(zipped).alias("chunk", "__z")).select(
        *rest, "chunk", *[F.col(f"__z.{c}").alias(c) for c in cols]
    )


def fold_batch(df: DataFrame, size: int, row: str = "row") -> DataFrame:
    """Consecutive rows to arrays of ``size``; ``row`` is a dense index."""
    values = [c for c in df.columns if c != row]
    group = F.floor(F.col(row) / size).cast("bigint")
    packed = df.groupBy(group.alias("batch")).agg(F.sort_array(F.collect_list(F.struct(row, *values))).alias("__r"))
    return packed.select("batch", *[F.col(f"__r.{c}").alias(c) for c in values])


def unfold_batch(df: DataFrame, size: int) -> DataFrame:
    """Inverse of ``fold_batch``."""
    values = [c for c in df.columns if c != "batch"]
    flat = df.select("batch", F.posexplode(F.arrays_zip(*values)).alias("__i", "__z"))
    return flat.select(
        (F.col("batch") * size + F.col("__i")).alias("row"), *[F.col(f"__z.{c}").alias(c) for c in values]
    )


def chunk_rows(df: DataFrame, chunks: int, row: str = "row") -> DataFrame:
    """Contiguous equal chunks; the row count must divide."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    uneven = F.raise_error(F.lit(f"row count does not divide into {chunks} chunks")).cast("bigint")
    chunk = F.floor(F.col(row) * chunks / total).cast("bigint")
    return df.withColumn("chunk", F.when(total % chunks != 0, uneven).otherwise(chunk))


def split_rows(df: DataFrame, size: int, row: str = "row") -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(row) / size).cast("bigint"))


def pad_rows(df: DataFrame, divisor: int, row: str = "row") -> DataFrame:
    """Repeat leading rows until the count divides; copies carry ``is_pad``."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    missing = F.pmod(F.lit(divisor) - F.pmod(total, F.lit(divisor)), F.lit(divisor))
    laps = F.ceil((missing - F.col(row)) / total).cast("int")
    copies = (
        df.where(F.col(row) < missing)
        .withColumn("__lap", F.explode(F.sequence(F.lit(1), laps)))
        .withColumn(row, F.col(row) + F.col("__lap") * total)
        .drop("__lap")
    )
    return df.withColumn("is_pad", F.lit(False)).unionByName(copies.withColumn("is_pad", F.lit(True)))


def unpad_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def concat_tables(frames: list[DataFrame]) -> DataFrame:
    return union_all(frames)


def append_generated(df: DataFrame, new: DataFrame, length: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows made by a generator appended after the overlong filter."""
    kept = new if length is None else new.where(F.coalesce(F.col(length), F.lit(limit + 1)) <= limit)
    return df.unionByName(kept, allowMissingColumns=True)


def stack_chosen_rejected(df: DataFrame) -> DataFrame:
    """prompt→chosen and prompt→rejected rows."""
    return df.select("prompt", F.explode(F.array("chosen", "rejected")).alias("response"))


def split_media_segments(c: Column) -> Column:
    """Text cut at image and video marks into typed segments, empties dropped."""
    parts = F.filter(F.split(c, "(?=<image>|<video>)|(?<=<image>|<video>)", -1), lambda p: p != "")

    def typed(p: Column) -> Column:
        kind = F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise(F.lit("text"))
        return F.struct(kind.alias("type"), F.when(kind == "text", p).alias("text"))

    return F.transform(parts, typed)


def flatten_metrics(df: DataFrame, keys: list[str], map_col: str = "metrics", sep: str = "/") -> DataFrame:
    """Map of metrics to rows with clean ``a/b/c`` names."""
    long = df.select(*keys, F.explode(map_col).alias("metric", "value"))
    joined = F.concat_ws(sep, *[F.col(k).cast("string") for k in keys], "metric")
    return long.select(clean_metric_name(joined).alias("metric"), "value")


def clean_metric_name(c: Column) -> Column:
    at = F.replace(c, F.lit("@"), F.lit("_at_"))
    return F.regexp_replace(F.regexp_replace(at, "/+", "/"), r"[^a-zA-Z0-9_./-]", "_")


def reorder(df: DataFrame, order: str) -> DataFrame:
    """Rows in the order of an index column; for the output edge only."""
    return df.orderBy(order)


def split_positional(df: DataFrame, fraction: float, row: str = "row") -> DataFrame:
    """``train`` for the first fraction of rows by position, ``test`` after."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    first = F.col(row) < F.floor(total * fraction)
    return df.withColumn("split", F.when(first, "train").otherwise(F.lit("test")))


def with_row_index(df: DataFrame, key: str) -> DataFrame:
    return row_index(df, key)
