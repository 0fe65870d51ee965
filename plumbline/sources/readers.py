"""Readers for question sets, results, rollout dumps and caches."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from plumbline import schemas
from plumbline.operators.calibration import collapse, moments_from_counts
from plumbline.operators.reports import DIRECTIONS
from plumbline.operators.sampling import sample_n
from plumbline.operators.scale import union_all


def read_rl_parquet(
    spark: SparkSession, paths: list[str] | str, max_samples: int = -1, row_id: str | None = None, shuffle: bool = False, seed: int = 0
) -> DataFrame:
    """One or many parquet files; optionally the first or n random rows."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if max_samples < 0:
        return df
    if row_id is None:
        raise ValueError("a bounded sample needs a row id to order by")
    return sample_n(df, max_samples, row_id, shuffle, seed)


def read_columns(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """Only the needed columns reach the scan."""
    return spark.read.parquet(path).select(*cols)


def read_eval_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """jsonl, json (list, object or ``{"data": […]}``) or parquet by suffix."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.endswith(".jsonl"):
        return reader.json(path)
    if path.endswith(".json"):
        if schema is not None:
            return reader.json(path, multiLine=True)
        whole = spark.read.json(path, multiLine=True)
        if "data" in whole.columns and isinstance(whole.schema["data"].dataType, T.ArrayType):
            return whole.select(F.explode("data").alias("d")).select("d.*")
        return whole
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def read_tagged_union(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several sets with their tag in ``_source_dataset``; missing ones skipped."""
    frames = []
    for tag, path in paths.items():
        try:
            frames.append(read_eval_dataset(spark, path).withColumn("_source_dataset", F.lit(tag)))
        except AnalysisException as error:
            warnings.warn(f"skipping {tag}: {error.getCondition()}", stacklevel=2)
    if not frames:
        raise FileNotFoundError(f"none of the sets exist: {sorted(paths)}")
    return union_all(frames)


RESULT_ROW = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("predicted_answer", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("abstained", T.BooleanType()),
        T.StructField("correct", T.BooleanType()),
        T.StructField("is_correct", T.BooleanType()),
        T.StructField("risk_t", T.DoubleType()),
    ]
)


def _folder(pattern: str, group: int) -> Column:
    """Part of the path of a row's file, as it is named on disk; a plus sign is no blank."""
    return F.url_decode(F.replace(F.regexp_extract(F.input_file_name(), pattern, group), F.lit("+"), F.lit("%2B")))


def read_result_shards(spark: SparkSession, root: str, pattern: str = "shard_*", lines: bool = False) -> DataFrame:
    """Rows of ``shard_*/results.json`` with their shard.

    ``results.json`` is one document, or with ``lines`` a file or folder of
    documents, one per line. ``risk_threshold`` comes from the first shard that
    has one, else 0.5. No rows at all is an error.
    """
    layout = T.StructType(
        [
            T.StructField("results", T.ArrayType(RESULT_ROW)),
            T.StructField("metrics", T.StructType([T.StructField("risk_threshold", T.DoubleType())])),
        ]
    )
    files = spark.read.schema(layout).json(f"{root}/{pattern}/results.json", multiLine=not lines)
    files = files.withColumn("shard", _folder(r"([^/]+)/results\.json(?:/[^/]*)?$", 1))
    stated = files.where(F.col("metrics.risk_threshold").isNotNull())
    threshold = stated.agg(F.min_by(F.col("metrics.risk_threshold"), F.col("shard")).alias("t")).scalar()
    rows = files.select("shard", F.explode("results").alias("r")).select("shard", "r.*")
    if rows.isEmpty():
        raise ValueError(f"no result rows under {root}/{pattern}")
    return rows.withColumn("risk_threshold", F.coalesce(threshold, F.lit(0.5)))


def merge_shards(spark: SparkSession, root: str, pattern: str = "shard_*", risk_threshold: float | None = None, lines: bool = False) -> DataFrame:
    """Metrics over the rows of all shards together, with the threshold used and the number of shards.

    A threshold given wins over the one the shards state.
    """
    rows = read_result_shards(spark, root, pattern, lines)
    right = F.coalesce("correct", "is_correct", F.lit(False)).cast("int")
    counts = collapse(rows.select("confidence", right.alias("correct")), [])
    told = rows.agg(F.max("risk_threshold").alias("t"), F.count_distinct("shard").alias("n")).first()
    threshold = told["t"] if risk_threshold is None else risk_threshold
    merged = moments_from_counts(counts, [], threshold)
    return merged.select("*", F.lit(float(threshold)).alias("risk_threshold"), F.lit(told["n"]).cast("bigint").alias("n_shards"))


def read_result_tree(spark: SparkSession, root: str, file: str = "results.json", lines: bool = False) -> DataFrame:
    """One row per ``method/dataset/results.json``; missing metrics are 0.

    Folders may also be named ``method=…/dataset=…``, and ``file`` may be a
    pattern; with ``lines`` a file holds a document per line.
    """
    names = [*DIRECTIONS, "n_samples"]
    metrics = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    layout = T.StructType([T.StructField("metrics", metrics), T.StructField("metrics_confidence", metrics)])
    files = spark.read.schema(layout).json(f"{root}/*/*/{file}", multiLine=not lines)
    where = r"/(?:method=)?([^/]+)/(?:dataset=)?([^/]+)/[^/]+$"
    values = [
        F.coalesce(
            F.when(F.col("metrics").isNotNull(), F.col(f"metrics.{n}")).otherwise(F.col(f"metrics_confidence.{n}")),
            F.lit(0.0),
        ).alias(n)
        for n in names
    ]
    return files.select(
        _folder(where, 1).alias("method"),
        _folder(where, 2).alias("dataset"),
        *values,
    )


def read_rollout_dumps(
    spark: SparkSession, path: str, schema: str = schemas.ROLLOUT_DUMP, mask: str | None = None
) -> DataFrame:
    """``{step}.jsonl`` dumps with step and row index, text optionally masked.

    The index counts rows inside each file. A dump holds one step's samples, so
    its window is one file long.
    """
    rows = spark.read.schema(schema).json(path)
    rows = rows.withColumn("__file", F.input_file_name()).withColumn("__at", F.monotonically_increasing_id())
    if mask is not None:
        for field in rows.schema.fields:
            if isinstance(field.dataType, T.StringType) and not field.name.startswith("__"):
                rows = rows.withColumn(field.name, F.regexp_replace(field.name, mask, "*"))
    step = F.regexp_extract("__file", r"/(\d+)\.jsonl?$", 1).try_cast("bigint")
    index = F.row_number().over(W.partitionBy("__file").orderBy("__at")) - 1
    return rows.withColumn("step", F.coalesce(step, F.col("step"))).withColumn("row", index).drop("__file", "__at")


def read_label_cache(spark: SparkSession, path: str) -> DataFrame:
    """Last written label per key of a grade cache in jsonl."""
    lines = spark.read.schema(schemas.GRADE_CACHE).json(path)
    order = F.struct(F.input_file_name(), F.monotonically_increasing_id())
    usable = lines.withColumn("__o", order).where((F.length("key") > 0) & (F.length("label") > 0))
    return usable.groupBy("key").agg(F.max_by("label", "__o").alias("label"))


def read_claim_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CLAIM_LABELS).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Passages ``{id, contents}`` with the title on the first line."""
    lines = spark.read.schema("id STRING, contents STRING").json(path)
    return lines.select(F.col("id").alias("doc_id"), "contents")
