"""Table layouts shared by the readers, builders and operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)

RL_ROWS = T.StructType(
    [
        T.StructField("data_source", T.StringType()),
        T.StructField("prompt", MESSAGES),
        T.StructField("ability", T.StringType()),
        T.StructField(
            "reward_model",
            T.StructType(
                [
                    T.StructField("style", T.StringType()),
                    T.StructField("ground_truth", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField(
            "extra_info",
            T.StructType(
                [
                    T.StructField("split", T.StringType()),
                    T.StructField("index", T.LongType()),
                    T.StructField("question", T.StringType()),
                    T.StructField("answer", T.StringType()),
                    T.StructField("json", T.StringType()),
                ]
            ),
        ),
        T.StructField("agent_name", T.StringType()),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("ground_truth", T.ArrayType(T.StringType())),
        T.StructField("predicted_answer", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("abstained", T.BooleanType()),
        T.StructField("correct", T.BooleanType()),
        T.StructField("is_correct", T.BooleanType()),
        T.StructField("full_response", T.StringType()),
        T.StructField("risk_t", T.DoubleType()),
        T.StructField("grading_label", T.StringType()),
    ]
)

SAMPLES = "question_id BIGINT, sample_idx BIGINT, answer STRING, confidence DOUBLE, is_correct INT"
ROLLOUTS = (
    "uid BIGINT, seq_id BIGINT, data_source STRING, step BIGINT, score DOUBLE, acc DOUBLE, "
    "pred STRING, prompt_length BIGINT, response_length BIGINT, num_turns BIGINT"
)
TOKENS = (
    "uid BIGINT, seq_id BIGINT, pos BIGINT, token_id BIGINT, mask INT, reward DOUBLE, value DOUBLE, "
    "old_log_prob DOUBLE, log_prob DOUBLE, ref_log_prob DOUBLE, rollout_log_prob DOUBLE, entropy DOUBLE, "
    "advantage DOUBLE, `return` DOUBLE"
)
METRICS_LONG = "step BIGINT, data_source STRING, var STRING, metric STRING, value DOUBLE"
ROLLOUT_DUMP = "input STRING, output STRING, gts STRING, score DOUBLE, step BIGINT, acc DOUBLE, pred STRING"
GRADE_CACHE = "key STRING, label STRING, question STRING, reference STRING, model_answer STRING"
CLAIM_LABELS = "index BIGINT, claim_labels ARRAY<INT>"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail while the plan is being built, not in the middle of a job."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def conforms(df: DataFrame, schema: T.StructType) -> bool:
    """Same column names and types, nullability aside."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return all(have.get(f.name) == f.dataType.simpleString() for f in schema.fields)
