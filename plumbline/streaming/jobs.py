"""The same metrics over a growing folder of rollout dumps."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline import schemas
from plumbline.operators.calibration import auc_from_counts
from plumbline.session import shared_folder

BUCKETS = 100
NLL_EPS = 1e-10


def stream_rollouts(
    spark: SparkSession, path: str, schema: str = schemas.ROLLOUT_DUMP, files_per_trigger: int = 100
) -> DataFrame:
    """New dump files as a stream; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _sums(c: Column, y: Column) -> list[Column]:
    p = F.greatest(F.lit(NLL_EPS), F.least(F.lit(1 - NLL_EPS), c))
    return [
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(c).alias("avg_confidence"),
        F.avg(y).alias("predictive_accuracy"),
        F.avg(F.pow(c - y, F.lit(2.0))).alias("brier"),
        F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("nll"),
    ]


def stream_calibration(
    stream: DataFrame,
    window: str = "1 hour",
    slide: str | None = None,
    watermark: str = "10 minutes",
    by: list[str] | None = None,
    session_gap: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Calibration sums per event-time window; works on batch input too.

    Tumbling, sliding (``slide``) or session windows. Only mergeable sums are
    kept as state; rows later than the watermark are dropped.
    """
    base = stream.withWatermark(ts, watermark) if stream.isStreaming else stream
    span = F.session_window(ts, session_gap) if session_gap else F.window(ts, window, slide or window)
    c, y = F.col("confidence").cast("double"), F.col("correct").cast("double")
    out = base.groupBy(span.alias("w"), *(by or [])).agg(*_sums(c, y))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), *out.columns[1 + len(by or []) :])


def stream_reliability(
    stream: DataFrame, window: str = "1 hour", watermark: str = "10 minutes", ts: str = "ts", buckets: int = BUCKETS
) -> DataFrame:
    """Confidence bucket counts per window: the input of ECE, AUC and SNR.

    At most ``buckets + 1`` rows of state per window.
    """
    base = stream.withWatermark(ts, watermark) if stream.isStreaming else stream
    bucket = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))) * buckets)
    return base.groupBy(F.window(ts, window).alias("w"), bucket.cast("bigint").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("correct").cast("bigint")).alias("pos"),
        F.sum("confidence").alias("conf"),
    ).select(F.col("w.start").alias("start"), "bucket", "n", "pos", "conf")


def metrics_from_buckets(rows: DataFrame, by: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Bucketed ECE and AUC of finished windows (``foreachBatch`` side).

    ``buckets`` is what ``stream_reliability`` was given. Confidences within a
    bucket count as one, so both are approximate.
    """
    counts = rows.select(*by, (F.col("bucket") / F.lit(float(buckets))).alias("c"), "n", "pos", "conf")
    gap = F.abs(F.col("pos") - F.col("conf"))
    ece = counts.groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))
    return ece.join(auc_from_counts(counts, by), by)


KL_OUT = "run STRING, step BIGINT, kl DOUBLE, beta DOUBLE"


def _arrived(batches: Iterator[pd.DataFrame], held: str | None) -> list[tuple]:
    """Rows held back so far and new ones, in order of event time, then of the other columns."""
    rows = [tuple(r) for r in json.loads(held or "[]")]
    for batch in batches:
        rows += [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in batch.itertuples(index=False, name=None)]
    return sorted(rows)


def _wait(state: GroupState, held: list[tuple], idle_minutes: int | None) -> None:
    """Wake up when the watermark passes the first row held, or, if none is, when the key has been idle in event time."""
    now = state.getCurrentWatermarkMs()
    if held:
        state.setTimeoutTimestamp(max(now, held[0][0]) + 1)
    elif idle_minutes is not None:
        state.setTimeoutTimestamp(now + idle_minutes * 60_000 + 1)


def stream_kl(
    stream: DataFrame,
    beta0: float,
    target: float,
    horizon: float,
    ts: str = "ts",
    watermark: str = "10 minutes",
    idle_minutes: int | None = None,
) -> DataFrame:
    """Adaptive divergence coefficient per run, carried across triggers.

    Input ``run, step, kl, n_steps`` and an event time. Rows are held until the
    watermark passes them and then taken in order of time, then step, so the result
    does not depend on files and triggers; a step at or before the last one taken
    is ignored. State is the coefficient, the last step and the rows held, which
    the watermark bounds. Runs are forgotten after ``idle_minutes`` of event time,
    if given.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        beta, last, held = state.get if state.exists else (float(beta0), -1, None)
        rows = _arrived(batches, held)
        if state.hasTimedOut and not rows:
            state.remove()
            return
        now, out = state.getCurrentWatermarkMs(), []
        for at, step, kl, n_steps in rows:
            if at > now or step <= last:
                continue
            error = min(0.2, max(-0.2, kl / target - 1.0))
            beta *= 1.0 + error * n_steps / horizon
            last = int(step)
            out.append((key[0], last, float(kl), beta))
        held = [r for r in rows if r[0] > now]
        state.update((beta, last, json.dumps(held)))
        _wait(state, held, idle_minutes)
        yield pd.DataFrame(out, columns=["run", "step", "kl", "beta"])

    timed = stream.withWatermark(ts, watermark).select("run", ts, F.unix_millis(ts).alias("__at"), "step", "kl", "n_steps")
    return _timed(timed, "run", ts, update, KL_OUT, "beta DOUBLE, last BIGINT, held STRING")


def _timed(stream: DataFrame, key: str, ts: str, update, out: str, state: str) -> DataFrame:
    """Stateful step whose timers run on event time; ``update`` gets the columns after the first two."""

    def on_values(k: tuple, batches: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        return update(k, (b.drop(columns=[key, ts]) for b in batches), s)

    return stream.groupBy(key).applyInPandasWithState(on_values, out, state, "append", GroupStateTimeout.EventTimeTimeout)


#: A call costs milliseconds however few rows it gets, so a call handles the prompts of a bucket.
BUCKETS_OF_PROMPTS = 1024
GROUP_OUT = "uid BIGINT, n BIGINT, mean DOUBLE, spread DOUBLE"


def stream_filter_groups(
    stream: DataFrame, n: int, ts: str = "ts", watermark: str = "10 minutes", idle_minutes: int = 7 * 24 * 60, buckets: int = BUCKETS_OF_PROMPTS
) -> DataFrame:
    """Prompts whose n samples are in and whose metric varies, each once.

    Input ``uid, seq_id, metric`` and an event time. Samples are held until the
    watermark passes them and counted in order of time, then id: the first ``n``
    decide, later ones are ignored, and so are repeats of a sample within the
    watermark. A prompt decided stays known, one short of samples stays open, until
    no sample came for ``idle_minutes`` of event time. Prompts are handled by bucket
    of their hash; a bucket's state holds what each of its prompts has, and when the
    watermark must wake it.
    """

    def decide(uid: str | None, entry: list, rows: list[tuple], now: int) -> tuple | None:
        before, total, lo, hi = entry[:4]
        seen = before
        for at, _, metric in sorted(rows):
            if at <= now and seen < n:
                seen, total, lo, hi = seen + 1, total + metric, min(lo, metric), max(hi, metric)
        held = sorted(r for r in rows if r[0] > now) if seen < n else []
        wake = max(now, held[0][0]) if held else now + idle_minutes * 60_000
        entry[:] = [seen, total, lo, hi, held, wake + 1]
        if before < n <= seen and (hi > lo or n == 1):
            return (None if uid is None else int(uid), seen, total / seen, hi - lo)
        return None

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prompts = dict(json.loads(state.get[0])) if state.exists else {}
        now, arrived, out = state.getCurrentWatermarkMs(), {}, []
        for batch in batches:
            for uid, *row in zip(*[batch[c].tolist() for c in ("uid", "__at", "seq_id", "metric")]):
                arrived.setdefault(uid, []).append(tuple(row))
        for uid in [u for u, entry in prompts.items() if entry[5] < now and u not in arrived]:
            if prompts[uid][4]:
                arrived[uid] = []
            else:
                del prompts[uid]
        for uid, rows in arrived.items():
            entry = prompts.setdefault(uid, [0, 0.0, float("inf"), float("-inf"), [], 0])
            found = decide(uid, entry, [*map(tuple, entry[4]), *rows], now)
            out += [found] if found else []
        if prompts:
            state.update((json.dumps(list(prompts.items())),))
            state.setTimeoutTimestamp(max(now, min(entry[5] for entry in prompts.values())))
        else:
            state.remove()
        decided = pd.DataFrame([x[1:] for x in out], columns=["n", "mean", "spread"])
        decided.insert(0, "uid", pd.array([x[0] for x in out], dtype="Int64"))
        yield decided

    base = stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["seq_id"])
    metric = F.col("metric").cast("double").alias("metric")
    bucket = F.pmod(F.xxhash64("uid"), F.lit(buckets)).alias("__bucket")
    timed = base.select(bucket, ts, F.col("uid").cast("string").alias("uid"), F.unix_millis(ts).alias("__at"), "seq_id", metric)
    return _timed(timed, "__bucket", ts, update, GROUP_OUT, "prompts STRING")


IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_to_table(stream: DataFrame, name: str, idle_batches: bool = True) -> DataFrame:
    """Drain what a source holds now into a parquet table and read it back.

    Table, progress and state live in a fresh folder below the shared checkpoint
    folder of the session, so a lost executor can be replaced at any time.
    Batches without data close windows at the end; jobs with processing-time
    timeouts ask for them without end and must be drained without.
    """
    spark = stream.sparkSession
    root = shared_folder(spark, f"stream-{name}")
    before = spark.conf.get(IDLE_BATCHES)
    spark.conf.set(IDLE_BATCHES, str(idle_batches).lower())
    try:
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{root}/progress")
            .trigger(availableNow=True)
            .start(f"{root}/table")
        )
    finally:
        spark.conf.set(IDLE_BATCHES, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")
