"""Streams against the same rows as a table."""

import json
import os

from pyspark.sql import functions as F

from plumbline.operators.validation import subset_sizes
from plumbline.streaming import jobs

SCHEMA = "ts TIMESTAMP, confidence DOUBLE, correct INT"


def write(folder, name, rows):
    with open(os.path.join(folder, name), "w") as out:
        for ts, c, y in rows:
            out.write(json.dumps({"ts": ts, "confidence": c, "correct": y}) + "\n")


def test_late_rows_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    os.makedirs(source)
    write(source, "1.json", [("2024-01-01T00:05:00Z", 0.9, 1), ("2024-01-01T00:01:00Z", 0.4, 0)])
    write(source, "2.json", [("2024-01-01T05:00:00Z", 0.5, 1)])
    write(source, "3.json", [("2024-01-01T06:00:00Z", 0.5, 1)])
    write(source, "4.json", [("2024-01-01T00:02:00Z", 0.1, 1), ("2024-01-01T09:00:00Z", 0.5, 1)])
    for i, name in enumerate(["1.json", "2.json", "3.json", "4.json"]):
        os.utime(os.path.join(source, name), (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source)
    out = jobs.run_to_table(jobs.stream_calibration(stream), "late")
    first = out.orderBy("start").first()
    assert first.n_samples == 2 and abs(first.brier - (0.01 + 0.16) / 2) < 1e-12
    table = jobs.stream_calibration(spark.read.schema(SCHEMA).json(source).where(F.col("confidence") != 0.1))
    closed = {(r.start, r.n_samples) for r in out.collect()}
    assert closed <= {(r.start, r.n_samples) for r in table.collect()}


def test_buckets_are_carried_through(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' as ts, id / 1000D as confidence, cast(id % 3 = 0 as int) as correct from range(1000)")
    found = jobs.stream_reliability(rows, buckets=1000)
    counts = []
    jobs_auc, keep = jobs.auc_from_counts, lambda c, by: counts.append(c) or jobs_auc(c, by)
    jobs.auc_from_counts = keep
    try:
        assert jobs.metrics_from_buckets(found, ["start"], buckets=1000).count() == 1
    finally:
        jobs.auc_from_counts = jobs_auc
    assert counts[0].agg(F.max("c")).first()[0] <= 1.0


def test_sizes_beyond_int(one):
    assert one(subset_sizes(F.lit(5_000_000_000)))[-3:] == [1 << 31, 1 << 32, 5_000_000_000]


def rows_of(spark, folder, rows, order, per_trigger, job, schema):
    """What a job gives when the rows come in files of three, taken in an order."""
    os.makedirs(folder)
    files = [rows[i : i + 3] for i in range(0, len(rows), 3)]
    for at, i in enumerate([*order(len(files)), len(files)]):
        name = os.path.join(folder, f"{i}.json")
        with open(name, "w") as out:
            last = {**rows[-1], "ts": "2024-01-09T00:00:00Z", "run": "end", "uid": -1, "seq_id": -1}
            out.write("\n".join(json.dumps(r) for r in (files[i] if i < len(files) else [last])))
        os.utime(name, (1_700_000_000 + at, 1_700_000_000 + at))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(str(folder))
    return sorted(map(tuple, jobs.run_to_table(job(stream), "swapped").collect()))


def test_kl_does_not_depend_on_files_and_triggers(spark, tmp_path):
    rows = [{"run": f"r{i % 2}", "ts": f"2024-01-01T00:{i:02d}:00Z", "step": 3 * i if i != 7 else 1, "kl": (i * 37 % 11) / 100, "n_steps": 8} for i in range(18)]
    schema = "run STRING, ts TIMESTAMP, step BIGINT, kl DOUBLE, n_steps BIGINT"
    job = lambda s: jobs.stream_kl(s, 0.2, 0.05, 100.0, watermark="1 hour")
    got = [rows_of(spark, tmp_path / str(i), rows, o, n, job, schema) for i, (o, n) in enumerate([(range, 1), (lambda k: reversed(range(k)), 2), (range, 100)])]
    assert got[0] == got[1] == got[2] and len(got[0]) == 17
    beta, want = {}, []
    for r in rows:
        if r["step"] != 1:
            beta[r["run"]] = beta.get(r["run"], 0.2) * (1 + max(-0.2, min(0.2, r["kl"] / 0.05 - 1)) * 8 / 100)
            want.append((r["run"], r["step"], beta[r["run"]]))
    assert [(a, b) for a, b, _, _ in got[0]] == sorted((a, b) for a, b, _ in want)
    assert {(a, b): round(d, 12) for a, b, _, d in got[0]} == {(a, b): round(c, 12) for a, b, c in want}


def test_prompts_are_decided_once_by_their_first_samples(spark, tmp_path):
    rows = [{"uid": i % 3, "ts": f"2024-01-01T00:{i:02d}:00Z", "seq_id": i, "metric": float(i % 4) if i % 3 else 1.0} for i in range(24)]
    schema = "uid BIGINT, ts TIMESTAMP, seq_id BIGINT, metric DOUBLE"
    job = lambda s: jobs.stream_filter_groups(s, 4, watermark="1 hour")
    got = [rows_of(spark, tmp_path / str(i), rows, o, n, job, schema) for i, (o, n) in enumerate([(range, 1), (lambda k: reversed(range(k)), 3)])]
    want = []
    for uid in (1, 2):
        first = [r["metric"] for r in rows if r["uid"] == uid][:4]
        want.append((uid, 4, sum(first) / 4, max(first) - min(first)))
    assert got[0] == got[1] == want


def test_prompts_share_buckets(spark, tmp_path):
    """Many prompts in one bucket, a NULL and a large one among them."""
    uids = [None, 2**60 + 1, 2**60 + 2, 5]
    rows = [{"uid": uids[i % 4], "ts": f"2024-01-01T00:{i:02d}:00Z", "seq_id": i, "metric": float(i // 4 % 3)} for i in range(23)]
    schema = "uid BIGINT, ts TIMESTAMP, seq_id BIGINT, metric DOUBLE"
    want = sorted((u or -7, 5, 4 / 5, 2.0) for u in uids)
    for buckets in (1, 1000):
        job = lambda s: jobs.stream_filter_groups(s, 5, watermark="1 hour", buckets=buckets).na.fill(-7, ["uid"])  # noqa: B023, E731
        assert rows_of(spark, tmp_path / str(buckets), rows, range, 2, job, schema) == want
