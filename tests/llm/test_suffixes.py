import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from plumbline.llm import queries, suffixes  # noqa: E402

SF = "/root/testdata/sf0.001"


def result(cleaned):
    rows = cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).collect()
    return sorted(map(tuple, rows), key=str)


def letters(n, seed, of="abcdefgh éß日🙂\0"):
    own = random.Random(seed)
    return "".join(own.choice(of) for _ in range(n))


SHARED, LINE = letters(400, 1), letters(90, 2)
ROWS = [
    (None, SHARED), (1, None), (2, ""), (3, SHARED[:150]), (4, SHARED[:150]), (5, letters(300, 3) + SHARED[50:390] + letters(100, 4)),
    (6, SHARED + letters(50, 5) + SHARED), (7, "ab" * 700), (8, "a" * 3000 + "b" + "a" * 500), (9, letters(800, 6)), (9, letters(800, 6)), (10, letters(800, 6)),
    (11, letters(800, 6) + "!"), (11, "other " + LINE), (12, "b" * 210 + "c"), (13, "z" * 199), (None, letters(500, 7)), (None, letters(500, 7)),
    (14, letters(60000, 8, "ab")), (15, letters(30000, 9) + letters(60000, 8, "ab")[100:1000]), (16, "a" * 199), (17, "c" + "a" * 201 + "\0" * 300),
]
ROWS += [(100 + i, letters(120 + i, 50 + i) + LINE + letters(100, 150 + i)) for i in range(40)]
ROWS += [(200 + i, letters(2000, 90)[: 300 + 40 * i] + str(i) * 3 + letters(2000, 90)[300 + 40 * i :]) for i in range(30)]


def test_query_matches_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op13_suffixes"](spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = plain.without_repeated_strings(docs)
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(r[2] for r in want) > 10_000


@pytest.mark.parametrize("width, split", [(200, 20_000), (200, 3), (40, 20_000), (61, 5)])
def test_odd_texts(spark, monkeypatch, width, split):
    monkeypatch.setattr(suffixes, "SPLIT_ROWS", split)
    frame = spark.createDataFrame([(*r, "x", True) for r in ROWS], "doc_id long, text string, n_spans string, whole boolean").repartition(5)
    assert result(suffixes.remove_repeats(frame, width)) == plain.without_repeated_strings(ROWS, width)
    assert suffixes.remove_repeats(frame.where("false"), width).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_order(seed):
    own = np.random.default_rng(seed)
    data = own.integers(0, [2, 3, 256, 2, 5, 256][seed], 3000).astype(np.uint8)
    data[500:1200] = data[1500:2200]
    data[2400:2700] = data[2300]
    if seed % 2:
        data[-300:] = 255 * (seed % 3 == 0)
    order, words = suffixes.suffix_array(data, 64)
    assert sorted(order.tolist()) == list(range(len(data)))
    text = data.tobytes() + bytes(64)
    heads = [text[i : i + 64] for i in order.tolist()]
    assert heads == sorted(heads)
    equal = suffixes.equal_neighbours(words, order, 64)
    assert equal.tolist() == [a == b for a, b in zip(heads, heads[1:])]


def test_only_smaller_suffixes_are_sorted_directly(monkeypatch):
    data, seen, keep = np.frombuffer(b"mississippi banana", np.uint8), [], suffixes.sorted_directly
    monkeypatch.setattr(suffixes, "sorted_directly", lambda w, s, n: seen.extend(s.tolist()) or keep(w, s, n))
    suffixes.suffix_array(data, 48)
    text = data.tobytes()
    assert seen == [i for i in range(len(text) - 1) if text[i:] < text[i + 1 :]]
