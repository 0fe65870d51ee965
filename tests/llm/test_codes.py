import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402

from plumbline.llm import codes, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def result(coded):
    return sorted((r["vec_id"], bytes(r["code"]).hex(), r["error"]) for r in coded.collect())


def test_query_matches_every_distance(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    want, sha = plain.vector_codes([(r["vec_id"], list(r["embedding"])) for r in rows])
    label = {r["vec_id"]: r["label"] for r in rows}
    sums = {}
    for i, _, error in want:
        sums[label[i]] = sums.get(label[i], 0) + error
    got = queries.QUERIES["op12_codes"](spark, SF)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted((i, c, e, sums[label[i]], sha) for i, c, e in want)


@pytest.mark.parametrize("spread", [0.02, 30.0])
def test_more_rounds_other_shapes_and_ties(spark, spread):
    own = random.Random(3)
    rows = [(i, [own.choice([-1, 0, 1, own.random()]) * spread for _ in range(12)], "x") for i in range(400)]
    rows += [(500 + i, rows[i % 7][1], None) for i in range(50)]  # repeated vectors
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(5)
    coded, books = codes.compress(frame, parts=4, entries=20, rounds=4)
    want, sha = plain.vector_codes([(i, v) for i, v, _ in rows], parts=4, entries=20, rounds=4)
    assert result(coded) == sorted(want) and codes.digest(books) == sha


def test_nulls_short_tables_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    good = [0.5, -0.25] * 16
    rows = [
        (None, good, 1, "a"), (1, None, 1, "b"), (2, [nan] + good[1:], 1, "c"), (3, [inf] + good[1:], 1, "d"), (4, [None] + good[1:], 1, "e"),
        (5, good, None, "f"), (5, good, None, "f"), (6, [1e300] + good[1:], 2, "g"), (7, good[:16], 2, "h"), (8, good[:15], 2, "i"), (9, [], 2, "j"),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string")
    coded, books = codes.compress(frame)
    assert books.shape == (16, 4, 2)
    got = sorted(((r["vec_id"], r["label"], bytes(r["code"]).hex(), r["error"]) for r in coded.collect()), key=str)
    assert [(r[0], r[1]) for r in got] == [(5, None), (5, None), (6, 2), (None, 1)]
    assert got[0][2] == got[3][2] == "00" * 16 and got[2][2] == "02" + "00" * 15 and all(r[3] == 0 for r in got)
    none, books = codes.compress(frame.where("false"))
    assert none.columns == ["vec_id", "label", "code", "error"] and none.count() == 0 and books.size == 0


def test_bounds_hold_and_spare_comparisons():
    own = np.random.default_rng(4)
    x = own.integers(-200, 200, (3000, 4))
    books = x[:64].copy()
    near, best, _ = codes.assign(x, None, books, None, 8)
    skipped = 0
    for step in range(5):
        moved = books + own.integers(-6, 7, books.shape) * (step < 4)
        gone = ((moved - books) ** 2).sum(axis=1)
        moves = codes.root(gone) + (codes.root(gone) ** 2 < gone)
        near, best, failed = codes.assign(x, near, moved, moves, 3 + step)
        books = moved
        every = ((x[:, None, :] - books) ** 2).sum(axis=2)
        assert (near.entry[:, 0] == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
        distance = np.sqrt(every)
        for z in range(near.entry.shape[1]):
            later = distance.copy()
            for y in range(z):
                known = near.entry[:, y] != codes.NO_ENTRY
                later[np.flatnonzero(known), near.entry[known, y]] = np.inf
            assert (near.low[:, z] <= later.min(axis=1)).all()
        skipped += (failed < 2).sum()
    assert skipped > 6000


def test_lists_adapt():
    assert codes._next_b(np.array([990, 9, 1, 0, 0, 0, 0, 0, 0]), 8, 64) == 2
    assert codes._next_b(np.array([500, 200, 100, 100, 90, 0, 0, 0, 10]), 8, 64) == 6
    assert codes._next_b(np.array([500, 0, 0, 0, 0, 0, 0, 0, 100]), 8, 64) == 16
    values = np.array([0, 1, 2, 3, 4, 2**52 - 1, 2**52, 2**60, 2**62 - 1])
    assert codes.root(values).tolist() == [0, 1, 1, 1, 2, 2**26 - 1, 2**26, 2**30, 2**31 - 1]
