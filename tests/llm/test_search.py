import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain  # noqa: E402

from plumbline.llm import queries, search  # noqa: E402
from plumbline.session import shared_folder  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()))


def test_query_matches_every_score(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.QUERIES["op11_search"](spark, SF)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert rows_of(got) == sorted(plain.ranked(docs, items))


@pytest.mark.parametrize("shard_bytes, block_bytes", [(12 << 20, 4 << 20), (300, 40)])
def test_odd_texts_ties_and_small_shards(spark, monkeypatch, shard_bytes, block_bytes):
    monkeypatch.setattr(search, "BLOCK_BYTES", block_bytes)
    own = random.Random(8)
    words = ["Alpha", "beta", "gamma9", "été", "日本", "x", "ß", "İ"] + [f"w{i}" for i in range(30)]
    texts = [own.choice([" ", ", ", "\n", "-", "\x00"]).join(own.choices(words, k=own.randint(0, 40))) for _ in range(150)]
    docs = [(i, t, 1, "s") for i, t in enumerate(texts)] + [(200 + i, texts[3], 1, "s") for i in range(60)]
    docs += [(300, None, 1, ""), (301, "", 1, ""), (302, " _!\t", 1, ""), (None, "alpha beta x", 1, ""), (7, "ALPHAİ", 1, ""), (400, "x " * 30000 + "beta", 1, "")]
    items = [(1, "alpha BETA x x"), (2, None), (3, ""), (4, "nothing here"), (5, "日本, été! w1 w2 w3"), (6, texts[3]), (6, "x"), (7, " ".join(words))]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score long, item_id string").repartition(4)
    asked = spark.createDataFrame(items, "item_id int, text string")
    path = shared_folder(spark, "index")
    search.build(frame, path, shard_bytes=shard_bytes)
    assert (spark.read.parquet(path).count() > 50) == (shard_bytes < 1000)
    assert rows_of(search.search(spark, path, asked)) == sorted(plain.ranked([d[:2] for d in docs], items))
    assert rows_of(search.search(spark, path, asked, k=3)) == sorted(plain.ranked([d[:2] for d in docs], items, 3))
    assert search.search(spark, path, asked.where("false")).count() == 0


def test_empty_index(spark):
    path = shared_folder(spark, "index")
    search.build(spark.createDataFrame([], "doc_id long, text string"), path)
    found = search.search(spark, path, spark.createDataFrame([("a", "b c")], "item_id string, text string"))
    assert found.count() == 0 and dict(found.dtypes)["item_id"] == "string"


def test_peaks_and_pruning():
    own = np.random.default_rng(2)
    rows, lists = 2000, []
    for size in (1, 2, 7, 900, 2000):
        lists.append((np.sort(own.choice(rows, size, replace=False)), own.integers(1, 900_000, size)))
    table = search.Lists.of(lists, rows)
    full = np.zeros((len(lists), rows), np.int64)
    for t, (docs, impact) in enumerate(lists):
        full[t, docs] = impact
    for t in range(len(lists)):
        low, high = table.spans(np.array([t]))
        for _ in range(200):
            a, b = np.sort(own.integers(low[0], high[0] + 1, 2))
            top, posting = table.peaks(np.array([[a]]), np.array([[b]]))
            want = [int(v) for v in lists[t][1][a - low[0] : b - low[0]]]
            assert top[0, 0] == max(want, default=0)
            assert not want or lists[t][1][posting[0, 0] - low[0]] == max(want)
    weights, ids = np.array([9000, 7000, 5000, 800, 100]), np.arange(rows) * 3 % 997
    looked, peaks = [], table.peaks
    table.peaks = lambda a, b: looked.append(a.shape[1]) or peaks(a, b)
    scores, names = search.best_first(table, np.arange(5), weights, ids, (np.empty(0, np.int64),) * 2, 10)
    total = (full * weights[:, None]).sum(axis=0)
    order = np.lexsort((ids, -total))[:10]
    assert scores.tolist() == total[order].tolist() and names.tolist() == ids[order].tolist()
    assert sum(looked) < rows / 2
