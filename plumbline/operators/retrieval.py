"""Exact dense top-k and BM25 top-k over a corpus table.

Vectors meet in a grid: groups of queries by parts of the corpus, both of bounded
size, each cell a group of one shuffle. Texts are answered in blocks of bounded size,
each sent to the tasks while the corpus is scanned where it lies. A task cuts what it
reads into tiles of documents.
A bound per tile and query says whether a tile can still reach the k-th score, only
the k best of a tile are looked for, and k rows per query leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.operators.scale import union_all, written

#: Numbers of a group of query vectors, and of a part of the corpus.
GROUP_VALUES, PART_VALUES = 1 << 20, 1 << 20
#: Numbers of the query vectors multiplied with a tile at once, and query terms of a block of texts.
BLOCK_VALUES, BLOCK_TERMS = 1 << 20, 1 << 18
#: Documents of a tile.
TILE = 2048
#: Bounds are raised by this share of their size, so that rounding never skips a hit.
SLACK = 1e-9
TOPK = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
TOPK_DDL = "query_id BIGINT, doc_id BIGINT, score DOUBLE"


class Best:
    """The k best documents of each query so far, highest score first, then lowest id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of all documents ``ids`` (columns) for the queries ``at`` (rows)."""
        keep = min(self.k, scores.shape[1])
        edge = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
        row, column = np.nonzero(scores >= np.maximum(edge, self.least[at])[:, None])
        rows = np.concatenate([row, np.repeat(np.arange(len(at)), self.k)])
        values = np.concatenate([scores[row, column], self.scores[at].ravel()])
        names = np.concatenate([ids[column], self.ids[at].ravel()])
        order = np.lexsort((names, -values, rows))
        first = np.searchsorted(rows[order], np.arange(len(at)))
        taken = order[first[:, None] + np.arange(self.k)]
        self.scores[at], self.ids[at] = values[taken], names[taken]

    def batch(self, query_ids: np.ndarray) -> pa.RecordBatch:
        row, column = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids[row]), pa.array(self.ids[row, column]), pa.array(self.scores[row, column])], schema=TOPK
        )


def _ranked(parts: list[DataFrame], k: int) -> DataFrame:
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return union_all(parts).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def _in_blocks(queries: DataFrame, size: int, limit: int) -> Iterator[DataFrame]:
    """Blocks of queries by hash of the id, of about ``limit`` of their ``size`` numbers."""
    blocks = max(1, -(-size // limit))
    for i in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)


def _vectors(column: pa.Array, normalize: bool) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if not normalize:
        return flat
    norms = np.linalg.norm(flat, axis=1, keepdims=True)
    return flat / np.where(norms == 0, 1.0, norms)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, normalize: bool = True, block_values: int = BLOCK_VALUES, tile: int = TILE) -> DataFrame:
    """Exact inner-product search: ``(query_id, doc_id, score, rank)``.

    Inputs are ``(query_id, vector)`` and ``(doc_id, vector)``, vectors of one
    length; rows without a vector are left out. Scores are rounded to 12 places,
    ties go to the lower id. The vectors of a batch are put in order of their norm
    and cut into tiles; with centre c, radius r and largest norm m, no vector of a
    tile scores above ``min(|q| m, q·c + |q| r)`` for a query q, and a tile whose
    bound misses the k-th score is not multiplied. Groups of queries and parts of the
    corpus meet pairwise in tasks of their own; nothing but two sums reaches the driver.
    """
    asked = queries.select("query_id", "vector").where("vector is not null")
    held = corpus.select("doc_id", "vector").where("vector is not null")
    numbers = F.coalesce(F.sum(F.size("vector").cast("bigint")), F.lit(0))
    groups = max(1, -(-asked.agg(numbers).first()[0] // GROUP_VALUES))
    parts = max(1, -(-held.agg(numbers).first()[0] // PART_VALUES))
    # Each cell of the grid is a group of queries and a part of the corpus.
    group, part = _cell(groups, "query_id"), _cell(parts, "doc_id")
    asked = asked.select("*", group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    held = held.select("*", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    scan = _dense_cell(k, normalize, tile, block_values)
    met = asked.groupBy("group", "part").cogroup(held.groupBy("group", "part")).applyInArrow(scan, TOPK_DDL)
    return _ranked([met], k)


def _cell(cells: int, key: str) -> Column:
    return F.pmod(F.xxhash64(key, "vector"), F.lit(cells)).cast("int")


def _dense_cell(k: int, normalize: bool, tile: int, block_values: int) -> Callable:
    def cell(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if not queries.num_rows or not corpus.num_rows:
            return TOPK.empty_table()
        queries, corpus = queries.combine_chunks(), corpus.combine_chunks()
        matrix = _vectors(queries["vector"].chunk(0), normalize)
        asked = Asked((queries["query_id"].to_numpy(), matrix))
        scan = _dense_scan(asked, k, normalize, tile, max(1, block_values // max(1, matrix.shape[1])))
        return pa.Table.from_batches(scan(iter(corpus.to_batches())), schema=TOPK)

    return cell


class Asked(NamedTuple):
    """Ids and vectors of a group of queries."""

    value: tuple[np.ndarray, np.ndarray]


def _dense_scan(shared, k: int, normalize: bool, tile: int, block: int | None = None) -> Callable:
    """Best documents of all batches; at most ``block`` queries are multiplied with a tile at once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        lengths = np.linalg.norm(queries, axis=1)
        best = Best(len(ids), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, names = _vectors(batch.column("vector"), normalize), batch.column("doc_id").to_numpy()
            norms = np.linalg.norm(vectors, axis=1)
            order = np.argsort(-norms, kind="stable")
            for start in range(0, len(order), tile):
                at = order[start : start + tile]
                own = vectors[at]
                centre = own.mean(axis=0)
                radius = np.linalg.norm(own - centre, axis=1).max()
                bound = np.minimum(lengths * norms[at[0]], queries @ centre + lengths * radius)
                open_ = np.flatnonzero(bound + SLACK * (1 + np.abs(bound)) >= best.least)
                for first in range(0, len(open_), block or max(1, len(open_))):
                    some = open_[first : first + (block or len(open_))]
                    scores = np.round(queries[some] @ own.T, 12)
                    reach = scores.max(axis=1) >= best.least[some]
                    if reach.any():
                        best.offer(some[reach], scores[reach], names[at])
        yield best.batch(ids)

    return scan


def terms(text: Column) -> Column:
    """Plain analyser: lower case, runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def bm25_topk(
    queries: DataFrame, corpus: DataFrame, k: int, k1: float = 0.9, b: float = 0.4, block_terms: int = BLOCK_TERMS, tile: int = TILE
) -> DataFrame:
    """BM25 with ``idf = ln(1 + (N − df + ½)/(df + ½))``: id, score and rank.

    Inputs are ``(query_id, text)`` and ``(doc_id, text)``; a query term counts
    once. Only scores above 0 are returned, rounded to 9 places, ties by id. The
    corpus is read once, into a table of its documents with the numbers of the
    query terms in them. A tile of documents is a sparse matrix of term weights;
    the largest weight per term bounds what any of its documents can score.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    vocabulary = written(wanted.select("term").distinct().withColumn("no", F.monotonically_increasing_id()), "bm25-terms")
    tokens = corpus.select("doc_id", terms(F.col("text")).alias("ts")).select("doc_id", F.size("ts").alias("dl"), F.explode_outer("ts").alias("term"))
    found = tokens.join(vocabulary, "term", "left").groupBy("doc_id", "dl").agg(F.collect_list("no").alias("nos"))
    held = Observation()
    docs = written(found.observe(held, F.count(F.lit(1)).alias("n"), F.avg(F.greatest("dl", F.lit(0))).alias("average")), "bm25-docs")
    n, average = held.get["n"], held.get["average"] or 1.0
    freq = docs.select(F.explode(F.array_distinct("nos")).alias("no")).groupBy("no").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = wanted.join(vocabulary, "term").join(freq, "no").select("query_id", "no", idf.alias("idf"))
    size = Observation()
    asked = written(asked.observe(size, F.count(F.lit(1)).alias("n")), "bm25-queries")
    parts = [_bm25_block(block, docs, k, k1, b, average, tile) for block in _in_blocks(asked, size.get["n"], block_terms)]
    return _ranked(parts, k)


def _bm25_block(block: DataFrame, docs: DataFrame, k: int, k1: float, b: float, average: float, tile: int) -> DataFrame:
    held = block.orderBy("query_id", "no").toArrow()
    if not held.num_rows:
        return docs.sparkSession.createDataFrame([], TOPK_DDL)
    nos, at = np.unique(held["no"].to_numpy(), return_inverse=True)
    ids, starts = np.unique(held["query_id"].to_numpy(), return_index=True)
    shared = docs.sparkSession.sparkContext.broadcast((ids, starts, at, held["idf"].to_numpy(), nos))
    return docs.mapInArrow(_bm25_scan(shared, k, k1, b, average, tile), TOPK_DDL)


def _stretches(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, … of several stretches, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _bm25_scan(shared, k: int, k1: float, b: float, average: float, tile: int) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, at, idf, nos = shared.value
        ends = np.append(starts[1:], len(at))
        best = Best(len(ids), k)
        for batch in batches:
            for part in (batch.slice(i, tile) for i in range(0, batch.num_rows, tile)):
                rows, names = part.num_rows, part.column("doc_id").to_numpy()
                lists = part.column("nos")
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                place = np.minimum(np.searchsorted(nos, flat), len(nos) - 1)
                hit = nos[place] == flat
                # Term by document, how often: the tile as sorted postings.
                keys, times = np.unique(place[hit] * rows + np.repeat(np.arange(rows), sizes)[hit], return_counts=True)
                if not len(keys):
                    continue
                term, doc = keys // rows, keys % rows
                length = part.column("dl").to_numpy(zero_copy_only=False)[doc]
                weight = times * (k1 + 1) / (times + k1 * (1 - b + b * length / average))
                first = np.searchsorted(term, np.arange(len(nos) + 1))
                most = np.zeros(len(nos))
                some = np.flatnonzero(np.diff(first))
                most[some] = np.maximum.reduceat(weight, first[some])
                bound = np.add.reduceat(idf * most[at], starts)
                for q in np.flatnonzero((bound > 0) & (bound * (1 + SLACK) + SLACK >= best.least)).tolist():
                    own = at[starts[q] : ends[q]]
                    size = first[own + 1] - first[own]
                    where = _stretches(first[own], size)
                    scores = np.bincount(doc[where], weight[where] * np.repeat(idf[starts[q] : ends[q]], size), rows)
                    scores = np.round(scores, 9)
                    met = np.flatnonzero(scores > 0)
                    if len(met):
                        best.offer(np.array([q]), scores[met][None, :], names[met])
        yield best.batch(ids)

    return scan
