"""Ranked lexical search over intervals of documents.

The index is a table of shards: some megabytes of documents with a posting list for
every term. To answer items, a task turns the lists of their terms into impacts and
lays a sparse table over them, so the largest impact of any interval of documents is
the greater of two entries. Search is best first: the answers of an item's terms,
summed, bound all documents of an interval; the intervals with the largest bounds
are split at the document where the strongest term peaks, that document is scored
exactly, and an interval that cannot reach the ``k``-th score is never opened. A task
carries the ``k`` best from shard to shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import batches_of, slices, split_words, stored

TOP = 50
#: Bytes of text in a shard, about; a longer document is a shard by itself.
SHARD_BYTES = 12 << 20
#: Bytes of items that are answered in one pass over the index.
BLOCK_BYTES = 4 << 20
#: Intervals opened at a time.
OPENED = 48
#: Terms are runs of ASCII letters, digits and everything beyond ASCII; A-Z count as a-z.
AS_TERM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

INDEX = "n_docs bigint, n_terms bigint, ids binary, known binary, lengths binary, words binary, ends binary, places binary, times binary, widths array<int>"


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Terms of every text: offsets per text, term numbers, distinct terms."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = texts.take(pa.array(range(len(texts)), pa.int64()))
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(AS_TERM))
    return split_words(pa.LargeStringArray.from_buffers(len(texts), offsets, plain))


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes."""
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32)


def _shard(ids: pa.Array, texts: pa.Array) -> dict:
    offsets, codes, words = _terms(texts)
    lengths = np.diff(offsets)
    rows = len(lengths)
    owner = np.repeat(np.arange(rows), lengths)
    pairs, times = np.unique(codes * rows + owner, return_counts=True)
    ends = np.cumsum(np.bincount(pairs // rows if rows else pairs, minlength=len(words)))
    places, times = _narrow(pairs % rows if rows else pairs), _narrow(times)
    return {
        "n_docs": int((lengths > 0).sum()),
        "n_terms": int(lengths.sum()),
        "ids": pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
        "known": np.asarray(ids.is_valid()).astype(np.uint8).tobytes(),
        "lengths": lengths.astype(np.int64).tobytes(),
        "words": " ".join(words).encode(),
        "ends": ends.astype(np.int64).tobytes(),
        "places": places.tobytes(),
        "times": times.tobytes(),
        "widths": [places.dtype.itemsize, times.dtype.itemsize],
    }


def _shards(limit: int):
    kinds = pa.schema(
        [("n_docs", pa.int64()), ("n_terms", pa.int64())]
        + [(c, pa.binary()) for c in ("ids", "known", "lengths", "words", "ends", "places", "times")]
        + [("widths", pa.list_(pa.int32()))]
    )

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        return pa.RecordBatch.from_pylist([_shard(whole["doc_id"].combine_chunks(), whole["text"].combine_chunks())], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", limit):
                own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held and size + own > limit:
                    yield packed(held)
                    held, size = [], 0
                held.append(part)
                size += own
        if held:
            yield packed(held)

    return run


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Write the index of ``docs`` to ``path``, a folder every executor reaches; other columns are not read."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with batches_of(docs.sparkSession, 1024):
        given.mapInArrow(_shards(shard_bytes), INDEX).write.mode("append").parquet(path)


@dataclass
class Lists:
    """Posting lists of some terms in one shard, one after the other, and their sparse table."""

    keys: np.ndarray
    places: np.ndarray
    tops: np.ndarray
    rows: int

    @classmethod
    def of(cls, lists: list[tuple[np.ndarray, np.ndarray]], rows: int) -> Lists:
        sizes = [len(places) for places, _ in lists]
        places = np.concatenate([p for p, _ in lists]) if lists else np.empty(0, np.int64)
        impacts = np.concatenate([i for _, i in lists]) if lists else np.empty(0, np.int64)
        keys = np.repeat(np.arange(len(lists)), sizes) * rows + places
        # An entry holds an impact and, below it, the posting it belongs to.
        tops = np.empty((max(sizes, default=1).bit_length() or 1, len(keys)), np.int64)
        tops[0] = impacts << 32 | np.arange(len(impacts))
        for depth in range(1, len(tops)):
            width = 1 << (depth - 1)
            tops[depth] = tops[depth - 1]
            np.maximum(tops[depth - 1][:-width], tops[depth - 1][width:], out=tops[depth][:-width])
        return cls(keys, places, tops, rows)

    def spans(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the whole lists of the terms start and stop."""
        return np.searchsorted(self.keys, terms * self.rows), np.searchsorted(self.keys, (terms + 1) * self.rows)

    def peaks(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest impact in every stretch of a list, 0 if it is empty, and its posting."""
        size = stop - start
        depth = np.maximum(np.frexp(size.astype(np.float64))[1] - 1, 0)
        width, flat = self.tops.shape[1], self.tops.ravel()
        first = depth * width + np.minimum(start, width - 1)
        found = np.maximum(flat[first], flat[np.maximum(depth * width + stop - (1 << depth), 0)])
        found[size <= 0] = 0
        return found >> 32, found & 0xFFFFFFFF


def best_first(
    lists: Lists, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int
) -> tuple[np.ndarray, np.ndarray]:
    """``best`` (scores and ids, highest score first, then lowest id) after the documents of a shard, at most ``k``.

    An interval of documents is held as the stretch it has of each term's list.
    """
    scores, names = best
    weights, terms = weights[:, None], terms[:, None] * lists.rows
    start, stop = (x[:, None] for x in lists.spans(terms[:, 0] // lists.rows))
    bound, split = np.empty(0, np.int64), np.empty(0, np.int64)
    open_start, open_stop = start[:, :0], stop[:, :0]
    while True:
        # Bounds of the new intervals; those that cannot reach the k-th score go.
        least = int(scores[k - 1]) if len(scores) >= k else 1
        impact, posting = lists.peaks(start, stop)
        impact = impact * weights
        total = impact.sum(axis=0)
        new, old = np.flatnonzero(total >= least), np.flatnonzero(bound >= least)
        strongest = posting[impact[:, new].argmax(axis=0), new]
        bound, split = np.append(bound[old], total[new]), np.append(split[old], lists.places[strongest])
        if not len(bound):
            return scores, names
        open_start, open_stop = np.hstack([open_start[:, old], start[:, new]]), np.hstack([open_stop[:, old], stop[:, new]])
        order = np.argpartition(-bound, OPENED) if len(bound) > OPENED else np.arange(len(bound))
        now, later = order[:OPENED], order[OPENED:]
        # One look-up of the split document gives its score and cuts every list in two.
        at, left, right = split[now], open_start[:, now], open_stop[:, now]
        wanted = terms + at
        cut = np.searchsorted(lists.keys, wanted)
        held = np.minimum(cut, len(lists.keys) - 1)
        hit = lists.keys[held] == wanted
        exact = (np.where(hit, lists.tops[0][held] >> 32, 0) * weights).sum(axis=0)
        good = exact >= least
        if good.any():
            scores, names = np.append(scores, exact[good]), np.append(names, ids[at[good]])
            first = np.lexsort((names, -scores))[:k]
            scores, names = scores[first], names[first]
        start, stop = np.hstack([left, cut + hit]), np.hstack([cut, right])
        bound, split, open_start, open_stop = bound[later], split[later], open_start[:, later], open_stop[:, later]


def _words(blob: bytes) -> pa.Array:
    return pa.array(blob.decode().split(" ") if blob else [], pa.string())


def _counts(terms: list[str]):
    """Documents of each shard that hold the given terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.string())
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for words, ends in zip(batch.column("words").to_pylist(), batch.column("ends").to_pylist()):
                at = pc.index_in(wanted, value_set=_words(words))
                have = np.flatnonzero(np.asarray(at.is_valid()))
                total[have] += np.diff(np.frombuffer(ends, np.int64), prepend=0)[pc.drop_null(at).to_numpy()]
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], names=["term", "df"])

    return run


def _answers(terms: list[str], weights: np.ndarray, items: list[np.ndarray], n: int, length: int, k: int):
    """The ``k`` best documents of each item in the shards of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(terms, pa.string())
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(items)
        for batch in batches:
            for shard in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                sizes = np.frombuffer(shard["lengths"], np.int64)
                ids, known = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["known"], np.uint8)
                ends = np.frombuffer(shard["ends"], np.int64)
                kinds = [{1: np.uint8, 2: np.uint16, 4: np.uint32}[w] for w in shard["widths"]]
                places, times = np.frombuffer(shard["places"], kinds[0]), np.frombuffer(shard["times"], kinds[1])
                norm = 20 * (50 + (50 * n * sizes) // max(1, length))
                at = pc.index_in(wanted, value_set=_words(shard["words"])).to_pylist()
                lists, number = [], np.full(len(terms), -1)
                for term, place in enumerate(at):
                    if place is None or weights[term] <= 0:
                        continue
                    own = slice(ends[place - 1] if place else 0, ends[place])
                    docs, tf = places[own].astype(np.int64), times[own].astype(np.int64)
                    number[term] = len(lists)
                    lists.append((docs, known[docs] * (1_000_000_000 * tf // (1000 * tf + norm[docs]))))
                table = Lists.of(lists, len(sizes))
                for i, own in enumerate(items):
                    have = own[number[own] >= 0]
                    if len(have):
                        best[i] = best_first(table, number[have], weights[have], ids, best[i], k)
        rows = [len(scores) for scores, _ in best]
        if sum(rows):
            columns = [np.repeat(np.arange(len(items)), rows), np.concatenate([b[1] for b in best]), np.concatenate([b[0] for b in best])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item", "doc_id", "score"])

    return run


def _answer(index: DataFrame, block: list, n: int, length: int, k: int, id_type: str) -> DataFrame | None:
    """Best documents for the rows (item_id, text) of one block of items."""
    spark = index.sparkSession
    offsets, codes, terms = _terms(pa.array([r["text"] for r in block], pa.string()))
    items = [np.unique(codes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    if not terms:
        return None
    with batches_of(spark, 1):
        found = index.select("words", "ends").mapInArrow(_counts(terms), "term bigint, df bigint")
        counts = {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counts[t] + 1))) if t in counts else 0 for t in range(len(terms))], np.int64)
    columns = ["ids", "known", "lengths", "words", "ends", "places", "times", "widths"]
    with batches_of(spark, 1):
        answers = index.select(*columns).mapInArrow(_answers(terms, weights, items, n, length, k), "item bigint, doc_id bigint, score bigint")
        ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item bigint, item_id {id_type}")
        best = ranked.where(F.col("rank") <= k).join(F.broadcast(names), "item")
        return stored(best.select("item_id", "rank", "doc_id", "score"), "ranked")


def _block(number: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number


def search(spark: SparkSession, path: str, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of the index at ``path`` for each row of ``items``.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z
    lowered; null and empty texts have none. With ``N`` documents that have terms,
    ``L`` terms in all, ``df`` documents holding a term and ``n`` terms in a document,
    a term weighs ``floor(1000 ln((2N + 2) / (2 df + 1)))`` and adds that times
    ``10^9 tf div (1000 tf + 20 m)``, ``m = 50 + 50 n N div L``; each term of an item
    counts once. Only scores above 0 are returned, equal scores by ascending doc_id.
    A document without id counts in the statistics but is never returned; rows that
    repeat an id are documents, rows that repeat an item are items of their own.
    Items are answered in blocks of about ``BLOCK_BYTES`` of text, so what travels to
    the tasks stays as large however many there are.
    """
    index = spark.read.schema(INDEX).parquet(path)
    id_type = dict(items.select(F.col(id_col).alias("item_id")).dtypes)["item_id"]
    asked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n, length = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    found = [_answer(index, asked.where(_block(i, blocks)).collect(), n, length, k, id_type) for i in range(blocks if n else 0)]
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id bigint, score bigint")
    whole = found[0]
    for f in found[1:]:
        whole = whole.union(f)
    return whole
