"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves each pre-token
that is a vocabulary entry as a whole, for all distinct pre-tokens of a slice at
once. The rest are merged by rank with a heap over a linked list of bytes.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from plumbline.llm.common import mix, slices, word_hashes

#: Merged pre-tokens in each of the two generations a worker remembers.
REMEMBERED = 400_000
#: Pre-tokens longer than this are merged anew each time.
LONGEST_REMEMBERED = 64
PER_BUCKET = 4
SEEDS_AT_ONCE = 64


class PerfectHash:
    """Minimal perfect hash of distinct keys: n keys fill the slots 0 .. n - 1.

    Keys are dealt into buckets. From the fullest bucket down, a seed is searched
    that sends a bucket's keys to free slots; a bucket of one key names its slot.
    """

    def __init__(self, hashes: np.ndarray):
        self.size = len(hashes)
        self.buckets = max(1, self.size // PER_BUCKET)
        self.shift = np.zeros(self.buckets, np.int64)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(counts) - counts
        free = np.ones(self.size, bool)
        for b in np.argsort(-counts, kind="stable").tolist():
            if counts[b] < 2:
                break
            own, first = hashes[order[starts[b] : starts[b] + counts[b]]], 1
            while True:
                seeds = np.arange(first, first + SEEDS_AT_ONCE, dtype=np.uint64)
                slots = np.sort(self._slot(own[None, :], seeds[:, None]), axis=1)
                fits = free[slots].all(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1)
                if fits.any():
                    pick = int(np.argmax(fits))
                    self.shift[b] = first + pick
                    free[slots[pick]] = False
                    break
                first += SEEDS_AT_ONCE
        alone = np.flatnonzero(counts == 1)
        self.shift[alone] = -1 - np.flatnonzero(free)[: len(alone)]

    def _slot(self, hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return (mix(hashes ^ mix(seeds)) % np.uint64(self.size)).astype(np.int64)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.full(len(hashes), -1, np.int64)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slot(hashes, np.maximum(shift, 0).astype(np.uint64)))


class Vocabulary:
    """Token bytes by rank, their perfect hash, and the pattern that splits text."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.pattern = pattern
        self.tokens = list(ranks)
        self.ids = np.array(list(ranks.values()), np.int64)
        self.hash = PerfectHash(word_hashes(self.tokens))
        slots = self.hash.slots(word_hashes(self.tokens))
        place = np.empty(len(slots), np.int64)
        place[slots] = np.arange(len(slots))
        self.at_slot = place

    def prepare(self) -> None:
        """What a worker builds once."""
        if not hasattr(self, "ranks"):
            self.split = regex.compile(self.pattern).findall
            self.ranks = dict(zip(self.tokens, self.ids.tolist()))
            self.bytes_of = dict(zip(self.ids.tolist(), self.tokens))
            self.pairs = np.full(1 << 16, -1, np.int64)
            for token, rank in self.ranks.items():
                if len(token) == 2:
                    self.pairs[token[0] << 8 | token[1]] = rank
            self.young: dict[bytes, bytes] = {}
            self.old: dict[bytes, bytes] = {}

    def whole(self, words: list[bytes]) -> np.ndarray:
        """Ids of the words that are entries, -1 for the others."""
        places = self.at_slot[self.hash.slots(word_hashes(words))] if self.tokens and words else np.empty(0, np.int64)
        same = [self.tokens[p] == w for p, w in zip(places.tolist(), words)] or [False] * len(words)
        ids = np.full(len(words), -1, np.int64)
        hit = np.array(same, bool)
        ids[hit] = self.ids[places[hit]] if len(places) else []
        return ids

    def first_ranks(self, words: list[bytes]) -> list[list[int]]:
        """Ranks of the adjacent byte pairs of every word (-1: not an entry), closed by -1."""
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        ranks = np.full(len(raw), -1, np.int64)
        ranks[:-1] = self.pairs[raw[:-1] << 8 | raw[1:]]
        ranks[ends - 1] = -1
        flat, starts = ranks.tolist(), [0, *ends.tolist()]
        return [flat[i:j] for i, j in zip(starts, starts[1:])]

    def merge(self, word: bytes, rank: list[int]) -> bytes:
        """Join the adjacent pair of lowest rank, leftmost first, until no pair is an entry; ids as bytes."""
        size, find = len(word), self.ranks.get
        end, left = list(range(1, size + 1)), list(range(-1, size))
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        while heap:
            item = heappop(heap)
            i = item & 0xFFFFFFFF
            if rank[i] != item >> 32:
                continue
            gone = end[i]
            end[i] = stop = end[gone]
            rank[gone] = -1
            if stop < size:
                left[stop] = i
                rank[i] = r = find(word[i : end[stop]], -1)
                if r >= 0:
                    heappush(heap, r << 32 | i)
            else:
                rank[i] = -1
            if i:
                before = left[i]
                rank[before] = r = find(word[before:stop], -1)
                if r >= 0:
                    heappush(heap, r << 32 | before)
        ids, i = array("I"), 0
        while i < size:
            stop = end[i]
            ids.append(self.ranks[word[i:stop]])
            i = stop
        return ids.tobytes()

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of words that are no entries, from memory where they were met before."""
        young, old = self.young, self.old
        out = [young.get(w) or old.get(w) for w in words]
        new = [i for i, ids in enumerate(out) if ids is None]
        for i, rank in zip(new, self.first_ranks([words[i] for i in new]) if new else []):
            word = words[i]
            out[i] = ids = self.merge(word, rank)
            if len(word) <= LONGEST_REMEMBERED:
                if len(self.young) >= REMEMBERED:
                    self.old, self.young = self.young, {}
                self.young[word] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        self.prepare()
        pieces = [self.split(t) for t in texts]
        sizes = np.array([len(p) for p in pieces], np.int64)
        coded = pa.array([w for p in pieces for w in p], pa.large_string()).dictionary_encode()
        words = [w.encode() for w in coded.dictionary.to_pylist()]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if not words:
            return [np.empty(0, np.uint32) for _ in texts]
        whole = self.whole(words)
        ids: list[bytes] = [w.tobytes() for w in whole.astype(np.uint32)]
        missed = np.flatnonzero(whole < 0).tolist()
        for i, made in zip(missed, self.merged([words[i] for i in missed])):
            ids[i] = made
        lengths = np.array([len(x) for x in ids], np.int64) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        starts = np.cumsum(lengths) - lengths
        taken = lengths[codes]
        ends = np.cumsum(taken)
        out = flat[np.repeat(starts[codes] - (ends - taken), taken) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[np.cumsum(sizes)]
        return np.split(out, cuts[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        self.prepare()
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) per row; ``ids`` holds little-endian unsigned 32-bit integers.

    Every match of the vocabulary's pattern is encoded by itself. A null or empty
    text has no ids; rows that repeat an id are encoded one by one; a null id
    stays null. Other columns are not read. The rank file is a fixed small file
    read on the driver and broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids = shared.value.encode(pc.fill_null(part.column("text"), "").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids"],
                )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) per row: ``encode`` and ``decode`` in one pass.

    A core then holds one worker with one vocabulary instead of two of each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids = shared.value.encode(pc.fill_null(part.column("text"), "").to_pylist())
                columns = [
                    part.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                    pa.array([shared.value.decode(x) for x in ids], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` with the bytes of its ``ids`` as column ``decoded`` (null ids: no bytes)."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    encoded = encoded.drop("decoded")
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))
