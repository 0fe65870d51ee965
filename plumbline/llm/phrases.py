"""Removal of passages that repeat across documents.

A window of 13 words is named by its anchor, the least hash among its six-word
runs; equal windows have equal anchors, and neighbouring windows mostly share
one. Anchors that occur in different texts are candidates. The words around each
occurrence of such an anchor travel to the anchor's shard, which confirms the
windows that recur, compiles them into an Aho-Corasick automaton over word
numbers, and streams its passages through it to locate every occurrence. So each
document meets only the shards it shares an anchor with. An anchor with very many
occurrences is spread over several shards, whose windows are merged before the
automata are compiled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches_of, mapped, mix, slices, split_words, stored, word_hashes
from plumbline.operators.scale import attach_group

WINDOW = 13
ANCHOR = 6
#: Passages of a shard, and occurrences of one anchor in a shard, about.
SHARD_ROWS, SPLIT_ROWS = 10_000, 2_000
LEAST_SHARDS = 64


def _sequences(texts: pa.Array) -> tuple[list[bytes], list[bytes]]:
    """The words of every text joined by one space, and a 128-bit name of that."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"").to_numpy(zero_copy_only=False).tolist()
    joined = [b" ".join(text.split()) for text in raw]
    return joined, [xxhash.xxh3_128_digest(text) for text in joined]


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the texts and hash of every word."""
    ends, codes, words = split_words(texts)
    return ends, word_hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)


def _short(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.int64)


def _anchors(ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the windows that lie in one text, and the anchor of each."""
    count = len(hashes) - WINDOW + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    runs = np.full(len(hashes) - ANCHOR + 1, ANCHOR, np.uint64)
    for place in range(ANCHOR):
        runs = mix(runs ^ hashes[place : place + len(runs)]) + np.uint64(place + 1)
    least, width = mix(runs), 1
    while width < WINDOW - ANCHOR + 1:
        step = min(width, WINDOW - ANCHOR + 1 - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    last = np.repeat(ends[1:], np.diff(ends))[:count]
    at = np.flatnonzero(np.arange(count) + WINDOW <= last)
    return at, least[at].view(np.int64)


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            joined, digests = _sequences(part.column("text"))
            sizes = [text.count(b" ") + 1 if text else 0 for text in joined]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(_short(digests)), pa.array(digests, pa.binary())],
                names=["doc_id", "n_words", "seq", "digest"],
            )


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            ends, hashes = _hashed(part.column("text"))
            _, digests = _sequences(part.column("text"))
            at, anchors = _anchors(ends, hashes)
            owner = np.repeat(np.arange(len(digests)), np.diff(ends))[at]
            new = np.ones(len(at), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
            anchors, owner = anchors[new], owner[new]
            _, first, times = np.unique(anchors.view(np.uint64) ^ mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchors[first]), pa.array(_short(digests)[owner[first]]), pa.array(times)], names=["anchor", "seq", "n"])


def _passages(shards: int):
    """Words around every occurrence of a text's recurring anchors, with the shard they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ends, hashes = _hashed(part.column("text"))
                joined, digests = _sequences(part.column("text"))
                at, anchors = _anchors(ends, hashes)
                names = _short(digests).tolist()
                docs, seqs = part.column("doc_id").to_pylist(), part.column("seq").to_pylist()
                out: dict[str, list] = {c: [] for c in ("shard", "anchor", "splits", "doc_id", "seq", "at", "words")}
                cuts = np.searchsorted(at, ends)
                for i, text in enumerate(joined):
                    if names[i] != seqs[i]:  # another text of a repeated id
                        continue
                    own_at, own = at[cuts[i] : cuts[i + 1]] - ends[i], anchors[cuts[i] : cuts[i + 1]]
                    wanted = part.column("anchors")[i].values.to_numpy()
                    order = np.argsort(wanted, kind="stable")
                    wanted, sizes = wanted[order], part.column("sizes")[i].values.to_numpy()[order]
                    place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                    hit = wanted[place] == own
                    first = hit.copy()
                    first[1:] &= ~((own[1:] == own[:-1]) & hit[:-1])
                    starts = np.flatnonzero(first)
                    final = hit.copy()
                    final[:-1] &= ~((own[1:] == own[:-1]) & hit[1:])
                    stops = np.flatnonzero(final)
                    if not len(starts):
                        continue
                    words = text.split(b" ")
                    splits = np.maximum(1, -(-sizes[place[starts]] // SPLIT_ROWS))
                    salt = mix(np.array([docs[i]], np.int64).view(np.uint64)) % splits.astype(np.uint64)
                    shard = mix(own[starts].view(np.uint64) + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)
                    out["shard"] += shard.astype(np.int64).tolist()
                    out["anchor"] += own[starts].tolist()
                    out["splits"] += splits.tolist()
                    out["at"] += own_at[starts].tolist()
                    out["words"] += [b" ".join(words[a : b + WINDOW]) for a, b in zip(own_at[starts].tolist(), own_at[stops].tolist())]
                    out["doc_id"] += [docs[i]] * len(starts)
                    out["seq"] += [seqs[i]] * len(starts)
                yield pa.RecordBatch.from_pydict(out, schema=PASSAGES)

    return run


PASSAGES = pa.schema(
    [(c, pa.int64()) for c in ("shard", "anchor", "splits", "doc_id", "seq", "at")] + [("words", pa.binary())]
)
PASSAGES_DDL = "shard long, anchor long, splits long, doc_id long, seq long, at long, words binary"
#: kind 0: words from ``at`` to ``stop`` repeat; 1: a window of a split anchor and its least and greatest document; 2: a passage of one.
FOUND = pa.schema(
    [("kind", pa.int32())] + [(c, pa.int64()) for c in ("shard", "anchor", "splits", "doc_id", "seq", "at", "stop", "low", "high")] + [("words", pa.binary())]
)
FOUND_DDL = "kind int, shard long, anchor long, splits long, doc_id long, seq long, at long, stop long, low long, high long, words binary"


def _listed(column: pa.ChunkedArray) -> list:
    return column.to_numpy().tolist()


def _numbered(*parts: pa.ChunkedArray) -> tuple[list[str], list[list[tuple[int, ...]]]]:
    """Distinct words of all parts, and the word numbers of every run in each."""
    runs = pa.concat_arrays([chunk.cast(pa.large_string()) for part in parts for chunk in part.chunks] or [pa.array([], pa.large_string())])
    ends, codes, words = split_words(runs)
    codes, ends = codes.tolist(), ends.tolist()
    numbered = iter([tuple(codes[a:b]) for a, b in zip(ends[:-1], ends[1:])])
    return words, [list(islice(numbered, len(part))) for part in parts]


def _locate(patterns: dict[tuple[int, ...], int], passages: list[tuple[int, ...]], docs: list[int], at: list[int]) -> list[tuple[int, int, int]]:
    """(passage, start, stop) of word runs covered by patterns whose least document is below the passage's."""
    if not patterns:
        return []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, low in patterns.items():
        automaton.add_word(words, low)
    automaton.make_automaton()
    found = []
    for i, words in enumerate(passages):
        start = stop = None
        for end, low in automaton.iter(words):
            if low >= docs[i]:
                continue
            first = end - WINDOW + 1
            if start is not None and first <= stop:
                stop = end + 1
            else:
                if start is not None:
                    found.append((i, at[i] + start, at[i] + stop))
                start, stop = first, end + 1
        if start is not None:
            found.append((i, at[i] + start, at[i] + stop))
    return found


def _windows(passages: list[tuple[int, ...]], docs: list[int]) -> dict[tuple[int, ...], list[int]]:
    """Least and greatest document of every window."""
    seen: dict[tuple[int, ...], list[int]] = {}
    for words, doc in zip(passages, docs):
        for i in range(len(words) - WINDOW + 1):
            window = words[i : i + WINDOW]
            ends = seen.get(window)
            if ends is None:
                seen[window] = [doc, doc]
            elif doc < ends[0]:
                ends[0] = doc
            elif doc > ends[1]:
                ends[1] = doc
    return seen


def _shard(rows: pa.Table) -> pa.Table:
    """Confirm, compile and locate within one shard; what belongs to split anchors is handed on."""
    whole = pc.equal(rows["splits"], 1)
    own, rest = rows.filter(whole), rows.filter(pc.invert(whole))
    docs, seqs, at = (_listed(own[c]) for c in ("doc_id", "seq", "at"))
    _, [passages] = _numbered(own["words"])
    confirmed = {w: low for w, (low, high) in _windows(passages, docs).items() if low < high}
    tables = [_found(0, _runs(_locate(confirmed, passages, docs, at), docs, seqs))]
    if rest.num_rows:
        for group in rest.group_by(["anchor", "splits", "shard"]).aggregate([("doc_id", "list"), ("words", "list")]).to_pylist():
            names, [passages] = _numbered(pa.chunked_array([pa.array(group["words_list"], pa.binary())]))
            windows = _windows(passages, group["doc_id_list"])
            same = {c: [group[c]] * len(windows) for c in ("anchor", "splits")}
            low, high = ([ends[k] for ends in windows.values()] for k in (0, 1))
            tables.append(_found(1, same | {"low": low, "high": high, "words": [" ".join([names[n] for n in w]).encode() for w in windows]}))
        tables.append(_found(2, {c: rest[c] for c in PASSAGES.names}))
    return pa.concat_tables(tables)


def _found(kind: int, columns: dict) -> pa.Table:
    """Rows of one kind, null where ``columns`` has none."""
    size = len(next(iter(columns.values())))
    given = {"kind": [kind] * size} | columns
    return pa.table([given[f.name] if isinstance(given.get(f.name), pa.ChunkedArray) else pa.array(given.get(f.name, [None] * size), f.type) for f in FOUND], schema=FOUND)


def _runs(found: list[tuple[int, int, int]], docs: list[int], seqs: list[int]) -> dict[str, list[int]]:
    return {"doc_id": [docs[i] for i, _, _ in found], "seq": [seqs[i] for i, _, _ in found], "at": [a for _, a, _ in found], "stop": [b for _, _, b in found]}


def _split_shard(passages: pa.Table, windows: pa.Table) -> pa.Table:
    """Compile the merged windows of a shard's split anchors and locate them in its passages."""
    docs, seqs, at = (_listed(passages[c]) for c in ("doc_id", "seq", "at"))
    _, [own, merged] = _numbered(passages["words"], windows["window"])
    found = _locate(dict(zip(merged, _listed(windows["low"]))), own, docs, at)
    return pa.table(_runs(found, docs, seqs), schema=pa.schema([(c, pa.int64()) for c in ("doc_id", "seq", "at", "stop")]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            joined, digests = _sequences(part.column("text"))
            seqs = _short(digests).tolist()
            sizes, gone, kept = [], [], []
            for i, (text, runs) in enumerate(zip(joined, part.column("runs").to_pylist())):
                own = [run for run in runs or [] if run["seq"] == seqs[i]]
                if not own:
                    sizes.append(text.count(b" ") + 1 if text else 0)
                    gone.append(0)
                    kept.append(text)
                    continue
                words = text.split(b" ")
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, [run["at"] for run in own], 1)
                np.add.at(edges, [run["stop"] for run in own], -1)
                stays = np.cumsum(edges)[:-1] == 0
                sizes.append(len(words))
                gone.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(compress(words, stays.tolist())))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )


def repeated_runs(given: DataFrame) -> DataFrame:
    """(doc_id, seq, at, stop): word runs of (doc_id, text) rows that repeat a document with a smaller id."""
    spark = given.sparkSession
    named = mapped(given, _names, "doc_id long, n_words long, seq long, digest binary", "names")
    # Texts with equal words are one; the smallest id speaks for them, the others go whole.
    speakers = stored(named.where(f"doc_id is not null and n_words >= {WINDOW}").groupBy("digest", "seq").agg(F.min("doc_id").alias("doc_id")), "speakers")
    copies = (
        named.where(f"n_words >= {WINDOW}")
        .join(speakers.select("digest", F.col("doc_id").alias("first")), "digest")
        .where("first < doc_id")
        .select("doc_id", "seq", F.lit(0).cast("long").alias("at"), F.col("n_words").alias("stop"))
    )
    with batches_of(spark, 1024):
        rows = given.where("doc_id is not null").mapInArrow(_anchor_rows, "anchor long, seq long, n long")
        # Copies have the same anchors, so each distinct text has one row per anchor.
        pairs = stored(rows.groupBy("anchor", "seq").agg(F.max("n").alias("n")), "pairs")
    totals = pairs.groupBy("anchor").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
    totals = stored(totals.where("low < high").select("anchor", "texts", "n"), "totals")
    met = attach_group(pairs.select("anchor", "seq"), totals, ["anchor"], "texts", ["seq"], hot_floor=SHARD_ROWS)
    recurring = stored(met.where("n is not null").select("anchor", "seq", "n"), "anchors")
    lists = recurring.groupBy("seq").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("n").alias("sizes"))
    wanted = stored(lists.join(speakers.select("seq", "doc_id"), "seq"), "lists")
    shards = max(LEAST_SHARDS, -(-recurring.count() // SHARD_ROWS))
    with batches_of(spark, 1024):
        passages = given.join(wanted, "doc_id").select("doc_id", "text", "seq", "anchors", "sizes").mapInArrow(_passages(shards), PASSAGES_DDL)
        found = stored(passages.groupBy("shard").applyInArrow(_shard, FOUND_DDL), "found")
    windows = found.where("kind = 1").groupBy("anchor", F.col("words").alias("window")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # A window goes to every shard that holds passages of its anchor.
    homes = found.where("kind = 2").select("anchor", F.col("shard").alias("home")).distinct()
    windows = windows.where("low < high").join(homes, "anchor").select("home", "window", "low")
    split = found.where("kind = 2").select("shard", "doc_id", "seq", "at", "words")
    late = split.groupBy("shard").cogroup(windows.groupBy("home")).applyInArrow(_split_shard, "doc_id long, seq long, at long, stop long")
    return copies.union(found.where("kind = 0").select("doc_id", "seq", "at", "stop")).union(late)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per row of ``docs``.

    A word goes if a window of 13 words covers it whose words also start a window
    of a document with a smaller id; windows are judged on the input. Words are
    ``[^\\x20\\x09-\\x0D]+`` as they stand; what stays is joined by one space. Null
    and empty texts have no words, texts below 13 words lose none. Rows with a null
    id lose nothing and take nothing from others; rows that repeat an id count as
    one document and take nothing from each other. Other columns are not read.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    runs = repeated_runs(given).groupBy("doc_id").agg(F.collect_set(F.struct("seq", "at", "stop")).alias("runs"))
    placed = given.join(stored(runs, "runs"), "doc_id", "left").select("doc_id", "text", "runs")
    return placed.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_text string")
