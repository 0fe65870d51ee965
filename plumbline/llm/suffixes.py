"""Removal of repeated byte strings with suffix arrays.

A window of ``width`` bytes is named by its anchor, the least hash among its
32-byte runs; equal windows have equal anchors, and neighbouring windows mostly
share one. Anchors that recur send the bytes around each of their occurrences to
the anchor's shard. A shard lays its different passages end to end and builds their
suffix array by two-stage sorting: the suffixes smaller than their successors are
sorted directly, all others are induced by scanning the buckets of first bytes in
order. Common prefixes of neighbours in that order say which windows are equal.
An anchor with very many occurrences is spread over several shards by place, and
the windows that each of those holds once are compared by digest afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches_of, mix, slices, stored
from plumbline.operators.scale import attach_group

WIDTH, GRAM = 200, 32
#: Bytes of text worked on at once.
SLICE = 4 << 20
#: Passages of a shard, and occurrences of one anchor in a shard, about.
SHARD_ROWS, SPLIT_ROWS = 10_000, 20_000
LEAST_SHARDS = 12
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words_of(data: np.ndarray, count: int) -> np.ndarray:
    """The eight bytes from each of the first ``count`` places on, as one number that sorts as they do; zeros follow the end."""
    padded = np.zeros(-(-(count + 16) // 8) * 8 + 8, np.uint8)
    used = min(len(data), len(padded))
    padded[:used] = data[:used]
    words = np.empty(len(padded) - 8, np.uint64)
    for shift in range(8):
        words[shift::8] = np.frombuffer(padded, ">u8", len(words[shift::8]), shift)
    return words[:count]


def anchors_of(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text of ``data``, texts ending at ``ends``, the anchor of each, and where it stands."""
    count = len(data) - width + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    words = words_of(data, len(data))
    runs = len(data) - GRAM + 1
    hashes = words[:runs] * ODD[0]
    for place, odd in enumerate(ODD[1:], 1):
        hashes += words[8 * place : 8 * place + runs] * odd
    hashes = mix(hashes)
    # The least of the leading bits, the leftmost of those, so that each window has one place.
    low = np.uint64((1 << runs.bit_length()) - 1)
    least, span, reach = hashes & ~low | np.arange(runs, dtype=np.uint64), 1, width - GRAM + 1
    while span < reach:
        step = min(span, reach - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    sizes = np.diff(ends, prepend=0)
    at = np.flatnonzero(np.arange(count) + width <= np.repeat(ends, sizes)[:count])
    place = (least[at] & low).astype(np.int64)
    return at, hashes[place], place


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each ends; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8), np.cumsum(sizes)


def _runs(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows of one text with the same anchor: first and last start, anchor, text, and at how many places it stands."""
    at, anchors, place = anchors_of(data, ends, width)
    owner = np.searchsorted(ends, at, side="right")
    new = np.ones(len(at), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    steps = np.append(0, np.cumsum(place[1:] != place[:-1]))
    return at[first], at[last], anchors[first], owner[first], steps[last] - steps[first] + 1


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _met(anchors: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One number for an anchor in a text of the slice; a clash only makes a passage travel for nothing."""
    return anchors ^ mix(owner.astype(np.uint64) + np.uint64(1))


def _anchor_rows(width: int):
    """Anchors of every text and how often each occurs in it at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                _, _, anchors, owner, times = _runs(*_joined(part.column("text")), width)
                _, at, own = np.unique(_met(anchors, owner), return_index=True, return_inverse=True)
                total = np.bincount(own, times, len(at)).astype(np.int64)
                high, low = (part.column(c).to_numpy()[owner[at]] for c in ("hi", "lo"))
                yield pa.RecordBatch.from_arrays([_signed(anchors[at]), pa.array(high), pa.array(low), pa.array(total)], names=["anchor", "hi", "lo", "n"])

    return run


PASSAGES_DDL = "shard long, splits long, hi long, lo long, at long, bytes binary"


def _passages(width: int, shards: int):
    """Bytes of all neighbouring windows whose anchor recurs, with the shard they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, ends = _joined(part.column("text"))
                first, last, anchors, owner, _ = _runs(data, ends, width)
                lists = part.column("anchors")
                recurring = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                splits = part.column("splits").flatten().to_numpy(zero_copy_only=False)
                holder = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy())
                keys = _met(recurring, holder)
                order = np.argsort(keys)
                keys, splits = keys[order], splits[order]
                place = np.minimum(np.searchsorted(keys, _met(anchors, owner)), len(keys) - 1)
                hit = keys[place] == _met(anchors, owner)
                first, last, anchors, owner, splits = first[hit], last[hit], anchors[hit], owner[hit], splits[place[hit]]
                high, low = (part.column(c).to_numpy()[owner] for c in ("hi", "lo"))
                at = first - (ends - np.diff(ends, prepend=0))[owner]
                salt = mix(low.view(np.uint64) ^ mix(at.astype(np.uint64))) % splits.astype(np.uint64)
                shard = mix(anchors + salt * ODD[0]) % np.uint64(shards)
                text = data.tobytes()
                found = [text[a : b + width] for a, b in zip(first.tolist(), last.tolist())]
                columns = [_signed(shard), pa.array(splits), pa.array(high), pa.array(low), pa.array(at), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "splits", "hi", "lo", "at", "bytes"])

    return run


def _tied(differs: np.ndarray) -> np.ndarray:
    """Places that equal a neighbour, given which places differ from the one before."""
    after = np.append(differs[1:], True)
    return np.flatnonzero(~(differs & after))


def sorted_directly(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """``starts`` in the order of the ``width`` bytes there, eight bytes at a time; only ties look further."""
    order = starts[np.argsort(words[starts], kind="stable")]
    keys = words[order]
    differs = np.append(True, keys[1:] != keys[:-1])
    tied = _tied(differs) if len(order) else np.empty(0, np.int64)
    group = np.cumsum(differs)[tied]
    for offset in [*range(8, width - 8, 8), width - 8]:
        if not len(tied):
            break
        keys = words[order[tied] + offset]
        same = group[1:] == group[:-1]
        # Only groups whose members differ here are sorted.
        mixed = np.zeros(int(group[-1]) + 1, bool)
        mixed[group[1:][same & (keys[1:] != keys[:-1])]] = True
        some = np.flatnonzero(mixed[group])
        if len(some):
            turned = some[np.lexsort((keys[some], group[some]))]
            order[tied[some]] = order[tied[turned]]
            keys[some] = keys[turned]
        differs = np.append(True, ~same | (keys[1:] != keys[:-1]))
        still = _tied(differs)
        tied, group = tied[still], np.cumsum(differs)[still]
    return order


def suffix_array(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in the order of their first ``width`` bytes, and the words they start with.

    Two-stage sorting: a suffix smaller than its successor is sorted directly. Any
    other starts with a byte at least as large as its successor's first, so scanning
    the buckets of first bytes in order meets the successor before it and appends it
    to its bucket, in front of the directly sorted ones.
    """
    size = len(data)
    words = words_of(data, size + width)
    step = np.empty(size, np.int16)
    step[:-1] = np.diff(data.astype(np.int16))
    step[-1] = -1  # the end is smaller than any byte
    # A byte like the next one goes as the run it stands in does.
    turns = np.flatnonzero(step)
    turn = turns[np.searchsorted(turns, np.arange(size))]
    smaller = step[turn] > 0
    direct = sorted_directly(words, np.flatnonzero(smaller), width)
    cuts = np.searchsorted(data[direct], np.arange(257))
    # With ``width`` or more equal bytes ahead, order no longer matters.
    deep = np.flatnonzero(~smaller & (turn - np.arange(size) >= width))
    deep = deep[np.argsort(data[deep], kind="stable")]
    deep_cuts = np.searchsorted(data[deep], np.arange(257))
    skip = np.zeros(size, bool)
    skip[deep] = True
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(data[-1])].append(np.array([size - 1]))
    whole = []
    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        parts = []
        while len(wave):
            parts.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(data[before] == byte) & ~skip[before]]
        bucket = np.concatenate([*parts, deep[deep_cuts[byte] : deep_cuts[byte + 1]], direct[cuts[byte] : cuts[byte + 1]]])
        if not len(bucket):
            continue
        whole.append(bucket)
        before = bucket[bucket > 0] - 1
        heads = data[before]
        before, heads = before[heads > byte], heads[heads > byte]
        turned = np.argsort(heads, kind="stable")
        ends = np.cumsum(np.bincount(heads, minlength=256))
        for head in np.unique(heads).tolist():
            waiting[head].append(before[turned[ends[head - 1] : ends[head]]])
    return np.concatenate(whole), words


def equal_neighbours(words: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each place of ``order`` but the first: do at least ``width`` bytes agree with the one before?"""
    some = np.arange(len(order) - 1)
    for offset in [*range(0, width - 8, 8), width - 8]:
        some = some[words[order[some] + offset] == words[order[some + 1] + offset]]
    equal = np.zeros(max(0, len(order) - 1), bool)
    equal[some] = True
    return equal


#: kind 0: bytes from ``at`` to ``stop`` repeat; 1: a window of a split anchor, how often the shard holds it, and where if once.
FOUND = pa.schema([("kind", pa.int32())] + [(c, pa.int64()) for c in ("hi", "lo", "at", "stop", "n")] + [("window", pa.binary())])
FOUND_DDL = "kind int, hi long, lo long, at long, stop long, n long, window binary"


def _shard(width: int):
    def run(rows: pa.Table) -> pa.Table:
        coded = rows["bytes"].combine_chunks().dictionary_encode()
        which, passages = coded.indices.to_numpy(), coded.dictionary
        data, ends = _joined(passages)
        sizes = np.diff(ends, prepend=0)
        starts = ends - sizes
        copies = np.bincount(which, minlength=len(passages))
        split = np.zeros(len(passages), bool)
        split[which] = rows["splits"].to_numpy() > 1
        order, words = suffix_array(data, width)
        owner = np.repeat(np.arange(len(passages)), sizes)
        order = order[order + width <= ends[owner[order]]]  # whole windows only
        equal = equal_neighbours(words, order, width)
        kind = np.cumsum(np.append(0, ~equal))
        total = np.bincount(kind, copies[owner[order]])[kind]
        marked = np.zeros(len(data), bool)
        marked[order] = total > 1
        # Runs of covered bytes within each passage; starts may be at most a width apart.
        at = np.flatnonzero(marked)
        own = owner[at]
        new = np.append(True, (np.diff(at) > width) | (np.diff(own) != 0))[: len(at)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        a, b, own = at[first] - starts[own[first]], at[last] - starts[own[first]] + width, own[first]
        # Every row gets the runs of its passage.
        spans = np.bincount(own, minlength=len(passages))
        before = np.cumsum(spans) - spans
        row = np.repeat(np.arange(len(which)), spans[which])
        run_of = before[which[row]] + np.arange(len(row)) - np.repeat(np.cumsum(spans[which]) - spans[which], spans[which])
        high, low, base = (rows[c].to_numpy() for c in ("hi", "lo", "at"))
        nothing = lambda n, t: pa.nulls(n, t)
        here = pa.table(
            [pa.array(np.zeros(len(row), np.int32)), pa.array(high[row]), pa.array(low[row]), pa.array(base[row] + a[run_of]), pa.array(base[row] + b[run_of]), nothing(len(row), pa.int64()), nothing(len(row), pa.binary())],
            schema=FOUND,
        )
        if not split.any():
            return here
        heads = np.flatnonzero(np.append(True, ~equal)[: len(order)] & split[owner[order]])
        place, times = order[heads], total[heads]
        text = data.tobytes()
        digests = [xxhash.xxh3_128_digest(text[p : p + width]) for p in place.tolist()]
        holder = np.zeros(len(passages), np.int64)
        holder[which] = np.arange(len(which))  # the only row of a passage that is there once
        row = holder[owner[place]]
        spot = base[row] + place - starts[owner[place]]
        late = [np.ones(len(place), np.int32), high[row], low[row], spot, spot + width, np.minimum(times, 2).astype(np.int64)]
        return pa.concat_tables([here, pa.table([*(pa.array(c) for c in late), pa.array(digests, pa.binary())], schema=FOUND)])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            data, ends = _joined(part.column("text"))
            sizes = np.diff(ends, prepend=0)
            starts = ends - sizes
            edges = np.zeros(len(data) + 1, np.int64)
            runs = part.column("runs")
            owner = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False))
            for column, way in (("at", 1), ("stop", -1)):
                values = runs.flatten().field(column).to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(edges, starts[owner] + values, way)
            gone = pc.fill_null(part.column("whole"), False).to_numpy(zero_copy_only=False).astype(bool)
            cover = (np.cumsum(edges)[:-1] > 0) | np.repeat(gone, sizes)
            rising = cover.copy()
            rising[1:] &= ~cover[:-1]
            full = np.flatnonzero(sizes > 0)
            rising[starts[full]] = cover[starts[full]]
            count = lambda flags: np.diff(np.append(0, np.cumsum(flags))[np.append(0, ends)])
            removed = count(cover)
            offsets = np.append(0, np.cumsum(sizes - removed))
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~cover].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes), pa.array(removed.astype(np.int64)), pa.array(count(rising).astype(np.int64)), kept.cast(pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a 128-bit name (hi, lo) of the text, and an id to meet them by that no null has."""
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    names = [F.xxhash64("text").alias("hi"), F.xxhash64(F.lit(1), "text").alias("lo")]
    return rows.select("doc_id", "text", *names).withColumn("id", F.coalesce("doc_id", "hi"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per row of ``docs``, texts being UTF-8 bytes.

    A byte goes if a string of ``width`` bytes covers it that also starts anywhere
    else, in another row or at another place of the same one; strings do not cross
    rows and are judged on the input. ``n_spans`` counts maximal runs of bytes that
    go, ``kept`` holds the others. Null counts as empty; texts below ``width`` bytes
    lose nothing. Rows are documents of their own, whether their id is null, repeated
    or not, so of equal texts of at least ``width`` bytes nothing stays. Other columns
    are not read.
    """
    if width < GRAM + 8:
        raise ValueError(f"width must be at least {GRAM + 8}")
    spark = docs.sparkSession
    rows = _named(docs, id_col, text_col)
    long = rows.where(F.octet_length("text") >= width)
    # Equal texts are one, met through the smallest id; all their rows go whole.
    groups = stored(long.select("id", "hi", "lo").groupBy("hi", "lo").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "texts")
    copied = groups.where("n > 1")
    copies = attach_group(long.select("id", "hi", "lo"), copied.select("hi", "lo", F.col("n").alias("size")), ["hi", "lo"], "size", ["id"], hot_floor=SHARD_ROWS)
    copies = copies.where("size is not null").select("id", "hi", "lo").distinct()
    with batches_of(spark, 1024):
        pairs = stored(long.select("text", "hi", "lo").mapInArrow(_anchor_rows(width), "anchor long, hi long, lo long, n long"), "pairs")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("hi", "lo") for f in (F.min, F.max)]
    totals = pairs.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("most"), *ends)
    totals = stored(totals.where("most > 1 or min_hi <> max_hi or min_lo <> max_lo").select("anchor", "rows"), "recurring")
    met = attach_group(pairs, totals, ["anchor"], "rows", ["hi"], hot_floor=SHARD_ROWS).where("rows is not null")
    met = stored(met.groupBy("anchor", "hi", "lo").agg(F.max("n").alias("n")), "met")
    sizes = met.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > SPLIT_ROWS)
    hot = sizes.select("anchor", F.ceil(F.col("n") / SPLIT_ROWS).cast("long").alias("splits"))
    each = met.join(hot, "anchor", "left").select("hi", "lo", "anchor", F.coalesce("splits", F.lit(1).cast("long")).alias("splits"))
    lists = each.groupBy("hi", "lo").agg(F.collect_list(F.struct("anchor", "splits")).alias("list"))
    wanted = lists.join(groups.select("id", "hi", "lo"), ["hi", "lo"]).select("id", "hi", "lo", F.col("list.anchor").alias("anchors"), F.col("list.splits").alias("splits"))
    shards = max(LEAST_SHARDS, -(-met.count() // SHARD_ROWS))
    with batches_of(spark, 1024):
        texts = long.select("id", "hi", "lo", "text").join(wanted, ["id", "hi", "lo"])
        # Rows that repeat an id and its text travel more than once; such a text goes whole and counts as repeated anyway.
        passages = texts.select("text", "hi", "lo", "anchors", "splits").mapInArrow(_passages(width, shards), PASSAGES_DDL)
        found = stored(passages.groupBy("shard").applyInArrow(_shard(width), FOUND_DDL), "found")
    once = F.collect_list(F.when(F.col("n") == 1, F.struct("hi", "lo", "at", "stop"))).alias("spots")
    late = found.where("kind = 1").groupBy("window").agg(F.sum("n").alias("n"), once).where("n > 1")
    late = late.select(F.explode("spots").alias("spot")).select("spot.*")
    runs = found.where("kind = 0").select("hi", "lo", "at", "stop").union(late)
    runs = runs.groupBy("hi", "lo").agg(F.collect_list(F.struct("at", "stop")).alias("runs"))
    single = groups.where("n = 1").select("id", "hi", "lo").join(runs, ["hi", "lo"])
    verdicts = single.select("id", "hi", "lo", "runs", F.lit(False).alias("whole")).unionByName(
        copies.select("id", "hi", "lo", F.lit(True).alias("whole")), allowMissingColumns=True
    )
    placed = rows.join(stored(verdicts, "verdicts"), ["id", "hi", "lo"], "left").select("doc_id", "text", "runs", "whole")
    return placed.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
