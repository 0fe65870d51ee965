"""Product-quantised vector codes, trained with adaptive distance bounds.

A vector is cut into parts and each part is replaced by the nearest entry of its
position's codebook. Between passes every row keeps, per part, its ``b`` closest
entries with ordered lower bounds on the distances to them and to all that follow,
and one outer bound for the entries not listed. When entries move, the bounds
shrink by the moves; a row whose own entry is nearer than the first bound is
certain, otherwise only the listed entries up to the first bound that holds are
compared, and all of them only where the outer bound fails. The share of rows
that needed so many entries sets ``b`` for the next pass. Components, distances
and bounds are integers, so no comparison depends on rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches_of, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Components count as at most this large, so that integer distances fit 64 bits.
LARGEST = 2.0**18
#: Listed entries of the first pass, and least and most of them later.
FIRST_B, LEAST_B = 8, 2
#: Of the rows that a list can serve, so many are served by the next one; lists grow where more than the second share needed all entries.
SERVED, MISSED = 0.99, 0.05
NO_ENTRY, FAR = 255, np.iinfo(np.uint16).max
BATCH = 4096


def usable(vector: Column, parts: int = PARTS) -> Column:
    """Not null, every component a finite number, and a length that can be cut into equal parts."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False)) & (F.size(vector) > 0) & (F.size(vector) % parts == 0)


def integers(rows: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * np.clip(rows, -LARGEST, LARGEST)).astype(np.int64)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``x`` from every entry."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * most * most < 2**53 else np.int64  # sums of whole numbers below 2^53 are exact
    x, entries = x.astype(kind), entries.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)).astype(np.int64)


def root(values: np.ndarray) -> np.ndarray:
    """Whole part of the square root, exact for any 64-bit value."""
    low = np.sqrt(values.astype(np.float64)).astype(np.int64)
    low -= low * low > values
    return low + ((low + 1) * (low + 1) <= values)


@dataclass
class Near:
    """Per row: listed entries, closest first, and bounds on the distances to them and to all later ones; the last bound is the outer one."""

    entry: np.ndarray
    low: np.ndarray

    def resized(self, b: int) -> Near:
        have = self.entry.shape[1]
        if b <= have:
            return Near(self.entry[:, :b], self.low[:, : b + 1])
        rows = len(self.entry)
        spare = np.full((rows, b - have), NO_ENTRY, np.uint8)
        return Near(np.hstack([self.entry, spare]), np.hstack([self.low, np.repeat(self.low[:, -1:], b - have, axis=1)]))


def listed(distances: np.ndarray, b: int) -> Near:
    """The ``b`` closest entries of each row, lower indexes first among equals."""
    order = np.argsort(distances, axis=1, kind="stable")[:, : b + 1]
    low = np.minimum(root(np.take_along_axis(distances, order, axis=1)), FAR)
    if order.shape[1] <= b:  # every entry is listed
        return Near(order.astype(np.uint8), np.hstack([low, np.full((len(low), 1), FAR)])).resized(b)
    return Near(order[:, :b].astype(np.uint8), low)


def assign(x: np.ndarray, near: Near | None, entries: np.ndarray, moves: np.ndarray | None, b: int) -> tuple[Near, np.ndarray, np.ndarray]:
    """Nearest entry of every row (``near.entry[:, 0]``), its squared distance, and how many bounds failed.

    ``moves`` are upper bounds on how far each entry went since ``near`` was made.
    """
    if near is None:
        all_of = squares(x, entries)
        made = listed(all_of, b)
        return made, np.take_along_axis(all_of, made.entry[:, :1].astype(np.int64), axis=1)[:, 0], np.full(len(x), b)
    entry, low = near.entry.copy(), near.low.astype(np.int64)
    width = entry.shape[1]
    shift = np.append(moves, moves.max(initial=0))  # an empty place moves as far as any entry
    low[:, :width] -= shift[np.minimum(entry, len(moves))]
    low[:, width] -= moves.max(initial=0)
    low = np.maximum(np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1], 0)
    own = x - entries[entry[:, 0]]
    best = (own * own).sum(axis=1)
    failed = (best[:, None] >= low[:, 1:] * low[:, 1:]).sum(axis=1)
    low[:, 0] = np.minimum(np.minimum(root(best), FAR), low[:, 1])
    # A row whose first bounds fail compares the entries up to the last of them.
    for count in np.unique(failed[(failed > 0) & (failed < width)]).tolist():
        rows = np.flatnonzero(failed == count)
        some = entry[rows, : count + 1].astype(np.int64)
        gap = x[rows, None, :] - entries[some]
        distance = (gap * gap).sum(axis=2)
        order = np.lexsort((some, distance), axis=1)
        distance = np.take_along_axis(distance, order, axis=1)
        entry[rows, : count + 1] = np.take_along_axis(some, order, axis=1)
        low[rows, : count + 1] = np.minimum(root(distance), FAR)
        best[rows] = distance[:, 0]
    low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
    made = Near(entry, low).resized(b)
    rows = np.flatnonzero(failed == width)
    if len(rows):
        all_of = squares(x[rows], entries)
        whole = listed(all_of, b)
        made = Near(made.entry.copy(), made.low.copy())
        made.entry[rows], made.low[rows] = whole.entry, whole.low
        best[rows] = np.take_along_axis(all_of, whole.entry[:, :1].astype(np.int64), axis=1)[:, 0]
    return made, best, failed


STATE = "ints binary, near binary, low binary, stats array<bigint>"


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Equally long binaries as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _parts_of(matrix: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(matrix, np.cumsum(sizes)[:-1], axis=1)


def _states(near: pa.Array, low: pa.Array, sizes: list[int]) -> list[Near]:
    entries = _parts_of(_matrix(near, np.uint8), sizes)
    bounds = _parts_of(_matrix(low, np.uint16), [b + 1 for b in sizes])
    return [Near(e, l) for e, l in zip(entries, bounds)]


def _rows(matrix: np.ndarray) -> pa.Array:
    matrix = np.ascontiguousarray(matrix)
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def _sums(ints: np.ndarray, chosen: list[np.ndarray], failed: list[np.ndarray], entries: int, stats: np.ndarray) -> None:
    """Add a batch to ``stats[part]``: per entry a count and component sums, then how often each number of bounds failed."""
    width = ints.shape[1] // len(chosen)
    for p, (own, gone) in enumerate(zip(chosen, failed)):
        books = stats[p, : entries * (width + 1)].reshape(entries, width + 1)
        np.add.at(books, own, np.hstack([np.ones((len(own), 1), np.int64), ints[:, p * width : (p + 1) * width]]))
        stats[p, entries * (width + 1) :] += np.bincount(gone, minlength=entries + 1)


def _pass(books: np.ndarray, moves: np.ndarray | None, read_b: list[int] | None, write_b: list[int], last: bool, kept: list[str]):
    """One assignment of all rows; the first reads vectors, later ones what the pass before wrote."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, names = np.zeros((parts, entries * (width + 1) + entries + 1), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema
            if read_b is None:
                values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
                ints, before = integers(values.astype(np.float64).reshape(batch.num_rows, -1)), [None] * parts
            else:
                ints = _matrix(batch.column("ints"), np.int32).astype(np.int64)
                before = _states(batch.column("near"), batch.column("low"), read_b)
            found = [
                assign(ints[:, p * width : (p + 1) * width], before[p], books[p], None if moves is None else moves[p], write_b[p]) for p in range(parts)
            ]
            chosen = [near.entry[:, 0].astype(np.int64) for near, _, _ in found]
            columns = [batch.column(c) for c in kept]
            if last:
                code = _rows(np.stack(chosen, axis=1).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([*columns, code, pa.array(sum(best for _, best, _ in found))], names=[*kept, "code", "error"])
                continue
            _sums(ints, chosen, [gone for _, _, gone in found], entries, stats)
            yield pa.RecordBatch.from_arrays(
                [
                    *columns,
                    _rows(ints.astype(np.int32)),
                    _rows(np.hstack([near.entry for near, _, _ in found]).astype(np.uint8)),
                    _rows(np.hstack([near.low for near, _, _ in found]).astype(np.uint16)),
                    pa.nulls(batch.num_rows, pa.list_(pa.int64())),
                ],
                names=[*kept, "ints", "near", "low", "stats"],
            )
        if names is not None and not last:  # one row with the sums of the task
            empty = [pa.nulls(1, names.field(c).type) for c in kept] + [pa.nulls(1, pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([*empty, pa.array([stats.ravel().tolist()], pa.list_(pa.int64()))], names=[*kept, "ints", "near", "low", "stats"])

    return run


def _next_b(failures: np.ndarray, b: int, entries: int) -> int:
    """Size of the next lists of a part, from how many rows had how many bounds fail."""
    total, missed = failures.sum(), failures[b]
    if missed > MISSED * total:
        return min(2 * b, max(1, entries - 1))
    served = np.cumsum(failures[:b])
    need = int(np.searchsorted(served, SERVED * served[-1])) + 1
    return min(b, max(LEAST_B, need + 1), max(1, entries - 1))


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) per usable row, and the codebooks as integers[part, entry, component].

    A component ``x`` counts as the integer ``floor(256 * x)``, with ``x`` held
    within ``LARGEST`` either way. Codebooks start as the parts of the rows with the
    smallest ids (a null id comes last, equal ids go by vector), fewer than
    ``entries`` if there are fewer rows. Each round assigns all rows and replaces an
    entry by the floored means of its parts; an unused entry stays. ``code`` has one
    byte per part, ``error`` is the squared distance in integers; equal distances go
    to the lower index. Rows whose vector is null, holds a null or non-finite
    component, cannot be cut into equal parts, or is not as long as the one with the
    smallest id are dropped; a table without usable rows gives none, and codebooks
    without entries. ``entries`` is 255 at most. Other columns are not read.
    """
    if not 1 <= entries <= NO_ENTRY:
        raise ValueError(f"entries must be between 1 and {NO_ENTRY}")
    spark = vectors.sparkSession
    label_type = dict(vectors.select(F.col(label_col).alias("label")).dtypes)["label"]
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    ).where(usable(F.col("vector"), parts))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    kept = ["vec_id", "label"]
    head = f"vec_id bigint, label {label_type}, "
    if not first:
        nothing = rows.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        return nothing, np.zeros((parts, 0, 0), np.int64)
    size = len(first[0]["vector"])
    same = [r["vector"] for r in first if len(r["vector"]) == size]
    if len(same) < len(first):
        same = [r["vector"] for r in rows.where(F.size("vector") == size).orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()]
    rows, width = rows.where(F.size("vector") == size), size // parts
    books = integers(np.array(same)).reshape(len(same), parts, width).transpose(1, 0, 2).copy()
    count = books.shape[1]
    moves, read_b, write_b = None, None, [min(FIRST_B, max(1, count - 1))] * parts
    for number in range(rounds):
        with batches_of(spark, BATCH):
            state = stored(rows.mapInArrow(_pass(books, moves, read_b, write_b, False, kept), head + STATE), f"codes-{number}")
        totals = state.where("stats is not null").select(F.posexplode("stats").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
        stats = np.zeros(parts * (count * (width + 1) + count + 1), np.int64)
        for r in totals.collect():
            stats[r["at"]] = r["n"]
        stats = stats.reshape(parts, -1)
        sums = stats[:, : count * (width + 1)].reshape(parts, count, width + 1)
        used = sums[:, :, :1] > 0
        after = np.where(used, sums[:, :, 1:] // np.maximum(sums[:, :, :1], 1), books)
        moved = ((after - books) ** 2).sum(axis=2)
        moves, books = root(moved) + (root(moved) ** 2 < moved), after
        read_b = write_b
        if number:  # the first pass has no bounds yet
            write_b = [_next_b(stats[p, count * (width + 1) :], read_b[p], count) for p in range(parts)]
        rows = state.where("stats is null")
    with batches_of(spark, BATCH):
        last = rows.mapInArrow(_pass(books, moves, read_b, write_b, True, kept), head + "code binary, error bigint")
        return stored(last, "codes"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
