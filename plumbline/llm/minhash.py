"""Near-duplicate groups of documents by fast similarity sketching.

A sketch has 128 coordinates. Round after round every shingle is hashed into a
bin, in the first 128 rounds a random one and after that bin 0, 1, 2, ... for
all; a coordinate keeps the smallest value of the first round that reached it.
So every coordinate is filled, most documents need one or two rounds, and the
share of equal coordinates is concentrated around the Jaccard similarity.

Bands of four coordinates name buckets. In each bucket a pivot is compared with
the other members, which joins most of a large group in one step; what is still
apart in a bucket is compared in tiles of bounded size. Every link is confirmed on
whole shingle sets (64-bit hashes of the shingles).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import connected, mapped, mix, shingle_hashes, slices, split_words, stored, word_hashes

WIDTH = 5
COORDINATES = 128
#: Rows of a band. 32 bands of 4 miss a pair of similarity 0.75 once in 190,000 times.
ROWS = 4
#: Bits kept of each coordinate to estimate a pair without its sets.
PLANES = 4
#: Pairs of which fewer of the 128 cut coordinates agree are not looked at: at
#: similarity 0.75 the count has mean 98 and deviation 4.8.
LEAST_AGREEING = 64
#: Documents of a tile, about; members from which a component has its own tiles; shingles multiplied at once.
TILE, LARGE, COLUMNS = 256, 64, 8_192

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
BITS = [f"bits{i}" for i in range(PLANES * COORDINATES // 64)]
SKETCH_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))]
    + [(b, pa.int64()) for b in BITS]
)
SKETCH_DDL = "doc_id long, n_shingles long, set_key binary, bands array<long>, " + ", ".join(f"{b} long" for b in BITS)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; short texts are one shingle, empty ones none."""
    ends, codes, words = split_words(texts, lower=True)
    hashes = word_hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)
    sets = []
    for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
        own = hashes[start:end]
        sets.append(np.unique(shingle_hashes(own, min(width, len(own)))) if len(own) else own)
    return sets


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Fast similarity sketches, one row of 128 values per non-empty set."""
    out = np.full((len(sets), COORDINATES), EMPTY)
    sizes = np.array([len(s) for s in sets], np.int64)
    items = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for step in range(2 * COORDINATES):
        if not len(items):
            break
        hashed = mix(items + np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        bins = hashed >> np.uint64(57) if step < COORDINATES else np.full(len(items), step - COORDINATES, np.uint64)
        values = mix(hashed) >> np.uint64(1)
        filled = np.full(out.size, EMPTY)
        np.minimum.at(filled, owner * COORDINATES + bins.astype(np.int64), values)
        filled = filled.reshape(out.shape)
        out = np.where(out == EMPTY, filled, out)
        lacking = (out == EMPTY).any(axis=1)[owner]
        items, owner = items[lacking], owner[lacking]
    return out


def _bands(sketches: np.ndarray) -> np.ndarray:
    """One hash per band, with the band's number in it."""
    rows = sketches.reshape(len(sketches), COORDINATES // ROWS, ROWS)
    total = np.broadcast_to(np.arange(rows.shape[1], dtype=np.uint64), rows.shape[:2])
    for place in range(ROWS):
        total = mix(total ^ rows[:, :, place]) + np.uint64(place + 1)
    return mix(total).view(np.int64)


def _planes(sketches: np.ndarray) -> np.ndarray:
    """The lowest bits of all coordinates, 64 coordinates to a word."""
    planes = [np.packbits((sketches >> np.uint64(i) & np.uint64(1)).astype(np.uint8), axis=1) for i in range(PLANES)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            made = sketch([sets[i] for i in full])
            bands, planes = _bands(made).tolist(), _planes(made)
            rows = dict(zip(full, range(len(full))))
            bits = np.zeros((len(sets), len(BITS)), np.int64)
            bits[full] = planes
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([bands[rows[i]] if i in rows else [] for i in range(len(sets))], pa.list_(pa.int64())),
                    *[pa.array(bits[:, i]) for i in range(len(BITS))],
                ],
                schema=SKETCH_SCHEMA,
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"]
            )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (one, two) in enumerate(zip(batch.column("one"), batch.column("two"))):
            a, b = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
            if 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                keep.append(i)
        yield batch.select(["src", "dst"]).take(pa.array(keep, pa.int64()))


def _agreeing(a: str, b: str) -> Column:
    """How many of the cut coordinates agree."""
    half = COORDINATES // 64
    same = []
    for word in range(half):
        differ = [F.col(f"{a}.bits{p * half + word}").bitwiseXOR(F.col(f"{b}.bits{p * half + word}")) for p in range(PLANES)]
        same.append(F.lit(64) - F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), differ)))
    return reduce(lambda x, y: x + y, same)


def _intersections(one: list[np.ndarray], two: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``one[i]`` and ``two[j]``."""
    if len(i) <= 4 * (len(one) + len(two)):
        return np.array([len(np.intersect1d(one[a], two[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())], np.int64)
    values, place = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    rows = np.repeat(np.arange(len(one) + len(two)), [len(s) for s in [*one, *two]])
    total = np.zeros((len(one), len(two)), np.float32)
    order = np.argsort(place, kind="stable")
    place, rows = place[order], rows[order]
    for start in range(0, len(values), COLUMNS):
        a, b = np.searchsorted(place, [start, start + COLUMNS])
        held = np.zeros((len(one) + len(two), COLUMNS), np.float32)
        held[rows[a:b], place[a:b] - start] = 1
        total += held[: len(one)] @ held[len(one) :].T
    return total[i, j].astype(np.int64)


def _compare_tiles(rows: pa.Table) -> pa.Table:
    """Links between the documents of a pair of tiles, as edges to the smallest id met."""
    side, ids, known = (rows[c].to_numpy() for c in ("side", "doc_id", "component"))
    bits = np.column_stack([rows[b].to_numpy() for b in BITS])
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"].combine_chunks()]
    sizes = np.array([len(s) for s in sets])
    one, two = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
    half = COORDINATES // 64
    agree = np.zeros((len(one), len(two)), np.int64)
    for word in range(half):
        differ = np.zeros(agree.shape, np.int64)
        for plane in range(PLANES):
            column = bits[:, plane * half + word]
            differ |= column[one][:, None] ^ column[two][None, :]
        agree += 64 - np.bitwise_count(differ.view(np.uint64)).astype(np.int64)
    small, large = np.minimum(sizes[one][:, None], sizes[two][None, :]), np.maximum(sizes[one][:, None], sizes[two][None, :])
    open_ = (agree >= LEAST_AGREEING) & (100 * small >= 75 * large) & (known[one][:, None] != known[two][None, :])
    if (side == 0).all():
        open_ = np.triu(open_, 1)
    i, j = np.nonzero(open_)
    both = _intersections([sets[k] for k in one], [sets[k] for k in two], i, j)
    i, j = one[i], two[j]
    sure = 100 * both >= 75 * (sizes[i] + sizes[j] - both)
    i, j = i[sure], j[sure]
    low = ids.copy()
    while True:
        before, least = low.copy(), np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        if (before == low).all():
            break
    met = np.flatnonzero(low != ids)
    return pa.table({"src": ids[met], "dst": low[met]})


def _compared(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Every link between components of the buckets in ``rest``, in tiles of bounded size.

    Documents of a large component share tiles, others those of the largest
    component they meet in a bucket. Two tiles are compared once if some bucket
    holds documents of both.
    """
    docs = stored(rest.groupBy("doc_id").agg(F.min("component").alias("component"), *[F.first(b).alias(b) for b in BITS]), "members")
    sized = docs.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    tops = rest.select("key", "component").join(sized, "component").groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"))
    near = rest.select("key", "doc_id").join(tops, "key").groupBy("doc_id").agg(F.max("top")["component"].alias("by"))
    own = F.col("size") >= LARGE
    home = F.when(own, F.xxhash64(F.lit("own"), "component")).otherwise(F.xxhash64(F.lit("near"), "by"))
    docs = docs.join(sized, "component").join(near, "doc_id").select("doc_id", "component", *BITS, home.alias("home"), own.alias("pure"))
    full = docs.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("salts"))
    tile = F.xxhash64("home", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    docs = stored(docs.join(full, "home").select("doc_id", "component", *BITS, tile.alias("tile"), "pure"), "tiles")
    where = rest.select("key", "doc_id").join(docs.select("doc_id", "tile", "pure", "component"), "doc_id")
    spots = stored(where.select("key", "tile", F.when(F.col("pure"), F.col("component")).alias("only")).distinct(), "spots")
    a, b = spots.alias("a"), spots.alias("b")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.tile") <= F.col("b.tile")) & ~(F.coalesce(F.col("a.only") == F.col("b.only"), F.lit(False))))
    met = met.select(F.col("a.tile").alias("one"), F.col("b.tile").alias("two")).distinct().withColumn("pair", F.xxhash64("one", "two"))
    same = F.col("one") == F.col("two")
    ends = F.array(
        F.struct(F.col("one").alias("tile"), F.when(same, 0).otherwise(1).alias("side")),
        F.when(~same, F.struct(F.col("two").alias("tile"), F.lit(2).alias("side"))),
    )
    homes = stored(met.select("pair", F.explode(ends).alias("e")).where("e is not null").select("pair", "e.*"), "homes")
    rows = docs.drop("pure").join(sets, "doc_id").join(homes, "tile").select("pair", "side", "doc_id", "component", *BITS, "shingles")
    return stored(rows.groupBy("pair").applyInArrow(_compare_tiles, "src long, dst long"), "links")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``.

    Documents are linked at Jaccard similarity 0.75 or more of their sets of
    five-word shingles (words without ASCII white space, A-Z lowered; a shorter
    text is one shingle). ``component_id`` is the smallest id reachable by links.
    A null or wordless text has no shingles and links with nothing; a row with a
    null id links with nothing, has a null component and is not kept. Rows that
    repeat an id stand for one document whose texts all count.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = mapped(given, _sketches, SKETCH_DDL, "sketches")
    # Documents with equal sets are one; the smallest id speaks for them.
    whole = F.struct("doc_id", "bands", *BITS)
    speakers = stored(
        rows.where("doc_id is not null and n_shingles > 0").groupBy("set_key").agg(F.min(whole).alias("r")).select("set_key", "r.*"),
        "speakers",
    )
    buckets = speakers.select("doc_id", F.explode("bands").alias("key"), *BITS)
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    live = stored(buckets.join(shared, "key"), "buckets")
    texts = given.join(live.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = mapped(texts, _sets, "doc_id long, shingles binary", "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("doc_id").alias("src"), F.col("shingles").alias("one"))
        two = sets.select(F.col("doc_id").alias("dst"), F.col("shingles").alias("two"))
        full = pairs.distinct().join(one, "src").join(two, "dst").select("src", "dst", "one", "two")
        return mapped(full, _confirm, "src long, dst long", "links", rows=256)

    component: DataFrame | None = None

    def placed(members: DataFrame) -> DataFrame:
        if component is None:
            return members.withColumn("component", F.col("doc_id"))
        known = component.select(F.col("id").alias("doc_id"), "component")
        return members.join(known, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    def grown(links: DataFrame) -> DataFrame:
        known = links if component is None else links.union(component.select("id", "component"))
        return connected(known)

    members = placed(live)
    # Each bucket draws its own pivot, so a group that shares many buckets meets many of its members.
    draw = F.struct(F.xxhash64("doc_id", "key").alias("draw"), "doc_id", *BITS)
    pivots = members.groupBy("key").agg(F.min(draw).alias("p"))
    pairs = members.alias("m").join(pivots, "key").where("doc_id <> p.doc_id").where(_agreeing("m", "p") >= LEAST_AGREEING)
    component = grown(confirmed(pairs.select(F.least("p.doc_id", "m.doc_id").alias("src"), F.greatest("p.doc_id", "m.doc_id").alias("dst"))))
    members = placed(live)
    ends = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    rest = stored(members.join(ends.where("lo < hi").select("key"), "key"), "rest")
    component = grown(_compared(rest, sets))
    named = placed(speakers.select("set_key", "doc_id")).select("set_key", "component")
    return (
        rows.select("doc_id", "n_shingles", "set_key")
        .join(stored(named, "named"), "set_key", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
        .select("doc_id", "n_shingles", "component_id", "kept")
    )
