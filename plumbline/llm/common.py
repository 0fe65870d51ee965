"""Helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_folder

#: Bytes of text one Python step works on at a time.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand Python workers at most ``rows`` rows at once in the jobs run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def mapped(df: DataFrame, fn: Callable, schema: str, name: str, rows: int = 1024) -> DataFrame:
    """``df.mapInArrow(fn)`` as a written table."""
    with batches_of(df.sparkSession, rows):
        return stored(df.mapInArrow(fn, schema), name)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes in ``column`` (one row at least)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start, rows = 0, batch.num_rows
    while start < rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text: offsets per text, word numbers, distinct words.

    Null counts as empty. ``lower`` lowers A-Z only.
    """
    if texts.offset:  # the kernels below misread arrays that do not start at 0
        texts = texts.take(pa.array(range(len(texts)), pa.int64()))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    ends = np.asarray(words.offsets) - words.offsets[0].as_py()
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    empty = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py()
    if empty >= 0:  # left over at the ends of a text
        full = codes != empty
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        codes = codes[full]
    return ends.astype(np.int64), codes, distinct


def word_hashes(words: list[str], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of an unsigned 64-bit value over all others."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` word hashes, in order."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, width, np.uint64)
    for place in range(width):
        total = mix(total ^ hashes[place : place + count]) + np.uint64(place + 1)
    return mix(total)


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable id of every node: (id, component), from undirected edges (src, dst).

    Alternates large-star and small-star steps: every node hangs its larger
    neighbours, then its smaller ones, on its smallest neighbour until nothing
    moves. Each step aggregates before it joins, so a node with very many
    neighbours is split like any skewed join key, and each round is one written
    table, whose count and checksum are observed as it is written. Null ends and
    loops are dropped; an empty input gives no rows.
    """
    links = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    links = links.where("src is not null and dst is not null and src <> dst")
    seen = None
    while True:
        both = links.union(links.select("dst", "src"))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = (
            large.join(low, "src")
            .where("dst <> low")
            .select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            .union(low.select("src", F.col("low").alias("dst")))
            .distinct()
        )
        watch = Observation()
        marks = F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("sum")
        links = stored(small.observe(watch, *marks), name)
        if watch.get == seen:
            break
        seen = watch.get
    found = links.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return found.union(links.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
