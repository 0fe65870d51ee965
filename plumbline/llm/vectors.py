"""Near-duplicate groups of embeddings by PCA-ordered tiled comparison.

Vectors are turned into the axes of a principal component analysis, so the first
few carry most of a product. A grid over the two leading axes, one cell as wide
as the largest distance of a linked pair, says which cells can hold links; large
cells are dealt into tiles of bounded size, and tiles of neighbouring cells are
compared as matrices. A product is summed from the leading axes on; what is left
is at most the product of the suffix norms, and a pair is dropped as soon as it
cannot reach the threshold. What remains is confirmed on the vectors themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batches_of, connected, stored

THRESHOLD = 0.98
#: Vectors the axes are fitted on; they only decide how early pairs are dropped.
FIT_ROWS = 10_000
#: Vectors of a tile, about.
TILE = 1_024
#: Axes summed before each bound.
STEPS = [8, 16, 32, 64, 128, 256, 512, 1024]
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def axes(rows: np.ndarray) -> np.ndarray:
    """Orthogonal matrix whose columns are the principal axes of unit ``rows``, strongest first."""
    values, columns = np.linalg.eigh(rows.T @ rows)
    return columns[:, np.argsort(-values, kind="stable")]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows over their norms; scaled by the largest component first, so nothing over- or underflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def linked(a: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``a`` and ``b`` with cosine at or over the threshold (``same``: each pair once)."""
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ turn, ub @ turn
    rest = lambda r, k: np.sqrt(np.maximum((r[:, k:] ** 2).sum(axis=1), 0))
    ends = sorted({min(k, ra.shape[1]) for k in STEPS} | {ra.shape[1]})
    first = ends[0]
    total = ra[:, :first] @ rb[:, :first].T
    can = total + rest(ra, first)[:, None] * rest(rb, first)[None, :] >= threshold - SLACK
    i, j = np.nonzero(np.triu(can, 1) if same else can)
    sums, before = total[i, j], first
    for end in ends[1:]:
        sums = sums + np.einsum("ij,ij->i", ra[i, before:end], rb[j, before:end])
        can = sums + rest(ra, end)[i] * rest(rb, end)[j] >= threshold - SLACK
        i, j, sums, before = i[can], j[can], sums[can], end
    sure = np.einsum("ij,ij->i", ua[i], ub[j]) >= threshold
    return i[sure], j[sure]


def _compare(turns: dict[int, np.ndarray], threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
        width = len(rows["vector"][0])
        matrix = np.asarray(rows["vector"].combine_chunks().flatten()).astype(float).reshape(-1, width)
        turn = turns.get(width)
        turn = np.eye(width) if turn is None else turn
        one, two = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
        same = bool((side == 0).all())
        i, j = linked(matrix[one], matrix[two], turn, threshold, same)
        i, j = one[i], two[j]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        low = ids.copy()
        while True:  # smallest id reachable inside this pair of tiles
            before = low.copy()
            least = np.minimum(low[i], low[j])
            np.minimum.at(low, i, least)
            np.minimum.at(low, j, least)
            if (before == low).all():
                break
        met = np.flatnonzero(links > 0)
        return pa.table({"id": ids[met], "low": low[met], "links": links[met].astype(np.int64)})

    return run


def groups(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Two rows are linked if their labels are equal and not null, their vectors have
    the same length, and the cosine in double precision reaches ``threshold``
    (above 0). Null, empty and zero vectors and vectors with a null or non-finite
    component link with nothing, as do rows without an id, whose component is null
    and which are not kept. Equal vectors are compared once and counted as often
    as they occur; rows that repeat an id count as rows.
    """
    spark = vectors.sparkSession
    given = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")
    )
    sound = given.where(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    apart = stored(
        sound.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("width", F.size("vector")),
        "vectors",
    )
    share = min(1.0, FIT_ROWS / max(1, apart.count()))
    seen = apart.where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1 << 30)) < int(share * (1 << 30))).select("width", "vector").collect()
    by_width: dict[int, list] = {}
    for row in seen:
        by_width.setdefault(row["width"], []).append(row["vector"])
    turns = {width: axes(unit(np.array(rows, float))) for width, rows in by_width.items()}
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def placed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.zeros((batch.num_rows, 2), np.int64)
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                rows = np.array([batch.column("vector")[i].as_py() for i in own], float)
                turn = turns[width][:, :2] if width in turns else np.eye(width)[:, :2]
                found = np.floor(unit(rows) @ turn / reach).astype(np.int64)
                cells[own[:, None], np.arange(found.shape[1])] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells[:, 0]), pa.array(cells[:, 1])], names=[*batch.schema.names, "x", "y"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in apart.schema) + ", x long, y long"
    with batches_of(spark, 2048):
        apart = stored(apart.mapInArrow(placed, schema), "cells")
    key = ["label", "width", "x", "y"]
    cells = stored(apart.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")), "tiles")
    # A cell meets itself and four neighbours; the other four meet it.
    ways = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]])
    other = cells.select("label", "width", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("tiles").alias("tiles2"))
    met = (
        cells.withColumn("way", F.explode(ways))
        .withColumns({"x2": F.col("x") + F.col("way.dx"), "y2": F.col("y") + F.col("way.dy")})
        .join(other, ["label", "width", "x2", "y2"])
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("tiles2") - 1)))
        .withColumn("self", (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")))
        .where("not self or t <= t2")
        .withColumn("pair", F.xxhash64("label", "width", "x", "y", "t", "x2", "y2", "t2"))
    )
    whole = F.col("self") & (F.col("t") == F.col("t2"))
    ends = F.array(
        F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.col("t").alias("t"), F.when(whole, 0).otherwise(1).alias("side")),
        F.when(~whole, F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("t2").alias("t"), F.lit(2).alias("side"))),
    )
    homes = met.select("label", "width", "pair", F.explode(ends).alias("e")).where("e is not null").select("label", "width", "e.*", "pair")
    dealt = apart.join(cells, key).withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    members = dealt.join(stored(homes, "homes"), [*key, "t"]).select("label", "pair", "side", "id", "copies", "vector")
    # The label is part of the key, so a collision of pair hashes meets nothing of another label.
    found = stored(members.groupBy("label", "pair").applyInArrow(_compare(turns, threshold), "id long, low long, links long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected(found.select(F.col("id").alias("src"), F.col("low").alias("dst")))
    named = apart.join(counts, "id", "left").join(component, "id", "left").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component")
    )
    joined = sound.join(stored(named, "named"), ["label", "vector"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    lone = given.where(~(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()))
    return joined.union(lone.select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
