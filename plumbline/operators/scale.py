"""Joins, running totals and recurrences that survive a hot key.

Every operator of the package that needs "the group's value on each row" or "a
total over everything before this row" goes through these helpers, so that one
key holding a third of the table never ends up in one task.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.functions.basics import let
from plumbline.session import shared_folder

HOT_SHARE = 1e-5
HOT_FLOOR = 1_000_000
#: Positions of a chunk, and of a block within it.
CHUNK, BLOCK = 1024, 32
ROWS_PER_BUCKET = 1_000_000
MAX_EDGES = 512
#: Numbers one pass of a selection may return.
CELLS = 4096


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what follows reads it instead of computing it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark removes the shuffle files of a job when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_in_turn(frames: Iterable[DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """Frames of one schema written one after the other into one table.

    The shuffle files of a frame are gone before the next one is computed, so they
    take no more disk than those of the largest frame.
    """
    path = shared_folder(spark, name)
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        for df in frames:
            df.write.mode("append").parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def ordered(df: DataFrame, order: list[str], name: str, out: str = "__bucket") -> DataFrame:
    """Written table with a bucket per row: consecutive ranges of rows in the order of the columns.

    Rows are range-partitioned by Spark's own sample, so buckets hold about as many
    rows however values repeat, as long as the columns together are nearly unique.
    The bucket is read back with the row, never derived twice.
    """
    return written(df.repartitionByRange(*order).withColumn(out, F.spark_partition_id()), name)


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, NULL being a key like any other, as it is for groupBy."""
    names = {k: f"__r_{k}" for k in keys}
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`")) for k, n in names.items()])
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def attach_group(
    rows: DataFrame,
    stats: DataFrame,
    keys: list[str],
    size: str,
    spread_by: list[str],
    hot_share: float = HOT_SHARE,
    hot_floor: int = HOT_FLOOR,
) -> DataFrame:
    """Left-join one-row-per-key ``stats`` back to ``rows``; NULL keys match.

    A task should get no more than ``max(hot_floor, hot_share * all rows)`` rows
    of one key. A key with more is hot: its rows are spread over as many salts as
    that takes, and its single stats row is repeated once per salt. There are at
    most ``1 / hot_share`` hot keys, whatever the table size, so their list may
    be broadcast.
    """
    total = stats.agg(F.sum(size).alias("n"))
    limit = F.greatest(F.lit(float(hot_floor)), total.scalar() * F.lit(hot_share))
    sized = stats.withColumn("__salts", F.greatest(F.ceil(F.col(size) / limit), F.lit(1)).cast("int"))
    hot = sized.where("__salts > 1").select(*keys, "__salts")
    spread = sized.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    salted = match(rows, F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("__salts")).cast("int"), F.lit(0))
    )
    return match(salted, spread, [*keys, "__salt"], "left").drop("__salts", "__salt")


def with_group_stats(
    rows: DataFrame, keys: list[str], aggs: list[Column], spread_by: list[str], **hot
) -> DataFrame:
    """Group aggregates on every row: partial aggregation, then a salted join."""
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"), *aggs)
    return attach_group(rows, stats, keys, "__size", spread_by, **hot).drop("__size")


def lookup(
    rows: DataFrame, table: DataFrame, keys: list[str], hot_share: float = HOT_SHARE, hot_floor: int = HOT_FLOOR
) -> DataFrame:
    """Left-join a table with unique keys to rows that may pile up on a key; NULL finds nothing.

    Hot keys are salted as in ``attach_group``; they are found from the keys alone,
    so the table's other columns move once.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    limit = F.greatest(F.lit(float(hot_floor)), sizes.agg(F.sum("__size").alias("n")).scalar() * F.lit(hot_share))
    hot = sizes.select(*keys, F.ceil(F.col("__size") / limit).cast("int").alias("__salts")).where("__salts > 1")
    spread_by = [c for c in rows.columns if c not in keys] or keys
    salted = match(rows, F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("__salts")).cast("int"), F.lit(0))
    )
    known = match(table.dropna("any", subset=keys), F.broadcast(hot), keys, "left")
    salts = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    spread = known.withColumn("__salt", F.explode(salts)).drop("__salts")
    return match(salted.drop("__salts"), spread, [*keys, "__salt"], "left").drop("__salt")


def lowest(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in the order of numeric columns, NULL first, as a plain filter.

    A histogram of the first column finds the cell with the n-th row, that cell is
    cut finer until its keys are all equal, and the next column goes on among them:
    a few narrow passes, each giving at most ``CELLS`` numbers. No row is sorted or
    moved. Only where rows agree in every column is it open which of them are taken.
    """
    kept, window, left = F.lit(False), F.lit(True), n
    if n <= 0:
        return df.where("false")
    for key in order:
        c = F.col(f"`{key}`")
        ends = [F.count(F.lit(1)).alias("n"), F.count(c).alias("known"), F.min(c).alias("lo"), F.max(c).alias("hi")]
        found = df.where(window).agg(*ends).first()
        if found.n <= left:
            return df.where(kept | window)
        if found.n - found.known >= left:
            window = window & c.isNull()
            continue
        kept, left = kept | (window & c.isNull()), left - (found.n - found.known)
        lo, hi = found.lo, found.hi
        while lo < hi:
            if isinstance(lo, int):
                cell = F.expr(f"(`{key}` - ({lo}L)) div {(hi - lo) // CELLS + 1}L")
            else:
                cell = F.least(F.floor((c - lo) / (hi - lo) * CELLS), F.lit(CELLS - 1))
            counts = df.where(window & c.between(lo, hi)).groupBy(cell.alias("at"))
            for part in sorted(counts.agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect()):
                if part.n >= left:
                    break
                left -= part.n
            lo, hi = part.lo, part.hi
            if part.n == left:
                return df.where(kept | (window & (c <= hi)))
        kept, window = kept | (window & (c < lo)), window & (c == lo)
    return df.where(kept).unionByName(df.where(window).limit(left))


def range_bucket(df: DataFrame, key: str, out: str = "__bucket", buckets: int | None = None) -> DataFrame:
    """Order-preserving bucket of a numeric key, sized by rows.

    Approximate quantiles cut the table into at most ``MAX_EDGES`` parts, the only
    numbers that come back to the driver. A larger table cuts each part evenly
    once more, so that a bucket has about ``ROWS_PER_BUCKET`` rows at any size.
    Rows with the same key share a bucket, so the key should be (nearly) unique.
    """
    numeric = df.withColumn("__key", F.col(key).cast("double"))
    parts = buckets or MAX_EDGES
    probs = [i / parts for i in range(1, parts)]
    found = numeric.agg(
        F.count("__key").alias("n"), F.min("__key").alias("lo"), F.max("__key").alias("hi"), F.percentile_approx("__key", probs or [0.5], 4 * parts).alias("cuts")
    ).first()
    wanted = buckets or max(2, -(-found["n"] // ROWS_PER_BUCKET))
    step = max(1, parts // min(parts, wanted))
    edges = sorted({e for e in (found["cuts"] or [])[step - 1 :: step] if e < found["hi"]}) if parts > 1 else []
    finer = -(-wanted // parts)
    if not edges:
        return df.withColumn(out, F.lit(0.0))
    splits = [-float("inf"), *edges, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="__key", outputCol=out, handleInvalid="keep").transform(numeric)
    if finer > 1:
        low, high = [found["lo"], *edges], [*edges, found["hi"]]
        at = lambda ends: F.get(F.array(*[F.lit(float(e)) for e in ends]), F.col(out).cast("int"))
        share = (F.col("__key") - at(low)) / F.nullif(at(high) - at(low), F.lit(0.0))
        inner = F.least(F.lit(finer - 1), F.greatest(F.lit(0), F.floor(share * finer)))
        cut = cut.withColumn(out, F.col(out) + F.coalesce(inner, F.lit(0)) / F.lit(float(finer)))
    return cut.drop("__key")


def running_sum(
    df: DataFrame,
    keys: list[str],
    bucket: str,
    order: list[Column],
    values: dict[str, str],
    descending: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Running totals within ``keys`` along an order-preserving ``bucket``.

    Bucket totals are summed first and turned into offsets (one row per key and
    bucket); the remaining window only ever sees one bucket of one key.
    """
    direction = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = W.partitionBy(*keys).orderBy(direction).rowsBetween(W.unboundedPreceding, -1)
    frame = (W.unboundedPreceding, W.currentRow) if inclusive else (W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(*frame)
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(v).alias(f"__t_{o}") for o, v in values.items()])
    offsets = totals.select(
        *keys, bucket, *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__o_{o}") for o in values]
    )
    joined = match(df, offsets, [*keys, bucket])
    for out, value in values.items():
        joined = joined.withColumn(out, F.col(f"__o_{out}") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return joined.drop(*[f"__o_{o}" for o in values])


def row_index(df: DataFrame, key: str, out: str = "row", buckets: int | None = None) -> DataFrame:
    """Dense 0-based position of each row in the order of a unique numeric key."""
    cut = range_bucket(df, key, "__bucket", buckets).withColumn("__one", F.lit(1)).withColumn("__g", F.lit(0))
    numbered = running_sum(cut, ["__g"], "__bucket", [F.col(key)], {out: "__one"}, inclusive=False)
    return numbered.withColumn(out, F.col(out).cast("bigint")).drop("__bucket", "__one", "__g")


# One step of a recurrence from the right, on a main and a helper state:
#   helper' = ha * helper + hb
#   main'   = fa * main + fc * helper + fb
# Steps of this form compose into one of the same form.
MAP = ["__ha", "__hb", "__fa", "__fc", "__fb"]


def _compose(items) -> Column:
    """One step standing for a whole chunk, items being in right-to-left order."""
    start = F.struct(*[F.lit(1.0 if m in ("__ha", "__fa") else 0.0).alias(m) for m in MAP])

    def then(s: Column, x: Column) -> Column:
        return F.struct(
            (x["__ha"] * s["__ha"]).alias("__ha"),
            (x["__ha"] * s["__hb"] + x["__hb"]).alias("__hb"),
            (x["__fa"] * s["__fa"]).alias("__fa"),
            (x["__fa"] * s["__fc"] + x["__fc"] * s["__ha"]).alias("__fc"),
            (x["__fa"] * s["__fb"] + x["__fc"] * s["__hb"] + x["__fb"]).alias("__fb"),
        )

    return F.aggregate(items, start, then)


def _after(step: Column, at: Column) -> Column:
    return F.struct(
        (step["__ha"] * at["h"] + step["__hb"]).alias("h"),
        (step["__fa"] * at["s"] + step["__fc"] * at["h"] + step["__fb"]).alias("s"),
    )


def _along(steps: Column, entering: Column, inclusive: bool) -> Column:
    """``STRUCT<h, s>`` after (or before) each of at most a block of steps."""
    nothing = F.array().cast("array<struct<h:double,s:double>>")
    start = F.struct(entering.alias("at"), nothing.alias("out"))

    def step(state: Column, x: Column) -> Column:
        after = _after(x, state["at"])
        return F.struct(after.alias("at"), F.array_append(state["out"], after if inclusive else state["at"]).alias("out"))

    return F.aggregate(steps, start, step, lambda s: s["out"])


def _states(items: str, carry: Column, inclusive: bool) -> Column:
    """``STRUCT<h, s>`` after (or before) each item, in right-to-left order.

    Two levels: items are cut into blocks, blocks fold into steps that give the
    state entering each block, and the blocks are solved from there, so no array
    ever grows beyond a block or the number of blocks.
    """
    entering = F.struct(F.coalesce(carry["h"], F.lit(0.0)).alias("h"), F.coalesce(carry["s"], F.lit(0.0)).alias("s"))
    starts = F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))

    def solved(blocks: Column) -> Column:
        folds = F.transform(blocks, _compose)
        return F.flatten(F.zip_with(blocks, _along(folds, entering, False), lambda block, at: _along(block, at, inclusive)))

    return let(F.transform(starts, lambda i: F.slice(items, i, BLOCK)), solved)


def _pack(df: DataFrame, groups: list[str], item: Column) -> DataFrame:
    return df.groupBy(*groups).agg(F.sort_array(F.collect_list(item), asc=False).alias("__t"))


def _carries(maps: DataFrame, keys: list[str], levels: int, chunk: int) -> DataFrame:
    """State that enters chunk ``__c`` from its right neighbour.

    ``maps`` holds the folded steps of all chunks but the leftmost. Sequences of
    one chunk do not occur in it, so for short sequences this is empty.
    """
    item = F.struct("__c", *MAP)
    if levels > 1:
        packed = _pack(maps.withColumn("__u", F.floor(F.col("__c") / chunk)), [*keys, "__u"], item)
        folded = packed.where("__u > 0").select(*keys, F.col("__u").alias("__c"), _compose("__t").alias("__f"))
        entering = _carries(folded.select(*keys, "__c", "__f.*"), keys, levels - 1, chunk)
        packed = match(packed, entering.withColumnRenamed("__c", "__u"), [*keys, "__u"], "left")
        carry = F.col("__carry")
    else:
        packed = _pack(maps, keys, item)
        carry = F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("s"))
    solved = packed.withColumn("__s", _states("__t", carry, inclusive=True))
    both = solved.select(*keys, F.explode(F.arrays_zip("__t", "__s")).alias("__z"))
    return both.select(*keys, (F.col("__z.__t.__c") - 1).alias("__c"), F.col("__z.__s").alias("__carry"))


def backward_scan(
    df: DataFrame,
    keys: list[str],
    pos: str,
    factor: Column,
    addend: Column,
    out: str,
    inclusive: bool = True,
    cross: Column | None = None,
    helper_factor: Column | None = None,
    helper_addend: Column | None = None,
    chunk: int = CHUNK,
    levels: int = 2,
) -> DataFrame:
    """Linear recurrence ``s[t] = factor[t] * s[t+1] + addend[t]`` from the right.

    With a helper, ``h[t] = helper_factor[t] * h[t+1] + helper_addend[t]`` and
    ``s[t]`` also gets ``cross[t] * h[t+1]``. Steps compose, so a sequence is cut
    into chunks of ``chunk`` positions: each chunk folds into one step, the
    folded steps give the state entering each chunk, and the chunks are then
    solved side by side. No row holds more than ``chunk`` tokens of a sequence.
    ``df`` is read once, into a table of steps, and the result is a table as well.
    ``inclusive=False`` returns ``s[t+1]``.
    """
    columns = [c for c in df.columns if c not in keys]
    steps = [helper_factor, helper_addend, factor, cross, addend]
    named = [(F.lit(0.0) if c is None else c).cast("double").alias(m) for m, c in zip(MAP, steps, strict=True)]
    work = df.select(*df.columns, *named, F.floor(F.col(pos) / chunk).alias("__c"))
    work = written(work, "steps")
    beyond = _pack(work.where("__c > 0"), [*keys, "__c"], F.struct(F.col(pos).alias("__p"), *MAP))
    folded = beyond.select(*keys, "__c", _compose("__t").alias("__f")).select(*keys, "__c", "__f.*")
    packed = _pack(work, [*keys, "__c"], F.struct(F.col(pos).alias("__p"), *MAP, F.struct(*columns).alias("__row")))
    entered = match(packed, _carries(folded, keys, levels, chunk), [*keys, "__c"], "left")
    solved = entered.withColumn("__s", _states("__t", F.col("__carry"), inclusive))
    tokens = solved.select(*keys, F.explode(F.arrays_zip("__t", "__s")).alias("__z"))
    states = [F.col(f"__z.__t.__row.`{c}`").alias(c) for c in columns]
    return written(tokens.select(*keys, *states, F.col("__z.__s.s").alias(out)), "states")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
