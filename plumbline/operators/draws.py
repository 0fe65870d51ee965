"""Draws with replacement as counts per distinct value.

Drawing n times from a group only matters through how often each distinct value
comes up. Those counts follow a multinomial law, which is a chain of binomials:
each value takes its share of the draws the values before it left over. A
binomial is read off its distribution at a hash, so no draw is ever a row and
the work does not grow with n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.basics import hash48, let
from plumbline.operators.scale import match

#: Distinct values up to which a key is one chain.
LEAF = 64
#: Expected successes up to which a binomial is inverted exactly.
EXACT = 256
GRID = float(1 << 48)


def _inverted(n: Column, p: Column, u: Column) -> Column:
    """How many values of the distribution function of Bin(n, p) are at most ``u``, for small n * p."""
    most = F.least(n * p, F.lit(float(EXACT)))
    last = F.least(n.cast("double"), F.ceil(most + 10 * F.sqrt(most) + 10).cast("double")).cast("int")
    start = F.struct(F.pow(1 - p, n).alias("mass"), F.lit(0.0).alias("below"), F.lit(0).cast("bigint").alias("x"))

    def step(s: Column, y: Column) -> Column:
        below = s["below"] + s["mass"]
        mass = s["mass"] * ((n - y).cast("double") / (y + 1)) * (p / (1 - p))
        return F.struct(mass.alias("mass"), below.alias("below"), (s["x"] + (u >= below).cast("bigint")).alias("x"))

    return F.least(n, F.aggregate(F.sequence(F.lit(0), last), start, step, lambda s: s["x"]))


def _spread(n: Column, p: Column, u: Column, turn: Column) -> Column:
    """Bin(n, p) for large n * p: a normal number, corrected for skewness."""
    z = F.sqrt(-2 * F.ln((u * GRID + 0.5) / GRID)) * F.cos(2 * F.pi() * turn)
    x = n * p + F.sqrt(n * p * (1 - p)) * z + (1 - 2 * p) * (z * z - 1) / 6
    return F.greatest(F.lit(0).cast("bigint"), F.least(n, F.floor(x + 0.5)))


def binomial(n: Column, p: Column, u: Column, turn: Column) -> Column:
    """A draw from Bin(n, p) fixed by two uniform numbers; ``turn`` is only read when n * p is large.

    The rarer outcome is counted. Up to ``EXACT`` expected ones it is the inverse
    of the distribution function at ``u``, beyond that a normal number with the
    right mean, variance and skewness, off by less than one in expectation.
    """

    def rare(q: Column) -> Column:
        return F.when(n * q <= EXACT, _inverted(n, q, u)).otherwise(_spread(n, q, u, turn))

    either = let(F.least(p, 1 - p), rare)
    return let(either, lambda x: F.when(p <= 0.5, x).otherwise(n - x))


def _chain(children: Column, n: Column, prefix: Column, item: str) -> Column:
    """``array<struct<at, x>>``: the children (at, c) that get some of ``n`` draws, and how many."""
    total = F.aggregate(children, F.lit(0.0), lambda s, x: s + x["c"])
    none = F.array().cast(item)
    start = F.struct(n.alias("left"), total.alias("rest"), F.lit(0).alias("i"), none.alias("out"))

    def step(s: Column, child: Column) -> Column:
        def taken(x: Column) -> Column:
            more = F.array_append(s["out"], F.struct(child["at"].alias("at"), x.alias("x")))
            return F.struct(
                (s["left"] - x).alias("left"),
                (s["rest"] - child["c"]).alias("rest"),
                (s["i"] + 1).alias("i"),
                F.when(x > 0, more).otherwise(s["out"]).alias("out"),
            )

        digits = [hash48(prefix, s["i"], *extra) / GRID for extra in ([], [F.lit("turn")])]
        # Rests of fractional weights round; the last child takes what is left.
        share = F.when(s["i"] + 1 == F.size(children), 1.0).otherwise(child["c"] / s["rest"])
        chosen = let(digits[0], lambda u: let(share, lambda p: binomial(s["left"], p, u, digits[1])))
        return let(F.when(s["left"] > 0, chosen).otherwise(F.lit(0).cast("bigint")), taken)

    return F.aggregate(children, start, step, lambda s: s["out"])


def multinomial(values: DataFrame, requests: DataFrame, keys: list[str], value: str, count: str = "n", seed: int = 42) -> DataFrame:
    """``(request columns but count, value, x)``: values drawn ``x > 0`` times.

    ``values`` holds (keys, value, c), each value once per key with its weight,
    a count or any positive number; ``requests`` asks for ``count`` draws of a key,
    its other columns naming the request. NULL keys and values count like any other.
    A request for a key without values, or for no draws, gives nothing. The uniform
    numbers are ``hash48(request columns, level, node, seed, place)``, places
    following the values in ascending order, so they are the same on any engine.

    The values of a key are one chain as long as no key has more than ``LEAF``.
    Otherwise they are dealt by hash to as many leaves as a leaf then has values, so
    a request first draws counts per leaf and only visits those that got some; no
    array holds more than about the square root of a key's values.
    """
    names = [c for c in requests.columns if c != count]
    kind = dict(values.dtypes)[value]
    most = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    leaves = F.when(most > LEAF, F.ceil(F.sqrt(most))).otherwise(1).cast("bigint")
    child = F.struct(F.col(value).alias("at"), F.col("c").cast("double").alias("c"))
    bottom = values.groupBy(*keys, F.pmod(F.xxhash64(value), leaves).alias("__node")).agg(F.sort_array(F.collect_list(child)).alias("__children"))
    weight = F.aggregate("__children", F.lit(0.0), lambda s, x: s + x["c"]).alias("c")
    weights = bottom.select(*keys, F.struct(F.col("__node").alias("at"), weight).alias("__child"))
    top = weights.groupBy(*keys).agg(F.sort_array(F.collect_list("__child")).alias("__children"))

    def prefix(level: int, node: Column) -> Column:
        # NULL names leave no mark in a digest, as in the SQL function of that kind.
        return F.concat_ws("|", *[F.col(c).cast("string") for c in names], F.lit(str(level)), node.cast("string"), F.lit(str(seed)))

    asked = match(requests.withColumn(count, F.col(count).cast("bigint")).where(F.col(count) > 0), top, keys)
    dealt = _chain(F.col("__children"), F.col(count), prefix(1, F.lit(0)), "array<struct<at:bigint,x:bigint>>")
    visits = asked.select(*names, F.inline(dealt)).withColumnsRenamed({"at": "__node", "x": count})
    found = _chain(F.col("__children"), F.col(count), prefix(0, F.col("__node")), f"array<struct<at:{kind},x:bigint>>")
    return match(visits, bottom, [*keys, "__node"]).select(*names, F.inline(found)).withColumnRenamed("at", value)
