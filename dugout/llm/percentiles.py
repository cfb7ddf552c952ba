"""Percentiles of very large numeric columns by radix selection.

A float is mapped to an unsigned 64-bit integer whose order is the float's order. Level by level a
histogram counts the next digit (``BITS`` bits) of the values still in play, and only the digit that
holds a target rank is followed. A histogram holds at most 2^BITS rows a group, whatever the data,
combines on the map side and adds up across slices, so partitions, days or machines can be counted
apart and merged. After the last level the percentile is exact; stopped earlier, the width of the
digit reached is the stated error.

Defined results: null, NaN and infinite values are not usable and are left out before (see
``usable``), as are rows whose group is null; a percentile ``q`` of n values is the value of rank
``ceil(q n)`` (the least value with at least a share q at or below it), ties and repeated rows each
counting; a group without usable values has no row; an empty table gives an empty result; -0.0 and 0.0 are one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.session import cut

#: Bits of a digit and levels: 4 x 16 bits make a double exactly.
BITS, LEVELS = 16, 4


def usable(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """(g, v) of rows with a group and a finite value."""
    v = value.cast("double")
    return df.select(group.alias("g"), v.alias("v")).where(
        F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))))


def order_key(v: Column) -> Column:
    """A long whose signed order is the order of the double: the bits of the number, negative ones flipped."""
    # Spark has no cast from a double to its bits; sign, exponent and mantissa are taken apart by arithmetic that is exact
    # in floating point, and stays in generated code.
    a = F.abs(v + F.lit(0.0))
    e = F.greatest(F.floor(F.log2(a)), F.lit(-1022)).cast("int")
    e = F.when(a >= F.pow(F.lit(2.0), e + 1), e + 1).when((a < F.pow(F.lit(2.0), e)) & (e > -1022), e - 1).otherwise(e)
    sub = a < F.lit(2.2250738585072014e-308)
    mant = F.when(sub, a * F.pow(F.lit(2.0), F.lit(537.0)) * F.pow(F.lit(2.0), F.lit(537.0))).otherwise(
        (a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(2**52)))
    expo = F.when(sub, F.lit(0)).otherwise(e + 1023).cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).otherwise(F.shiftleft(expo, 52) + mant.cast("long"))
    return F.when(v < 0, -bits).otherwise(bits)


def key_value(k: Column) -> Column:
    """The double of an :func:`order_key`."""
    a = F.abs(k)
    expo, mant = F.shiftright(a, 52), a.bitwiseAND(F.lit((1 << 52) - 1))
    big = F.pow(F.lit(2.0), (expo - 1023).cast("double")) * (1 + mant / F.lit(float(2**52)))
    small = mant.cast("double") * F.pow(F.lit(2.0), F.lit(-537.0)) * F.pow(F.lit(2.0), F.lit(-537.0))
    x = F.when(expo == 0, small).otherwise(big)
    return F.when(k < 0, -x).otherwise(x)


def digit_of(k: Column, level: int, bits: int = BITS, levels: int = LEVELS) -> Column:
    """The digit of a key at a level, 0 the highest; the top digit keeps the sign, so that it orders as the key does."""
    shift = bits * (levels - 1 - level)
    d = F.shiftright(k, shift)
    return d if level == 0 else d.bitwiseAND(F.lit((1 << bits) - 1))


def histogram(keys: DataFrame, level: int, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """(g, prefix, digit, n) of (g, prefix, k): the mergeable state of one level."""
    return keys.groupBy("g", "prefix", digit_of(F.col("k"), level, bits, levels).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


def merge(states: list[DataFrame]) -> DataFrame:
    """The state of the whole from the states of slices."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("g", "prefix", "digit").agg(F.sum("n").alias("n"))


def follow(state: DataFrame, targets: DataFrame) -> DataFrame:
    """The digit that holds each target: (g, prefix, q, rank) to (g, prefix, q, digit, rank within the digit, n)."""
    # one group's histogram has at most 2^bits rows, so this window is bounded whatever the data
    w = Window.partitionBy("g", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = state.withColumn("upto", F.sum("n").over(w))
    return targets.join(cum, ["g", "prefix"]).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select(
        "g", "prefix", "q", "digit", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), F.col("n").alias("in_digit"), "total")


def percentiles(slices: list[DataFrame], qs: list[float], bits: int = BITS, depth: int = LEVELS) -> DataFrame:
    """(g, q, total, value, error) over all ``slices`` of (g, v), each counted apart and merged level by level.

    ``depth`` levels are followed: with all of them the error is 0, else it is at most the width of the digit reached."""
    levels = 64 // bits
    keyed = [s.select("g", order_key(F.col("v")).alias("k"), F.lit("").alias("prefix")) for s in slices]
    state = cut(merge([histogram(k, 0, bits, levels) for k in keyed]))
    sizes = state.groupBy("g").agg(F.sum("n").alias("total"))
    q = F.explode(F.array(*[F.lit(float(x)) for x in qs]))
    targets = sizes.select("g", "total", q.alias("q")).select(
        "g", F.lit("").alias("prefix"), "q", "total", F.greatest(F.lit(1), F.least(F.col("total"), F.ceil(F.round(F.col("q") * F.col("total"), 9)))).cast("long").alias("rank"))
    at = cut(follow(state, targets).withColumn("k", F.shiftleft(F.col("digit").cast("long"), bits * (levels - 1))))
    for level in range(1, min(depth, levels)):
        # the digits followed: groups x percentiles rows; AQE broadcasts them while they are small
        alive = at.select("g", F.col("k").alias("p")).distinct()
        top = F.expr(f"shiftleft(shiftright(k, {bits * (levels - level)}), {bits * (levels - level)})")
        kept = [s.withColumn("p", top).join(alive, ["g", "p"]).select("g", F.col("p").cast("string").alias("prefix"), "k") for s in keyed]
        state = cut(merge([histogram(k, level, bits, levels) for k in kept]))
        aim = at.select("g", F.col("k").cast("string").alias("prefix"), "q", "rank", "total", F.col("k").alias("p"))
        nxt = follow(state, aim.drop("p"))
        at = cut(nxt.withColumn("k", F.col("prefix").cast("long") + F.shiftleft(F.col("digit").cast("long"), bits * (levels - 1 - level))))
    left = bits * (levels - min(depth, levels))
    width = F.lit((1 << left) - 1).cast("long") if left else F.lit(0).cast("long")
    # a digit reached holds the keys k .. k + width
    return at.select("g", "q", "total", key_value(F.col("k")).alias("value"), (key_value(F.col("k") + width) - key_value(F.col("k"))).alias("error"))
