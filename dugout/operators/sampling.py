"""Deterministic sampling without a global sort: the rows of least hash, exactly so many a group.

``md5(key-seed)`` orders the rows. Counts by a growing prefix of the hash find, group by group, the prefix in
which the wanted number is reached; whole prefixes below it are taken, and only the boundary prefix (a few
rows) is ranked. A group may hold a third of all rows or more; none is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.operators.relational import q
from dugout.session import cut

#: Hex digits added to the prefix on each level.
DIGITS = (3, 6)


def hash_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(q(key).cast("string"), F.lit(f"-{seed}")))


def mark_lowest(df: DataFrame, group: str, key: str, want: DataFrame, seed: int = 42, out: str = "chosen") -> DataFrame:
    """``df`` with a boolean: whether the row is among the ``want`` (group, k) least hashes of its group. Rows of groups
    not wanted are false; of equal hashes the smaller key comes first."""
    d = df.withColumn("_h", hash_key(key, seed)).withColumn("_g", q(group))
    at = want.select(q(group).alias("_g"), F.col("k").cast("long").alias("_left"), F.lit("").alias("_b"))
    for n in DIGITS:
        p = F.substring("_h", 1, n)
        near = d.join(at.select("_g", "_b"), "_g").where(F.col("_h").startswith(F.col("_b")))
        hist = near.groupBy("_g", p.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy("_g").orderBy("_p")  # at most 16^3 rows a group
        cum = hist.withColumn("_u", F.sum("_n").over(w)).join(at, "_g").where("_u > _left")
        nxt = cum.groupBy("_g").agg(F.min_by(F.struct(F.col("_p").alias("b"), (F.col("_left") - (F.col("_u") - F.col("_n"))).alias("left")), "_p").alias("m"))
        full = at.join(nxt, "_g", "left")
        # a group that is wanted whole has no boundary: everything is below "g"
        at = cut(full.select("_g", F.coalesce("m.b", F.lit("g")).alias("_b"), F.coalesce("m.left", F.lit(0).cast("long")).alias("_left")))
    edge = d.join(at, "_g").where(F.col("_h").startswith(F.col("_b"))).select("_g", "_h", q(key).alias("_k"), "_left").distinct()
    ranked = edge.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy("_h", "_k"))).where("_r <= _left").select("_g", F.col("_k").alias("_key"), F.lit(True).alias("_in"))
    b = at.select("_g", "_b")
    j = d.join(b, "_g", "left").join(ranked.withColumnRenamed("_g", "_g2"), (F.col("_g") == F.col("_g2")) & (q(key) == F.col("_key")), "left")
    return j.withColumn(out, F.coalesce((F.substring("_h", 1, DIGITS[-1]) < F.col("_b")) | F.coalesce("_in", F.lit(False)), F.lit(False))).drop(
        "_h", "_g", "_b", "_g2", "_key", "_in")


def split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``is_test`` for ceil(share x n) rows."""
    d = df.withColumn("_all", F.lit(1))
    want = d.groupBy("_all").agg(F.ceil(F.count(F.lit(1)) * test_share).alias("k"))
    return mark_lowest(d, "_all", key, want, seed, "is_test").drop("_all")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``is_test`` for ceil(share x n) rows of each label."""
    want = df.groupBy(q(label).alias(label)).agg(F.ceil(F.count(F.lit(1)) * test_share).alias("k"))
    return mark_lowest(df, label, key, want, seed, "is_test")


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each label as the rarest has, without replacement."""
    n = cut(df.groupBy(q(label).alias(label)).agg(F.count(F.lit(1)).alias("n")))
    least = n.agg(F.min("n")).first()[0] or 0
    return mark_lowest(df, label, key, n.select(label, F.lit(least).alias("k")), seed).where("chosen").drop("chosen")
