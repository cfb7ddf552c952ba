"""References to records that do not exist: orphan keys per table and period.

The references are pre-aggregated by (key, period), so that a key holding a third of all rows
is one row a period from there on. Keys with at least one ``1 / heavy_share`` of all references are heavy, so there are at most ``heavy_share``
of them, whatever the data; their (key, period) entries are broadcast to the target table, which is checked in place.
All other keys are tested by a shuffle anti-join that never sees a heavy key, and both orphan counts are united. Where
the orphan *rows* are wanted, they are attached in the same two ways.

Defined results: a null or blank key is no reference; keys compare without case and surrounding
white space; a null period matches no validity range, so its reference is an orphan with a null
period; repeated rows are reported each; an empty reference table gives no rows; an empty target
table makes every reference an orphan. Columns are addressed by expression, so further columns
with any names may be present on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.session import cut

#: Keys with at least one ``HEAVY_SHARE``-th of all references are heavy; so there are at most that many.
HEAVY_SHARE = 1000


def norm_key(c: Column) -> Column:
    """Lower case without surrounding white space; null if nothing is left."""
    t = F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(t != "", t)


def count_references(refs: DataFrame, key: Column, period: Column) -> DataFrame:
    """(key, period, n) of all references; combines on the map side."""
    return (
        refs.select(norm_key(key).alias("_key"), period.cast("int").alias("_period"))
        .where(F.col("_key").isNotNull())
        .groupBy("_key", "_period")
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def _orphans(refs: DataFrame, key: Column, period: Column, targets: DataFrame, target_key: Column,
             valid_from: Column | None, valid_to: Column | None, heavy_share: int) -> tuple[DataFrame, DataFrame]:
    """((_key, _period, _n, _heavy) of the references without a target, (_key) of the heavy keys)."""
    counted = cut(count_references(refs, key, period))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    heavy = cut(counted.groupBy("_key").agg(F.sum("_n").alias("_of_key")).where(F.col("_of_key") * heavy_share >= F.lit(total)).select("_key"))
    t = targets.select(
        norm_key(target_key).alias("_tkey"),
        (valid_from if valid_from is not None else F.lit(None)).cast("int").alias("_from"),
        (valid_to if valid_to is not None else F.lit(None)).cast("int").alias("_to"),
    ).where(F.col("_tkey").isNotNull())

    def holds(left: DataFrame, right: DataFrame) -> Column:
        on = left["_key"] == right["_tkey"]
        if valid_from is None:
            return on
        p = left["_period"]
        return on & F.coalesce((F.col("_from").isNull() | (F.col("_from") <= p)) & (F.col("_to").isNull() | (F.col("_to") >= p)), F.lit(False))

    # at most heavy_share keys in the periods that the data have
    hot = counted.join(F.broadcast(heavy), "_key", "left_semi")
    found = t.join(F.broadcast(hot), holds(hot, t)).select("_key", "_period").distinct().withColumnsRenamed({"_key": "_fkey", "_period": "_fperiod"})
    hot = hot.join(F.broadcast(found), (F.col("_key") == F.col("_fkey")) & F.col("_period").eqNullSafe(F.col("_fperiod")), "left_anti")
    cold = counted.join(F.broadcast(heavy), "_key", "left_anti")
    unique = t.distinct().hint("merge")
    cold = cold.join(unique, holds(cold, unique), "left_anti")
    return hot.withColumn("_heavy", F.lit(True)).unionByName(cold.withColumn("_heavy", F.lit(False))), heavy


def orphan_counts(refs: DataFrame, key: Column, period: Column, targets: DataFrame, target_key: Column,
                  valid_from: Column | None = None, valid_to: Column | None = None, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """(_key, _period, _n) of the references without a target. A null ``valid_to`` is open-ended;
    without validity columns the target holds for every period."""
    return _orphans(refs, key, period, targets, target_key, valid_from, valid_to, heavy_share)[0].drop("_heavy")


def orphan_rows(refs: DataFrame, row_id: Column, key: Column, period: Column, targets: DataFrame,
                target_key: Column, valid_from: Column | None = None, valid_to: Column | None = None,
                heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """(row_id, period) of every row whose reference is an orphan."""
    slim = refs.select(row_id.alias("row_id"), norm_key(key).alias("_key"), period.cast("int").alias("period")).where(
        F.col("_key").isNotNull())
    found, heavy = _orphans(refs, key, period, targets, target_key, valid_from, valid_to, heavy_share)
    found = cut(found.select(F.col("_key").alias("_okey"), F.col("_period").alias("_op"), "_heavy"))
    on = (F.col("_key") == F.col("_okey")) & F.col("period").eqNullSafe(F.col("_op"))
    hot = slim.join(F.broadcast(heavy), "_key", "left_semi").join(F.broadcast(found.where("_heavy")), on, "left_semi")
    cold = slim.join(F.broadcast(heavy), "_key", "left_anti").join(found.where("not _heavy"), on, "left_semi")
    return hot.unionByName(cold).select("row_id", "period")
