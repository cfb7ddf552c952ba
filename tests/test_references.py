from pyspark.sql import functions as F

from dugout.operators import references as R


def frames(spark):
    refs = spark.createDataFrame(
        [(1, "a", 2001), (2, " A ", 2009), (3, None, 2001), (4, "  ", 2001), (5, "z", 2001), (5, "z", 2001), (6, "b", None), (7, " b", 2030)],
        "row_id long, k string, year int")
    targets = spark.createDataFrame([("A", 2000, 2005), ("B ", 2000, None), (None, 1990, None)], "name string, first int, last int")
    return refs.withColumn("_key", F.lit("clash")).withColumn("n", F.lit(0)), targets.withColumn("_n", F.lit(1))


def run(refs, targets, **kw):
    out = R.orphan_rows(refs, F.col("row_id"), F.col("k"), F.col("year"), targets, F.col("name"), F.col("first"), F.col("last"), **kw)
    return sorted(tuple(r) for r in out.collect())


def test_rows(spark):
    assert run(*frames(spark)) == sorted([(2, 2009), (5, 2001), (5, 2001), (6, None)], key=lambda x: (x[0], x[1] or 0))


def test_heavy_and_light_keys_agree(spark):
    refs, targets = frames(spark)
    assert run(refs, targets, heavy_share=1) == run(refs, targets, heavy_share=10**6)


def test_counts_and_empty(spark):
    refs, targets = frames(spark)
    counts = R.orphan_counts(refs, F.col("k"), F.col("year"), targets, F.col("name"))
    assert sorted((r["_key"], r["_period"], r["_n"]) for r in counts.collect()) == [("z", 2001, 2)]
    assert run(refs.limit(0), targets) == []
    assert len(run(refs, targets.limit(0))) == 6
