import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dugout.operators import draft, features, metrics, models, pyth, relational, sampling, stats
from dugout.sources import files, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_fit_against_brute_force(spark):
    rng = np.random.default_rng(1)
    data = [(2000 + i % 2, float(a), float(b), float(a**1.7 / (a**1.7 + b**1.7) + e)) for i, (a, b, e) in enumerate(zip(rng.integers(50, 300, 60), rng.integers(50, 300, 60), rng.normal(0, 0.01, 60)))]
    df = spark.createDataFrame(data + [(None, 1.0, 1.0, 0.5), (2000, 0.0, 0.0, 0.5)], "year int, a double, b double, w double")
    got = {r["year"]: r for r in pyth.fit_exponent(pyth.usable_seasons(df, "a", "b", "w"), ["year"], 10).collect()}
    assert set(got) == {2000, 2001}
    for y, r in got.items():
        a, b, w = (np.array([t[k] for t in data if t[0] == y]) for k in (1, 2, 3))
        errs = [(np.sqrt(np.mean((w - a**x / (a**x + b**x)) ** 2)), x) for x in np.arange(50, 351) / 100]
        assert r["best_x"] == pytest.approx(min(errs)[1]) and r["best_rmse"] == pytest.approx(min(errs)[0])
        assert r["n"] == len(a)


def test_fit_ties_and_guards(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0, 0.5)] * 3, "year int, a double, b double, w double")
    s = pyth.usable_seasons(df, "a", "b", "w")
    assert pyth.fit_exponent(s, [], 3).first()["best_x"] == 0.5  # every exponent fits: the smallest
    assert pyth.fit_exponent(s, [], 4).count() == 0


def test_null_safe_merge(spark):
    a = spark.createDataFrame([("x", None, 1), (None, None, 2)], "k string, j string, v int")
    b = spark.createDataFrame([("x", None, 10), ("y", "z", 20)], "k string, j string, v int")
    m = relational.null_safe_merge(a, b, ["k", "j"], ("_p", "_b"))
    got = {(r["k"], r["j"]): (r["v_p"], r["v_b"]) for r in m.collect()}
    assert got == {("x", None): (1, 10), (None, None): (2, None), ("y", "z"): (None, 20)}
    roles = m.select(relational.role(F.col("_in_left"), F.col("_in_right")).alias("r"))
    assert rows(roles) == [("Batter",), ("Pitcher",), ("Two-Way",)]
    assert rows(relational.coalesce_pairs(m.select("v_p", "v_b"), ["v", "absent"], ("_p", "_b"))) == [(1,), (2,), (20,)]


def test_lookups_and_projections(spark):
    m = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("", "3", 3), (None, "4", 4)], "k string, v string, o int")
    assert rows(relational.last_wins(m, "k", "v", "o")) == [("a", "2")]
    assert rows(relational.first_wins(m, "k", "v", "o")) == [("", "3"), ("a", "1")]
    d = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert rows(relational.lookup(d, "c", relational.last_wins(m, "k", "v", "o"), "k", "v")) == [("2",), ("b",), (None,)]
    u = relational.union_by_name([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "a int, c int")])
    assert u.columns == ["a", "b", "c"] and rows(u) == [(1, 2, None), (3, None, 4)]
    with pytest.raises(KeyError):
        relational.drop_strict(d, ["nope"])
    assert relational.normalise_header(d.toDF(" C ")).columns == ["c"]
    assert relational.columns_like(spark.createDataFrame([(1, 2)], "Year_x int, b int"), "year") == ["Year_x"]
    t = spark.createDataFrame([("Division I",), (None,), ("Team",)], "t string")
    assert rows(t.where(relational.not_containing(F.col("t"), "division"))) == [("Team",), (None,)]
    assert rows(relational.outer_merge(spark.createDataFrame([(1, 2)], "k int, v int"), spark.createDataFrame([(1, 9, 5), (2, 9, 6)], "k int, v int, w int"), ["k"])) == [(1, 2, 5), (2, None, 6)]


def test_sampling_is_exact(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 10 < 3).cast("int").alias("y"))
    s = sampling.stratified_split(df, "y", "id")
    assert rows(s.groupBy("y", "is_test").count()) == [(0, False, 1680), (0, True, 420), (1, False, 720), (1, True, 180)]
    pdf = df.withColumn("h", sampling.hash_key("id", 42)).toPandas()
    want = set(pdf[pdf.y == 1].sort_values(["h", "id"]).head(180).id)
    assert {r["id"] for r in s.where("y = 1 and is_test").collect()} == want
    assert rows(sampling.undersample(df, "y", "id").groupBy("y").count()) == [(0, 900), (1, 900)]
    assert rows(sampling.split(df.limit(3), "id").groupBy("is_test").count()) == [(False, 2), (True, 1)]
    assert sampling.undersample(df.limit(0), "y", "id").count() == 0


def test_stats(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 3.0), (2.0, 1.0), (None, 1.0)], "a double, b double")
    assert rows(stats.average_rank(df, "a", "r").select("a", "r")) == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (None, None)]
    assert stats.spearman(df, "a", "b").first()[0] == pytest.approx(-0.8660254)
    assert rows(stats.missingness(df.withColumn("c", F.lit(1)), 5)) == [("a", 0.25)]
    assert [r["n"] for r in stats.histogram(df, "a", 2).orderBy("bin").collect()] == [1, 2]
    assert stats.histogram(df.limit(0), "a", 2).count() == 0
    assert sum(r["n"] for r in stats.histogram(spark.createDataFrame([(5.0,)] * 3, "a double"), "a", 4).collect()) == 3


def test_features(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 0, None), (None, 1, float("nan"))], "c string, y int, v double")
    assert rows(features.one_hot(df.select("c"), "c")) == [(0,), (0,), (1,)]
    assert rows(features.class_weight(df, "y").select("weight")) == [(0.5,), (0.5,), (1.0,)]
    enc = {r["c"]: r["m"] for r in features.target_encode(df, "c", "y", "m").collect()}
    assert enc["a"] == 1.0 and enc["b"] == 0.0 and enc[None] == pytest.approx(2 / 3)
    v = features.assemble(df, ["v"]).select("c", "features").collect()
    assert sorted(tuple(r["features"].toArray()) for r in v) == [(1.0, 0.0), (1.0, 1.0), (1.0, 1.0)]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1.0, 0.9), (0, 1.0, 0.6), (0, 0.0, 0.4), (1, 0.0, 0.5)], "y int, p double, s double")
    rep = {r["class"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert set(rep) == {"0", "1", "macro avg", "weighted avg"} and rep["1"]["precision"] == 0.5 and rep["macro avg"]["support"] == 4
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(0.75)
    assert metrics.r2(df, "y", "p").first()["mae"] == 0.5


def test_models_and_two_stage(spark):
    df = spark.range(120).select(F.col("id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.rand(1) / 10).alias("v"), (F.col("id") % 7).alias("pick"))
    d = features.assemble(df, ["v"])
    a = models.boosted_classifier("y", trees=3, depth=2).fit(d)
    b = models.boosted_regressor("pick", trees=3, depth=2).fit(d)
    out = draft.two_stage(d, a, b)
    assert metrics.roc_auc(out, "y", "drafted_p1").first()[0] == 1.0
    assert out.where("drafted = 0 and predicted_pick is not null").count() == 0
    assert metrics.importance(spark, a, ["v"]).count() == 1


def test_encoded_categories_are_numbers(spark):
    """More distinct means than a tree has bins: the encoded column is no category."""
    df = spark.range(4000).select(F.concat(F.lit("t"), (F.col("id") % 50).cast("string")).alias("team"), (F.pmod(F.xxhash64("id"), F.lit(60)) < F.col("id") % 50).cast("int").alias("y"),
                                 (F.col("id") % 9).cast("double").alias("v"))
    fitted = models.encoder_pipeline("y", ["team"], ["v"], 2, 2).fit(df)
    out = fitted.transform(df)
    assert out.select("team_mean").distinct().count() > 32 and out.count() == 4000
    assert "nominal" not in str(out.schema["encoded"].metadata)


def test_search_encodes_a_fold_once_and_keeps_all_values(spark, monkeypatch):
    """More categories than a tree has bins; a fold is encoded once for all points, and the trees of a point get its nine values."""
    df = spark.range(900).select(F.concat(F.lit("t"), (F.col("id") % 45).cast("string")).alias("team"), (F.pmod(F.xxhash64("id"), F.lit(60)) < F.col("id") % 45).cast("int").alias("y"),
                                 (F.col("id") % 9).cast("double").alias("v"))
    made, encoder = [], models.encoder
    monkeypatch.setattr(models, "encoder", lambda *a: made.append(1) or encoder(*a))
    v, auc = models.bayes_search(df, "y", ["team"], ["v"], n_iter=3, folds=2, trees=1, random_first=2)
    assert len(made) == 2 and 0.5 < auc <= 1
    assert (v, auc) == models.bayes_search(df, "y", ["team"], ["v"], n_iter=3, folds=2, trees=1, random_first=2)
    m = models.boosted_at(v, "y", 1)
    assert (m.getMinInstancesPerNode(), m.getMinWeightFractionPerNode(), m.getMinInfoGain()) == (1 + int(v["alpha"]), v["lambda"] / 1000, v["gamma"] / 1000)


def test_draft_operators(spark):
    p = spark.createDataFrame([(1, "Jon Smith", "Tech", 2000), (2, "Al Doe", None, 2000)], "pid long, name string, school string, year int")
    a = spark.createDataFrame([(5, "Jon Smith Jr", "Tech", 2000), (3, "Jon A Smith", "TECH", 2000), (4, "Al Doe", None, 2000), (1, "Jon Smith", "Tech", 1999)], "ord long, name string, school string, year int")
    assert rows(draft.fuzzy_match(p, a)) == [(1, 3)]  # the first in file order; a blank school equals none
    r = spark.createDataFrame([(1, 1, 30), (1, 2, 30), (1, 3, 30), (1, 2, 4)], "year int, round int, pick int")
    assert rows(draft.pick_allocation(r).select("round", "before", "pick")) == [(1, 0, 1), (2, 30, 30), (3, 60, 30)]


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text('k%,name,n\n0.5,"a, b",7\nNA, z ,x\n')
    schema = T.StructType([T.StructField("k%", T.DoubleType()), T.StructField("name", T.StringType()), T.StructField("n", T.IntegerType())])
    assert rows(files.read_csv(spark, str(tmp_path / "x.csv"), schema)) == [(0.5, "a, b", 7), (None, "z", None)]
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    j = files.read_json_array(spark, str(tmp_path / "x.json"), T.StructType([T.StructField("a", T.LongType())]))
    assert [r["a"] for r in j.orderBy("_ord").collect()] == [1, 2]
    f = spark.createDataFrame([("q/batting_standard_2020.csv",), ("q/BATTING_advanced_2020.CSV",), ("q/pitching_standard_2020.csv",), ("notes.txt",)], "n string")
    assert rows(files.complete_seasons(f, "n")) == [("batting", 2020, True), ("pitching", 2020, False)]
    g = spark.range(1).select(F.explode(files.exponent_grid()).alias("x")).agg(F.count("x"), F.min("x"), F.max("x")).first()
    assert tuple(g) == (301, 0.5, 3.5)
    s = files.synthetic(spark, 50, {"i": ("int", 2, 5), "f": ("float", 0.0, 1.0)})
    assert s.where("i < 2 or i >= 5 or f < 0 or f > 1").count() == 0 and rows(s) == rows(files.synthetic(spark, 50, {"i": ("int", 2, 5), "f": ("float", 0.0, 1.0)}))
    sinks.write_csv(s, str(tmp_path / "out"), single=True)
    sinks.write_parquet(s, str(tmp_path / "pq"), by=["i"])
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == spark.read.parquet(str(tmp_path / "pq")).count() == 50
    assert rows(sinks.overview(s.select("i"))) == [("i", "int", 50, 50)]
