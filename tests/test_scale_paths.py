"""Operators that avoid a quadratic or unbounded step give what the plain way gives."""

import random
import statistics
import sys
import types

import pytest
from pyspark.sql import functions as F

from dugout.functions.text import token_set
from dugout.operators import draft, references, relational, stats


def test_medians_against_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.5, 2.0, float(rng.randrange(50))])) for _ in range(500)] + [("c", None), ("d", 7.0), ("e", 1.0), ("e", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g in {r[0] for r in rows}:
        vs = [v for k, v in rows if k == g and v is not None]
        if vs:
            want[g] = statistics.median(vs)
    for parts in (1, 5):
        assert {r["g"]: r["median"] for r in stats.medians(df, "v", ["g"], parts).collect()} == want
    assert stats.medians(df, "v").first()["median"] == statistics.median([v for _, v in rows if v is not None])
    assert stats.medians(df.limit(0), "v", ["g"]).count() == 0


def test_contains_first_against_all_pairs(spark):
    rng = random.Random(7)
    names = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 9)))) for i in range(60)] + [(99, None), (98, "a.c+x")]
    values = ["", "a", "ab", "abc", "ca", "zzz", None, "a.c", "b c", "bca", " "] + [n[1:5] for _, n in names[:20] if n]
    got = relational.contains_first(spark.createDataFrame([(v,) for v in values + values], "v string"), "v", spark.createDataFrame(names, "o int, n string"), "n", "o")
    want = {}
    for v in values:
        hit = [n for _, n in sorted(names) if v is not None and n is not None and v in n]
        if hit:
            want[v] = hit[0]
    assert {r["v"]: r["n"] for r in got.collect()} == want
    assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("NestedLoop", "Cartesian"))


def test_fallback_names(spark):
    names = spark.createDataFrame([(1, "University of Calvenia"), (2, "Calvenia State")], "o int, n string")
    mapping = spark.createDataFrame([(1, " Old U ", "Calvenia"), (2, "old u", "State"), (3, "", "State"), (4, "x", None)], "o int, a string, b string")
    df = spark.createDataFrame([("OLD U", None, 1), ("other", None, 2), ("OLD U", "kept", 3), (None, None, 4), ("x", None, 5)], "k string, f string, o int")
    got = {r["o"]: r["f"] for r in relational.fallback_names(df, "k", "f", names, "n", "o", mapping, "a", "b", "o").collect()}
    assert got == {1: "University of Calvenia", 2: None, 3: "kept", 4: None, 5: None}


@pytest.mark.parametrize("alike", [90.0, 75.0])
def test_near_pairs_lose_none(spark, alike):
    """Every pair that reaches the ratio is among the candidates."""
    rng = random.Random(11)
    words = ["ab", "anna", "bob", "okafor", "smith", "smyth", "jon", "john", "de", "la", "cruz", "montgomery"]
    made = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(120)}
    made |= {x[:i] + rng.choice("xyzab") + x[i + 1:] for x in list(made) for i in [rng.randrange(len(x))] if x[i] != " "}
    texts = sorted(t for t in made if t.strip() == t and t)
    x = spark.createDataFrame([(1, t) for t in texts], "s int, a string")
    y = spark.createDataFrame([(1, t) for t in texts] + [(2, texts[0])], "s int, b string")
    got = {(r["a"], r["b"]) for r in draft._near(x, y, ["s"], "a", "b", alike).collect()}
    want = {(a, b) for a in texts for b in texts if token_set(a, b) >= alike}
    assert want <= got
    assert alike < 90 or len(got) < len(texts) ** 2 / 2


def test_orphans_are_the_same_however_many_keys_are_heavy(spark):
    refs = spark.createDataFrame([(i, "HOT" if i % 3 else f"k{i % 7}", 2000 + i % 5) for i in range(300)] + [(900, None, 2001), (901, "gone ", None), (902, "HOT", None)],
                                 "row_id long, k string, year int")
    targets = spark.createDataFrame([("hot", 2000, 2002), ("k1", 2001, None), ("k2", None, 2003), (None, 2000, 2001)], "t string, a int, b int")
    args = (refs, F.col("k"), F.col("year"), targets, F.col("t"), F.col("a"), F.col("b"))
    rows = lambda share: sorted(map(tuple, references.orphan_rows(refs, F.col("row_id"), *args[1:], heavy_share=share).collect()))
    count = lambda share: sorted(map(str, references.orphan_counts(*args, heavy_share=share).collect()))
    assert rows(1) == rows(2) == rows(1000) and count(1) == count(2) == count(1000)
    plain = {}
    holds = {"hot": (2000, 2002), "k1": (2001, 9999), "k2": (0, 2003)}
    for i, k, y in [tuple(r) for r in refs.collect()]:
        if k and not (y is not None and k.strip().lower() in holds and holds[k.strip().lower()][0] <= y <= holds[k.strip().lower()][1]):
            plain[i] = y
    assert {r[0]: r[1] for r in rows(2)} == plain
    plan = references.orphan_counts(*args, heavy_share=2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan and "Union" in plan


def test_pick_of_unknown_rounds(spark):
    rounds = spark.createDataFrame([(2020, 1, 30), (2020, 2, 28), (2020, 3, 25), (2021, 1, 30)], "year int, round int, pick int")
    asked = spark.createDataFrame([(1, 2020, 1), (2, 2020, 2), (3, 2020, 9), (4, 1990, 1), (5, 2020, None)], "id int, year int, predicted_round int")
    got = {r["id"]: (r["picks"], r["pick"]) for r in draft.with_pick(asked, rounds).collect()}
    assert got == {1: (30, 1), 2: (28, 28), 3: (30, 1), 4: (30, 1), 5: (None, None)}


def test_search_steps_find_a_peak():
    import numpy as np

    from dugout.operators import models

    rng = np.random.default_rng(0)
    peak = np.full(len(models.SPACE), 0.3)
    f = lambda u: -float(((u - peak) ** 2).sum())
    tried = [rng.random(len(peak)) for _ in range(6)]
    first = max(map(f, tried))
    for _ in range(25):
        tried.append(models.next_point(np.array(tried), np.array([f(u) for u in tried]), rng))
    assert max(map(f, tried)) > first
    v = models.in_space(np.array([0.0, 0.5] + [1.0] * 7))
    assert v["depth"] == 2 and abs(v["rate"] - 10 ** -1.5) < 1e-9 and v["rows"] == 1.0 and v["gamma"] == 10.0


def test_external_statistics_skip_what_fails(spark, tmp_path, monkeypatch):
    from dugout.sources.external import TeamStats

    code = '''
def teams(year, division):
    if year == 2003:
        raise RuntimeError("no list")
    return ["Calvenia (ACC)", "no brackets", "Division I (x)", "Empty ()", None]

def stat(name, team, year, division):
    if name == "era":
        raise KeyError(name)
    return "12.5" if name == "w" else "none"
'''
    service = types.ModuleType("fake_stats")
    exec(code, service.__dict__)
    monkeypatch.setitem(sys.modules, "fake_stats", service)
    source = TeamStats({"module": "fake_stats", "stats": "w,era,l", "first": "2002", "last": "2003"})
    reader = source.reader(None)
    assert source.schema() == "team string, league string, year int, `w` double, `era` double, `l` double"
    assert [row for p in reader.partitions() for row in reader.read(p)] == [("Calvenia", "ACC", 2002, 12.5, None, None)]
    spark.dataSource.register(TeamStats)
    (tmp_path / "dugout_fake_stats.py").write_text(code)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "dugout_fake_stats.py"))
    df = spark.read.format("team_stats").options(module="dugout_fake_stats", stats="w,era,l", first="2002", last="2003", division="1").load()
    assert [tuple(r) for r in df.collect()] == [("Calvenia", "ACC", 2002, 12.5, None, None)]


def test_fuzzy_match_broadcasts_nothing(spark):
    """Exploded tokens outgrow what the planner reads from the files' sizes, so even small tables are not broadcast."""
    p = spark.createDataFrame([(1, "Jon Smith", "Tech", 2000)], "pid long, name string, school string, year int")
    a = spark.createDataFrame([(5, "Jon Smith Jr", "Tech", 2000)], "ord long, name string, school string, year int")
    m = draft.fuzzy_match(p, a)
    assert "Broadcast" not in m._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in m.collect()] == [(1, 5)]


def test_steps_leave_no_shuffle_files(spark):
    """What a step shuffled is deleted when its result stands, not when the driver collects its garbage; the setting is put back."""
    import pathlib

    from dugout.session import cut, stage

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {p for d in dirs for p in pathlib.Path(d).rglob("shuffle_*")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(key)
    df = spark.range(1000).withColumn("g", F.col("id") % 7).groupBy("g").agg(F.sum("id").alias("s")).join(spark.range(7).withColumnRenamed("id", "g").hint("merge"), "g")
    for step in (cut, stage):
        d = step(df)
        assert d.count() == 7 and spark.conf.get(key) == was
        del d
    left = [p for p in files() - before if p.stat().st_size and p.suffix == ".data"]
    want = df.groupBy().agg(F.sum("s")).first()[0]
    assert len(left) <= 2 and want == sum(range(1000)), left  # the two counts shuffle one row each
