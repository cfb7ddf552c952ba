import itertools
import random

from pyspark.sql import functions as F

from dugout.operators import schema_drift as D

N = D.Node


def brute(old, new):
    """Least cost over all ways to give fields that went to fields that came, of two levels at most."""
    def rest(a, b, path=""):
        x, y = {n.name: n for n in a}, {n.name: n for n in b}
        went, came = [(path, n) for k, n in x.items() if k not in y], [(path, n) for k, n in y.items() if k not in x]
        for k in x.keys() & y.keys():
            p, q = rest(x[k].children, y[k].children, path + k)
            went, came = went + p, came + q
        return went, came

    gone, come = rest(old, new)
    every = sum(n.size() for _, n in gone + come)
    best = every
    for k in range(1, min(len(gone), len(come)) + 1):
        for a in itertools.combinations(gone, k):
            for b in itertools.permutations(come, k):
                total = every
                for (p, o), (q, n) in zip(a, b, strict=True):
                    name = 0.0 if o.name == n.name else D.rename_cost(o, n, NEAR.get((o.name, n.name), 0) if p == q else None)
                    total += name + (D.MOVE if p != q else 0) + brute(o.children, n.children) - o.size() - n.size()
                best = min(best, total)
    return best


NEAR: dict = {}


def test_cost_is_least(monkeypatch):
    # the brute force does not know the neighbours, so they count for nothing here
    odds = D.rename_odds
    monkeypatch.setattr(D, "rename_odds", lambda old, new, near=None, seen=None: odds(old, new, None, seen) + 1.2)
    rng = random.Random(5)
    pool = ["hr", "homers", "abc", "abd", "xyz", "year", "season", "q", "yr"]

    def tree(depth):
        names = rng.sample(pool, rng.randrange(1, 5 - depth))
        return [N(x, "integer", D.Profile(9, 1, rng.random(), 1, 2), tree(depth + 1) if depth < 1 and rng.random() < 0.4 else []) for x in names]

    for _ in range(150):
        old, new = tree(0), tree(0)
        assert abs(D.least_script(old, new)[0] - brute(old, new)) < 1e-9


def test_scripts():
    old = [N("name"), N("hr", "integer"), N("pa", "integer", D.Profile(20, 1, 120.0, 30.0, 3)), N("avg", "decimal")]
    new = [N("name"), N("homers", "decimal"), N("avg", "text"), N("ibb", "integer", D.Profile(20, 1, 1.0, 1.0, 1))]
    assert sorted(D.edit_script(old, new)) == sorted([
        ("renamed", "hr", "homers"), ("retyped", "hr", "homers"), ("retyped", "avg", "avg"), ("removed", "pa", ""), ("added", "", "ibb")])
    assert D.edit_script(old, old) == []
    assert D.edit_script([], []) == []


def test_what_all_files_say_decides():
    few, many = D.Profile(500, 1, 0.3, 0.05, 5), D.Profile(500, 1, 90.0, 30.0, 3)
    assert D.rename_odds(N("k%"), N("so_rate"), 2, D.Evidence(0.0, 2.0, few, few)) > 0
    assert D.rename_odds(N("k%"), N("so_rate"), 2, D.Evidence(0.4, 2.0, few, few)) < 0  # both stand in one file
    assert D.rename_odds(N("k%"), N("ab"), 0, D.Evidence(0.0, 0.0, few, many)) < 0


def test_nested_move_and_rename():
    old = [N("a", children=[N("x"), N("y")]), N("b", children=[N("p")])]
    new = [N("a", children=[N("x")]), N("b", children=[N("p"), N("y")])]
    assert D.edit_script(old, new) == [("moved", "a.y", "b.y")]
    whole = [N("a", children=[N("x")]), N("b", children=[N("p"), N("s", children=[N("u"), N("v")])])]
    gone = [N("a", children=[N("x"), N("s", children=[N("u"), N("w")])]), N("b", children=[N("p")])]
    assert sorted(D.edit_script(whole, gone)) == [("added", "", "a.s.w"), ("moved", "b.s", "a.s"), ("removed", "b.s.v", "")]


def lines(spark, rows):
    return spark.createDataFrame(rows, "file_id long, feed string, kind string, season int, line_no int, line string, extra string")


def rows_of(file_id, season, text, feed="f", kind="standard"):
    return [(file_id, feed, kind, season, i, x, "e") for i, x in enumerate(text)]


def test_changes_and_unified(spark):
    data = (
        rows_of(2, 2020, ["name,playerid,year,hr", '"Doe, ""J"" A",1,2020,3', "B,NA,2020,--", "B,NA,2020,--"])
        + rows_of(1, 2021, [" Name ,PID,yr,hr,bats", "C,x1,2021,2.5,L", None])
        + rows_of(9, 2022, ["name,pid,yr,hr", "D,x2,2022,"])
        + rows_of(7, 2019, ["name,z", "E,1"], feed="g")
        + [(8, "f", "standard", 2018, 1, "no header", "e")]
    )
    df = lines(spark, data)
    got = sorted((r["file_id"], r["column_name"], r["change"]) for r in D.schema_changes(df).collect())
    assert got == sorted([
        (1, "pid", "renamed"), (1, "pid", "retyped"), (1, "yr", "renamed"), (1, "bats", "added"), (1, "hr", "retyped"), (9, "bats", "removed")])
    table = D.unified_table(df, D.unify(df), ["name", "pid", "yr", "hr"], {"yr": "season", "hr": "double"})
    rows = sorted(tuple(r) for r in table.select("file_id", "name", "pid", "yr", "hr").where("file_id <> 7").collect())
    assert rows[0] == (1, "C", "x1", 2021, 2.5)
    assert (2, 'Doe, "J" A', "1", 2020, 3.0) in rows
    assert rows.count((2, "B", None, 2020, None)) == 2
    assert D.schema_changes(df.limit(0)).count() == 0


def test_lenient(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("36.6%",), ("31.0",), ("2024-25",), ("2020",), ("10001",), ("SA7",), ("NA",), (None,), ("x",), ("1.5",)], "v string")
    got = [tuple(r) for r in df.select(*[D.lenient(F.col("v"), k) for k in ("double", "int", "season", "id")]).collect()]
    assert got[0] == (0.366, None, None, "36.6%") and got[1][:3] == (31.0, 31, 31)
    assert got[2][2] == 2025 and got[3][:3] == (2020.0, 2020, 2020) and got[4][3] == "sa10001" and got[5][3] == "sa7"
    assert got[6] == got[7] == (None, None, None, None) and got[8][:3] == (None, None, None) and got[9][:2] == (1.5, None)


def test_previous_files_in_stretches(spark):
    rows = [(i, "f" if i % 3 else "g", "k", 2020 + (i * 7) % 3 if i != 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "file_id long, feed string, kind string, season int")
    want = {}
    for feed in ("f", "g"):
        ids = [r[0] for r in sorted((r for r in rows if r[1] == feed), key=lambda r: (r[3] if r[3] is not None else -1, r[0]))]
        want.update(zip(ids[1:], ids))
    for bucket in (1, 4, 4096):
        assert {r["file_id"]: r["prev_file_id"] for r in D.previous_files(df, bucket).collect()} == want


def test_every_added_column_is_in_the_unified_table(spark, monkeypatch):
    from dugout.plans import data_queries as Q

    df = lines(spark, rows_of(1, 2020, ["name,hr", "A,1"])
               + rows_of(2, 2021, ["name,hr,pull_pct,ibb,bats,mood,feed", "B,2,36.6%,4,L,7,x", "C,3,NA,,R,8,y"])
               + rows_of(3, 2022, ["name,hr,pull%,ibb,bats,mood", "D,4,0.5,5.5,3,99999999999,"]))
    assert D.unify(df).columns == {"name": "string", "hr": "long", "pull_pct": "double", "ibb": "double", "bats": "string", "mood": "long", "feed": "string"}
    monkeypatch.setattr(Q, "table", lambda spark, d, name: df)
    got = Q.p6_unified(spark, "")
    rows = {tuple(r) for r in got.select("name", "hr", "pull_pct", "ibb", "bats", "mood", "feed_").collect()}
    assert rows == {("A", 1, None, None, None, None, None), ("B", 2, 0.366, 4.0, "L", 7, "x"), ("C", 3, None, None, "R", 8, "y"), ("D", 4, 0.5, 5.5, "3", 99999999999, None)}


def test_split_line(spark):
    from pyspark.sql import functions as F

    want = {"a,b,,": ["a", "b", "", ""], '"Doe, ""J"" A",1,"",x': ['Doe, "J" A', "1", "", "x"], '5 11",2': ['5 11"', "2"], "": [""], 'x, "y,z" ,': ["x", "y,z", ""],
            '"' + "q," * 50_000 + '",1': ["q," * 50_000, "1"]}
    got = spark.createDataFrame([(k,) for k in want], "line string").select("line", D.split_line(F.col("line")).alias("v")).collect()
    assert {r["line"]: list(r["v"]) for r in got} == want


def test_chains_of_renames_are_followed_file_by_file(spark):
    """Three names in a row lead to the first one, in every file; a name that comes again later is another fact."""
    df = lines(spark, rows_of(1, 2019, ["name,zq_alpha_val,b", "A,10,1"]) + rows_of(2, 2020, ["name,zq_alpha_value,b", "B,11,2"])
               + rows_of(3, 2021, ["name,zq_alpha_values,b", "C,12,3"]) + rows_of(4, 2022, ["name,zq_alpha_valued,b", "D,13,4"])
               + rows_of(5, 2023, ["name,zq_alpha_valued,b,zq_alpha_val", "E,14,5,left"]))
    plan = D.unify(df)
    by = {(r["file_id"], r["pos"]): r["column"] for r in plan.positions.collect()}
    assert len({by[i, 1] for i in range(1, 6)}) == 1 and by[5, 3] != by[5, 1]
    rows = {tuple(r) for r in D.unified_table(df, plan, [by[1, 1], "b", by[5, 3]], plan.columns).select("file_id", by[1, 1], "b", by[5, 3]).collect()}
    assert rows == {(1, 10, 1, None), (2, 11, 2, None), (3, 12, 3, None), (4, 13, 4, None), (5, 14, 5, "left")}


def test_streams_that_begin_under_different_names_meet(spark):
    data = []
    for k in range(6):  # in these streams yr comes where year went
        data += rows_of(10 * k, 2019, ["name,year,h", f"A{k},2019,5"], feed=f"f{k}") + rows_of(10 * k + 1, 2020, ["name,yr,h", f"B{k},2020,6"], feed=f"f{k}")
    data += rows_of(99, 2021, ["name,yr,h", "C,2021,7"], feed="g")
    df = lines(spark, data)
    assert set(D.unify(df).columns) in ({"name", "year", "h"}, {"name", "yr", "h"})


def test_roots(spark):
    from dugout.operators.pointers import roots

    chain = [(i, i + 1) for i in range(13)] + [(100, 101), (7, 8), (50, 50)][:1] + [(50, 50), (200, 3)]
    got = {r["key"]: r["root"] for r in roots(spark.createDataFrame(chain, "key long, up long")).collect()}
    assert got == {**{i: 13 for i in range(13)}, 100: 101, 50: 50, 200: 13}
    assert roots(spark.createDataFrame([], "key long, up long")).count() == 0


def test_recall_and_precision_on_invented_names(spark):
    """Streams of files whose columns have invented names: at least nine of ten renames are found, and nine of ten found are right."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    draw = [lambda: str(rng.randrange(0, 6)), lambda: str(rng.randrange(20, 60)), lambda: str(rng.randrange(100, 400)), lambda: f"{rng.uniform(0.2, 0.4):.3f}",
            lambda: f"{rng.uniform(2, 7):.2f}", lambda: f"{rng.gauss(0, 9):.1f}", lambda: rng.choice("LRS"), lambda: f"{word()} {word()}", lambda: f"id{rng.randrange(10**6)}", lambda: str(rng.randrange(2000, 2025))]
    names = [[word() + str(i)[-1] * (k > 1) for k in range(3)] for i in range(len(draw))]
    assert len({n for ns in names for n in ns}) == 3 * len(draw)
    data, truth, i = [], set(), 0
    for feed in range(80):
        facts = {f: names[f][0] for f in range(len(draw)) if rng.random() < 0.8}
        for season in range(2015, 2021):
            i += 1
            if season > 2015:
                for f in list(facts):
                    if rng.random() < 0.06:
                        facts[f] = rng.choice([n for n in names[f] if n != facts[f]])
                        truth.add((i, facts[f]))
                    elif rng.random() < 0.04:
                        del facts[f]
                for f in range(len(draw)):
                    if f not in facts and rng.random() < 0.1 and (i, names[f][0]) not in truth:
                        facts[f] = names[f][0]
            cols = list(facts)
            if rng.random() < 0.15:
                rng.shuffle(cols)
            text = [",".join(facts[f] for f in cols)] + [",".join(draw[f]() for f in cols) for _ in range(12)]
            data += rows_of(i, season, text, feed=f"feed{feed}")
    # a name that went and came again in one step is one that stays
    got = {(r["file_id"], r["column_name"]) for r in D.schema_changes(lines(spark, data)).where("change = 'renamed'").collect()}
    assert len(truth) > 100 and len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.9 * len(got), (len(truth), len(got), len(got & truth))


def test_names_are_brought_together_however_many_there_are(spark):
    """More than 5,000 distinct renames; two names of one file stay apart however renames lead from one to the other."""
    n = 5003
    changes = spark.range(n).select(F.concat(F.lit("a"), "id").alias("old_name"), F.concat(F.lit("b"), "id").alias("column_name"), F.lit("renamed").alias("change"))
    chain = spark.createDataFrame([("x", "y", "renamed"), ("y", "z", "renamed"), ("x", "y", "renamed")], "old_name string, column_name string, change string")
    field = lambda *c: F.array(*[F.struct(x.alias("name")) for x in c])
    one = lambda k: spark.range(n).select(field(F.concat(F.lit(k), "id")).alias("fields"))
    schemas = one("a").unionByName(one("b")).unionByName(one("b")).unionByName(spark.range(2).select(field(F.lit("x"), F.lit("z")).alias("fields"))).unionByName(
        spark.range(5).select(field(F.lit("y")).alias("fields")))
    got = D.common_names(schemas, changes.unionByName(chain))
    assert len(got) == 2 * n + 3 and all(got[f"a{i}"] == got[f"b{i}"] == f"b{i}" for i in (0, 17, n - 1))
    assert got["x"] == got["y"] == "y" and got["z"] == "z"
