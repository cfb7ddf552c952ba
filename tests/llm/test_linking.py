import itertools

import numpy as np
from pyspark.sql import functions as F

from dugout.llm import canonical, graph, matching, queries, spellings
from dugout.llm import school_names as S

TEAMS = [("CAL", "University of Calvenia"), ("RUD", "Ruddmere College"), ("SWU", "Saint Wendred University"), ("CVE", "University of Calvenia-Verddale"), ("KT", "Kordane Institute of Technology")]


def listed(spark):
    return spark.createDataFrame(TEAMS, "acronym string, spelling string")


def institutions(spark, values):
    s = spellings.spell_support(spark.createDataFrame([(v, 1) for v in values], "spelling string, n int"))
    t = listed(spark)
    return {r["spelling"]: r["institution"] for r in spellings.institutions(s, t.select("spelling"), t).collect()}


def test_institutions(spark):
    values = ["Calvenia", "U. of Calvnia", "University of Calvenia", "University of Calvenia Sailors", "CAL", "Calvenia, University of", None, "", "TBD", "UC Verddale",
              "Calvenia-Verdale", "Ruddmere Col.", "St Wendred", "Kordane Tech", "Wrestcrest Community College", "Wrestcrest CC", "Wrestcrst C.C.", "x" * 5000, "Wrestcrest CC"]
    got = institutions(spark, values)
    groups = [["Calvenia", "U. of Calvnia", "University of Calvenia", "University of Calvenia Sailors", "CAL", "Calvenia, University of"], ["UC Verddale", "Calvenia-Verdale"],
              ["Wrestcrest Community College", "Wrestcrest CC", "Wrestcrst C.C."], ["Ruddmere Col."], ["St Wendred"], ["Kordane Tech"]]
    assert [len({got[x] for x in g}) for g in groups] == [1] * 6
    assert len({got[g[0]] for g in groups}) == 6
    assert not {None, "", "TBD"} & set(got)


def test_institutions_of_nothing(spark):
    s = spark.createDataFrame([], "spelling string, n long")
    t = listed(spark)
    assert spellings.institutions(s, t.select("spelling").limit(0), t.limit(0)).count() == 0


def drafts(spark, rows):
    return spark.createDataFrame(rows, "ord long, name string, year int, institution string")


def test_draft_evidence(spark):
    filler = [(100 + i, f"First{chr(97 + i % 20)} Last{chr(97 + i % 23)}{chr(97 + i % 19)}", 2000 + i % 20, f"university|p{i % 50}") for i in range(600)]
    rows = [(1, "Benjamin Okafor", 2005, "university|calvenia"), (2, "Ben Okafor", 2006, "university|calvenia"), (3, "Okafor, Benjamin", 2012, "university|calvenia"),
            (4, "Salvador Quillan", 2003, "high|rosk"), (5, "Chava Quillan", 2006, "college|ruddmere"), (6, "Salvador Quillan", 2007, "university|other"),
            (7, "Dane Mortlake Jr.", 2008, "am|x"), (8, "Dane Mortlake III", 2009, "am|x"), (9, None, 2009, "am|x"), (10, "Dane Mortlake", None, None)]
    got = {(r["a"], r["b"]) for r in spellings.draft_evidence(drafts(spark, rows + filler)).where("confidence >= 0.5 and a < 100").collect()}
    assert {(1, 2), (4, 5), (4, 6)} <= got <= {(1, 2), (4, 5), (4, 6), (5, 6)}  # a full name so rare outweighs the other school


def test_draft_evidence_from_school_with_mistyped_first_name_or_initial(spark):
    filler = [(100 + i, f"First{chr(97 + i % 20)} Last{chr(97 + i % 23)}{chr(97 + i % 19)}", 2000 + i % 20, f"university|p{i % 50}") for i in range(600)]
    rows = [(1, "Malik Crustagren", 2003, "high|rosk"), (2, "Mslik Crustagren", 2006, "college|ruddmere"),
            (3, "Sayer Flalvutti", 2004, "high|rosk"), (4, "S. Flalvutti", 2007, "college|calvenia"),
            (5, "Hunter Kaushiden", 2004, "high|rosk"), (6, "Bruno Kaushiden", 2007, "college|calvenia")]
    # a form of so many rows that chance explains every link: none of them is linked, and none is met
    crowd = [(1000 + i, f"{c}. Tomsett", 2003 + 3 * (i % 2), f"{'college' if i % 2 else 'high'}|q{i}") for i, c in enumerate("J" * 200)]
    links = spellings.draft_evidence(drafts(spark, rows + filler + crowd))
    got = {(r["a"], r["b"], r["level"]) for r in links.where("a < 100").collect() if r["confidence"] >= 0.5}
    assert got == {(1, 2, "I"), (3, 4, "I")}
    assert links.where("a >= 1000 and confidence >= 0.5").count() == 0


def test_same_pick(spark):
    d = spark.createDataFrame([(3, 2000, 1, 1), (1, 2000, 1, 1), (2, 2000, 1, 1), (4, 2000, None, 1), (5, 2000, None, 1)], "ord long, year int, round int, pick int")
    assert sorted(tuple(r) for r in spellings.same_pick(d).collect()) == [(1, 2), (1, 3)]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (60, 50), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in (40, 50, 60)} == {40}
    assert graph.components(e.limit(0)).count() == 0


# ------------------------------------------------------------------ canonical list


def test_trie_against_brute_force():
    paths = ["abcd", "abce", "xbcd", "abcdef", "bacd"]
    t = canonical.Trie()
    for p in paths:
        t.add(p, p)
    for word in ["abcd", "abc", "bcd", "acbd", "abdc", "zzzz", "abcdeg", ""]:
        for most in (0, 1, 2, 3):
            want = {(p, S.osa(word, p, 9)) for p in paths if S.osa(word, p, 9) <= most}
            assert set(t.search(word, most)) == want, (word, most)


def test_map_values(spark):
    ref = spark.createDataFrame([(n, a) for a, n in TEAMS], "name string, acronym string")
    values = ["Calvenia", "university of calvenia", "kt", "Ruddmere Coll", "Rudmere College", "Ruddmere High School", "St. Wendred's", "UC Verddale", "Kordane", None, "", "TBD",
              "Opponents", "University of Calvenia", "Ashkwick Univ.", "y" * 3000]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values + values)], "value string, entry int")
    want = {"Calvenia": "University of Calvenia", "university of calvenia": "University of Calvenia", "kt": "Kordane Institute of Technology", "Ruddmere Coll": "Ruddmere College",
            "Rudmere College": "Ruddmere College", "St. Wendred's": "Saint Wendred University", "UC Verddale": "University of Calvenia-Verddale", "University of Calvenia": "University of Calvenia"}
    for chunk in (20_000, 2):  # one trie, or several over the same list
        got = {r["value"]: r["entry"] for r in canonical.map_values(df, ref, chunk).collect()}
        assert got == {v: want.get(v) for v in values if v is not None}
    assert all(r["entry"] is None for r in canonical.map_values(df, ref.limit(0)).collect())


# ------------------------------------------------------------------ belief propagation


def exact(pairs):
    """Marginals by summing over all allowed sets of pairs."""
    total, part = 0.0, {p[:3]: 0.0 for p in pairs}
    for n in range(len(pairs) + 1):
        for c in itertools.combinations(pairs, n):
            if len({(p[0], p[1]) for p in c}) == len(c) == len({p[2] for p in c}):
                w = float(np.prod([p[3] for p in c])) if c else 1.0
                total += w
                for p in c:
                    part[p[:3]] += w
    return {(k[0], k[2]): v / total for k, v in part.items()}


def test_marginals_on_trees_are_exact_and_loops_close(spark):
    tree = [("a", 1, "x", 2.0), ("a", 1, "y", 0.5), ("b", 1, "y", 3.0), ("c", 1, "z", 1.5)]
    got = {(r["left_id"], r["right_id"]): r["probability"] for r in matching.marginals(spark.createDataFrame(tree, "left_id string, left_slot int, right_id string, odds double"), rounds=60, tolerance=1e-9).collect()}
    for k, v in exact(tree).items():
        assert abs(got[k] - v) < 1e-4
    loop = [("a", 1, "x", 50.0), ("a", 1, "y", 1.0), ("b", 1, "x", 1.0), ("b", 1, "y", 50.0)]
    got = {(r["left_id"], r["right_id"]): r["probability"] for r in matching.marginals(spark.createDataFrame(loop, "left_id string, left_slot int, right_id string, odds double")).collect()}
    assert got[("a", "x")] > 0.9 and got[("a", "y")] < 0.1


def test_match_drafts(spark):
    seasons = spark.createDataFrame(
        [("p1", "Ben Okafor", 2004, "university|c"), ("p1", "Benjamin Okafor", 2005, "university|c"), ("p2", "Dane Mortlake", 2005, "am|k"), ("p3", None, 2005, "am|k"), ("p4", "Lone Wolfe", None, None)],
        "left_id string, name string, year int, institution string")
    filler = [(100 + i, f"v{100 + i}", f"First{chr(97 + i % 20)} Last{chr(97 + i % 23)}{chr(97 + i % 19)}", 2000 + i % 20, f"university|p{i % 50}") for i in range(600)]
    d = spark.createDataFrame(
        [(1, "a", "Okafor, Benjamin", 2005, "university|c"), (2, "a", "B. Okafor", 2005, "university|c"), (3, "b", "Dane Mortlake", 2006, None),
         (4, "c", "Benjamin Okafor", 2001, "university|c"), (5, "d", None, 2005, "am|k")] + filler,
        "ord long, pick_id string, name string, year int, institution string")
    got = {(r["left_id"], r["ord"]): r["confidence"] for r in matching.match_drafts(seasons, d).collect()}
    assert {k for k, v in got.items() if v > 0.5 and k[1] < 100} >= {("p1", 1), ("p1", 2)}
    assert ("p1", 4) not in got and not any(k[0] in ("p3", "p4") for k in got)
    assert matching.match_drafts(seasons.limit(0), d).count() == 0


def test_match_drafts_with_initial_and_mistyped_surname(spark):
    seasons = spark.createDataFrame(
        [("p1", "Caleb Tahppaski", 2005, "university|c"), ("p2", "Darius Stutmatti", 2007, "university|d"), ("p3", "Emmett Bastassen", 2009, None)],
        "left_id string, name string, year int, institution string")
    filler = [(100 + i, f"v{100 + i}", f"First{chr(97 + i % 20)} Last{chr(97 + i % 23)}{chr(97 + i % 19)}", 2000 + i % 20, f"university|p{i % 50}") for i in range(600)]
    d = spark.createDataFrame(
        [(1, "a", "C. Thappaski", 2005, "university|c"), (2, "b", "Daius Sturmatti", 2007, "university|d"), (3, "c", "Emett Bastassen", 2009, "college|x")] + filler,
        "ord long, pick_id string, name string, year int, institution string")
    got = {(r["left_id"], r["ord"], r["level"]) for r in matching.match_drafts(seasons, d).collect() if r["confidence"] > 0.5}
    assert got >= {("p1", 1, "K"), ("p2", 2, "K")}
    assert any(r["level"] == "I" and r["left_id"] == "p3" and r["ord"] == 3 for r in matching.candidates(seasons, d).collect())


def test_places_cut_short_at_any_length_and_further_hubs_of_a_form(spark):
    values = ["Winskwater State University", "Winskw. State", "Winskwat. St. Univ.", "Winskwater State", "Hollinbrook Institute of Technology", "Hollin. Tech",
              "Ashefod High School", "Ashefod High School ", "Ashefod HS", "Ashefod H.S.", "Ashford High School", "Ashford HS", "Axhfozd High School"]
    got = institutions(spark, values)
    assert len({got[v] for v in values[:4]}) == 1 and got["Hollin. Tech"] == got["Hollinbrook Institute of Technology"]
    assert got["Axhfozd High School"] == got["Ashford High School"]  # the best supported name under the form is three letters off


def test_learned_priors(spark):
    from dugout.llm import evidence

    rng = np.random.default_rng(3)
    rows = []
    for cell, true in (("a", 4000), ("b", 0), ("c-", 0)):  # 40,000 rows a cell: 0.1, 0 and the control
        rows += [(cell, "E", float(x)) for x in 10 ** rng.uniform(-5, -3, true)]
        rows += [(cell, "E", float(x)) for x in 10 ** rng.uniform(-3, -1, 40_000) if rng.random() < x]
    df = spark.createDataFrame(rows, "cell string, level string, expected double")
    prior, share = evidence.learn(df, {"a": 0.01, "b": 0.01, "c-": 0.0}, {"E": 0.9}, lambda c: 40_000.0, lambda c: "c-")
    assert 0.07 < prior["a"] < 0.15 and prior["b"] < 0.01 and "c-" not in prior and share["E"] > 0.5
    assert evidence.learn(df.limit(0), {"a": 0.01}, {"E": 0.9}, lambda c: 0.0)[0]["a"] == 0.01


def test_crowded_rewritings_lose_no_link(spark, monkeypatch):
    """Rows of a crowded rewriting meet on finer ones instead: only pairs of its own level and of two institutions are not met."""
    from pyspark.sql import functions as F

    names = ["Ben Okafor", "Benjamin Okafor", "Bruno Okafor", "Brad Okafor", "Benjamin Okafr", "B. Okafor"]
    data = [(i, names[i % 6], 2000 + i % 7, f"university|q{i % 5}") for i in range(60)] + [(100, "Dane Mortlake", 2001, None), (101, "Dane Mortlakke", 2002, "am|x")]
    base = drafts(spark, data).withColumn("n", spellings.rewritten("name"))
    rows = base.select("ord", "year", "institution", F.posexplode("n").alias("k", "reading"))
    met = lambda: {(r["a"], r["b"]) for r in spellings.meetings(rows, 62.0, 7.0).collect()}
    monkeypatch.setattr(spellings, "most_rows", lambda level, n, years, share=1.0: F.lit(1e9))
    want = met()
    monkeypatch.setattr(spellings, "most_rows", lambda level, n, years, share=1.0: F.lit(5.0 if isinstance(share, float) else 1000.0))
    got = met()
    formal = ["benjamin", "benjamin", "bruno", "brad", "benjamin", "b"]
    lost = want - got
    assert (100, 101) in got and got <= want and lost
    for a, b in lost:
        assert formal[a % 6] != formal[b % 6] and (names[a % 6].endswith("fr") or names[b % 6].endswith("fr")) and a % 5 != b % 5


def test_rows_met_in_runs_are_all_met(spark, monkeypatch):
    """Pairs of p1 and p3 are met run by run of years; the runs give the pairs that one run gives, and first names that cannot agree are turned down."""
    names = ["Ben Okafor", "Benjamin Okafor", "Bruno Okafor", "B. Okafor", "Benjamin Okafr", "Marlow Tessing", "Marlowe Tessing", "Quentin Tessing"]
    base = drafts(spark, [(i, names[i % 8], 2000 + i * 7 % 24, None) for i in range(96)]).withColumn("n", spellings.rewritten("name"))
    rows = base.select("ord", "year", "institution", F.posexplode("n").alias("k", "reading"))
    people = spark.createDataFrame([(i, [2000 + i % 24, 2001 + i % 24]) for i in range(96)], "row bigint, years array<int>").join(
        base.select(F.col("ord").alias("row"), F.posexplode("n").alias("k", "reading")), "row")
    got = []
    for at_a_time in (1000, 8):
        monkeypatch.setattr(spellings, "AT_A_TIME", at_a_time)
        got.append((sorted(spellings.meetings(rows, 96.0, 24.0).collect()), sorted(matching.distinct_pairs(people, base, 96.0).collect())))
    runs = spellings.slices(base, 5, 96.0)
    assert 1 < len(runs) <= spellings.RUNS and runs[0][0] == 400 and runs[-1][1] == 404
    assert got[0] == got[1] and got[0][0] and got[0][1]
    assert len({r["year"] for r in base.collect()}) == 24 and len(spellings.slices(base.selectExpr("year * 1000 year"), 5, 96.0)) <= spellings.RUNS
    name = lambda i: names[i % 8]
    assert not any({name(r["a"]), name(r["b"])} == {"Marlow Tessing", "Quentin Tessing"} for r in got[0][0])
    assert any({name(r["a"]), name(r["b"])} == {"Marlow Tessing", "Marlowe Tessing"} for r in got[0][0])


def test_every_near_entry_and_ambiguity(spark):
    ref = spark.createDataFrame([("Ashwick College", "A"), ("Ashwock College", "B"), ("Ruddmere College", "C")], "name string, acronym string")
    v = spark.createDataFrame([("Ashwxck College",), ("Rudmere College",)], "value string")
    near = {(r["value"], r["entry"]) for r in canonical.near_entries(v, ref).collect()}
    assert near == {("Ashwxck College", "Ashwick College"), ("Ashwxck College", "Ashwock College"), ("Rudmere College", "Ruddmere College")}
    got = {r["value"]: (r["entry"], r["n_near"], r["ambiguous"]) for r in canonical.map_values(v, ref).collect()}
    assert got == {"Ashwxck College": ("Ashwick College", 2, True), "Rudmere College": ("Ruddmere College", 1, False)}


def test_places_are_learned_from_every_name_of_the_list(spark, monkeypatch):
    """A list of more than 20,000 names: each of its places is known, so that none is taken for another one mistyped."""
    letters = "abcdefghij"
    place = lambda i: "q" + "".join(letters[int(x)] for x in f"{i:05d}") + "x"
    names = spark.createDataFrame([(f"University of {place(i).capitalize()}", None) for i in range(20_005)] + [(None, "X")], "name string, acronym string")
    seen = {}

    def searcher(entries, morph):
        seen["known"] = morph.known
        return lambda batches: iter(())

    monkeypatch.setattr(canonical, "_searcher", searcher)
    values = spark.createDataFrame([("Univ. of Qaaaaax",)], "value string")
    assert canonical.near_entries(values, names).count() == 0
    assert seen["known"] == {place(i) for i in range(20_005)}


def test_a_crowd_of_namesakes_loses_no_candidate(spark):
    """So many drafts of one name that chance explains a pair by name alone; the school still counts, and no pair is left out."""
    drafts = spark.range(1500).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("pick_id"), F.lit("Jon Smithson").alias("name"), F.lit(2000).alias("year"),
                                      F.when(F.col("id") == 7, "college|tech").otherwise(F.concat(F.lit("college|x"), "id")).alias("institution"))
    seasons = spark.createDataFrame([("sa1", "Jon Smithson", 2000, "college|tech")], "left_id string, name string, year int, institution string")
    c = matching.candidates(seasons, drafts)
    assert c.count() == 1500
    assert c.orderBy(F.desc("odds")).first()["ord"] == 7


def _sent(spark, since):
    """The trees of the broadcasts of all plans run since then."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    out = []
    for i in range(ran.size()):
        if ran.apply(i).executionId() <= since:
            continue
        lines = ran.apply(i).physicalPlanDescription().split("== Initial Plan ==")[0].split("\n")
        depth = [next((k for k, c in enumerate(x) if c.isalpha()), 0) for x in lines]
        for k in [k for k, x in enumerate(lines) if "BroadcastExchange" in x]:
            out.append("\n".join(itertools.takewhile(lambda x: x.strip(), [lines[k]] + [x for _, x in itertools.takewhile(lambda y: y[0] > depth[k], zip(depth[k + 1:], lines[k + 1:], strict=True))])))
    return max([since, *(ran.apply(i).executionId() for i in range(ran.size()))]), out


def test_rows_that_were_not_measured_are_not_sent_through_the_driver(spark):
    """No exploded rows, nor packed tables, are broadcast because the planner takes them for small; what a shuffle has measured may be."""
    since, _ = _sent(spark, -1)
    values = ["Calvenia", "U. of Calvnia", "University of Calvenia", "Ruddmere Col.", "Ruddmere College", "Wrestcrest CC", "Wrestcrst C.C."]
    assert len({institutions(spark, values)[v] for v in values}) == 3
    people = drafts(spark, [(i, f"{n} Okafor{chr(97 + i % 7)}", 2000 + i % 9, f"university|p{i % 5}") for i, n in enumerate(["Benjamin", "Ben", "Bruno"] * 40)])
    links = spellings.draft_evidence(people).select("a", "b")
    assert graph.components(links).count()
    since, sent = _sent(spark, since)
    assert not [x for x in sent if "Shuffle" not in x], sent
    pairs = spark.createDataFrame([([1, 2], [3])], "hs array<bigint>, ts array<bigint>")
    heads, tails = spellings.rarity(people.withColumn("n", spellings.rewritten("name")))
    assert "Broadcast" not in spellings.chances(pairs, heads, tails)._jdf.queryExecution().executedPlan().toString()


def test_persons_are_not_sent_through_the_driver(spark, data, monkeypatch):
    """Labels and rows of persons grow with the rows; a shuffle measures them compressed, so they are not broadcast on its word either."""
    cuts, real = [], queries.cut
    monkeypatch.setattr(queries, "cut", lambda df: cuts.append(df) or real(df))
    found = queries.p1_found(spark, data)
    persons = queries.p1_persons(spark, data)
    people = spark.createDataFrame([(1, 2000, 1, 1), (2, 2000, 1, 1), (3, 2000, 1, 2)], "ord long, year int, round int, pick int")
    same = spellings.same_pick(people)
    assert [tuple(r) for r in same.collect()] == [(1, 2)]
    ran = [d for d in cuts if "component" in d.columns] + [found, persons, same]
    assert len(ran) == 4
    for d in ran:
        assert d.collect() is not None
        assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
