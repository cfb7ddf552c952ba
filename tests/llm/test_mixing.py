import random

from dugout.llm import mixing as M


def sized(spark, n=3000):
    rng = random.Random(1)
    rows = [(i, rng.choice(["big"] * 8 + ["small", None]), rng.randrange(1, 400)) for i in range(n)] + [(10**6, "untargeted", 50), (10**6 + 1, "big", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def targets(spark):
    return spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    rows, s = sized(spark)
    p = M.plan(s, targets(spark))
    rep = {r["source"]: r for r in M.report(M.mixture(s, p), p).collect()}
    have = {k: sum(t for _, x, t in rows if x == k) for k in ("big", "small")}
    size = min(have["big"] / 0.6, 3 * have["small"] / 0.4)
    for k, share in (("big", 0.6), ("small", 0.4)):
        # whole documents are chosen, so a budget is missed by less than one document
        assert 0 <= rep[k]["budget"] - rep[k]["chosen_tokens"] < 400
        assert abs(rep[k]["chosen_tokens"] - share * size) < 402 and rep[k]["most_times"] <= rep[k]["max_repeats"]
    assert rep["absent"]["chosen_tokens"] == 0 and "untargeted" not in rep


def test_thresholds_against_sorting(spark):
    rows, s = sized(spark, 800)
    hashes = {r["doc_id"]: r["h"] for r in s.select("doc_id", M.place("doc_id").alias("h")).collect()}
    total = sum(t for _, x, t in rows if x == "big")
    last = set()
    for share in (0.1, 0.5, 0.9):
        p = M.plan(s, targets(spark), share * total / 0.6)
        got = {r["doc_id"] for r in M.mixture(s, p).where("source = 'big'").collect()}
        want, used = set(), 0
        for d, t in sorted(((d, t) for d, x, t in rows if x == "big" and t), key=lambda z: hashes[z[0]]):
            used += t
            if used > int(share * total + 1e-6):
                break
            want.add(d)
        assert got == want and last <= got  # nested
        last = got


def test_tokens_and_edges(spark):
    docs = spark.createDataFrame([(1, "a", "hello world"), (2, None, None), (3, "a", ""), (4, "a", "x" * 20_000), (5, "a", "日本語")], "doc_id long, source string, text string")
    got = {r["doc_id"]: r["tokens"] for r in M.with_tokens(docs).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 100 and got[5] > 0
    empty = spark.createDataFrame([], "doc_id long, source string, tokens long")
    p = M.plan(empty, targets(spark))
    assert M.mixture(empty, p).count() == 0 and {r["chosen_tokens"] for r in M.report(M.mixture(empty, p), p).collect()} == {0}
