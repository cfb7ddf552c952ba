import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dugout.llm import percentiles as P

EDGE = [0.0, -0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 0.1, 1 / 3, 2.0**52 + 1, 1.9999999999999998, 3.141592653589793, -7e-310]


def test_key_round_trip_and_order(spark):
    rng = np.random.default_rng(5)
    vals = EDGE + list(rng.normal(0, 1, 300)) + list(10.0 ** rng.uniform(-300, 300, 300) * rng.choice([-1, 1], 300))
    rows = spark.createDataFrame([(float(v),) for v in vals], "v double").select("v", P.order_key(F.col("v")).alias("k")).withColumn("back", P.key_value(F.col("k"))).collect()
    assert all(r["back"] == r["v"] for r in rows)
    s = sorted(rows, key=lambda r: r["v"])
    assert all(a["k"] <= b["k"] for a, b in zip(s, s[1:]))
    assert all((a["v"] == b["v"]) == (a["k"] == b["k"]) for a, b in zip(s, s[1:]))


def brute(vals, q):
    s = sorted(vals)
    return s[max(1, min(len(s), math.ceil(round(q * len(s), 9)))) - 1]


@pytest.fixture()
def frame(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.normal(3, 2, 500)] + [("b", float(x)) for x in rng.integers(0, 4, 400)] + [("c", -1.5)]
    bad = [("a", None), ("a", float("nan")), ("b", float("inf")), (None, 1.0), ("d", None)]
    return rows, spark.createDataFrame(rows + bad, "grp string, val double").withColumn("g", F.lit("clash")).withColumn("v", F.lit(1))


@pytest.mark.parametrize("bits", [8, 16])
def test_exact(frame, bits):
    rows, df = frame
    qs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(r["g"], r["q"]): r for r in P.percentiles([P.usable(df, F.col("grp"), F.col("val"))], qs, bits=bits, depth=64 // bits).collect()}
    assert {k[0] for k in got} == {"a", "b", "c"}
    for (g, q), r in got.items():
        assert r["value"] == brute([v for x, v in rows if x == g], q) and r["error"] == 0


def test_slices_and_bound(frame):
    rows, df = frame
    u = P.usable(df, F.col("grp"), F.col("val"))
    parts = [u.where(F.pmod(F.xxhash64("v"), F.lit(3)) == i) for i in range(3)]
    a = {(r["g"], r["q"]): r["value"] for r in P.percentiles(parts, [0.25, 0.5]).collect()}
    b = {(r["g"], r["q"]): r["value"] for r in P.percentiles([u], [0.25, 0.5]).collect()}
    assert a == b
    for r in P.percentiles([u], [0.25, 0.5], depth=1).collect():
        assert r["value"] <= a[(r["g"], r["q"])] + 1e-300 and abs(a[(r["g"], r["q"])] - r["value"]) <= abs(r["error"]) + 1e-12
    assert P.percentiles([u.limit(0)], [0.5]).count() == 0


def test_the_stated_error_of_the_query_holds(spark, data):
    from dugout.llm import queries

    exact = {(r["year"], r["q"]): r for r in queries.p5_era_by_year(spark, data).collect()}
    near = {(r["year"], r["q"]): r for r in queries.p5_era_bounded_error(spark, data).collect()}
    assert near.keys() == exact.keys() and any(r["error"] > 0 for r in near.values())
    for k, r in near.items():
        assert r["n"] == exact[k]["n"] and abs(r["value"] - exact[k]["value"]) <= abs(r["error"]) + 1e-9
