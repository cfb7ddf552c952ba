import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dugout.functions import numeric as N
from dugout.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("value, want", [
    (None, ""), (" Univ. of  A&M ", "university of aandm"), ("College of Charleston", "charleston"), ("a  b", "a b"), ("", "")])
def test_clean(spark, value, want):
    assert one(spark, T.clean, value) == want


def test_split_team_league(spark):
    df = spark.createDataFrame([("Miami (FL) (ACC)",), ("no brackets",), (None,)], "x string")
    team, league = T.split_team_league(F.col("x"))
    assert [tuple(r) for r in df.select(team, league).collect()] == [("Miami", "FL"), (None, None), (None, None)]


@pytest.mark.parametrize("value, want", [("1.5", 1.5), ("abc", None), ("NaN", None), ("Infinity", None), (None, None), (" 7 ", 7.0)])
def test_to_number(spark, value, want):
    assert one(spark, T.to_number, value) == want


def test_win_loss(spark):
    df = spark.createDataFrame([("41-12",), ("x",), (None,)], "x string")
    w, x = T.win_loss(F.col("x"))
    assert [tuple(r) for r in df.select(w, x).collect()] == [(41, 12), (None, None), (None, None)]


def test_token_set_known():
    assert T.token_set("new york mets", "new york mets vs braves") == 100.0
    assert T.token_set("", "a") == 0.0
    assert T.token_set(None, "a") == 0.0
    assert T.token_set("abc", "abd") == pytest.approx(66.6667, abs=1e-3)


words = st.lists(st.text("abcde", min_size=1, max_size=5), min_size=1, max_size=5).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_token_set_properties(a, b):
    s = T.token_set(a, b)
    assert 0 <= s <= 100
    assert s == T.token_set(b, a)
    assert s == T.token_set(" ".join(reversed(a.split())), b)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_indel_ratio_against_table(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    want = 100.0 if not a and not b else 200.0 * m[-1][-1] / (len(a) + len(b))
    assert T._indel_ratio(a, b) == pytest.approx(want)


def test_numeric(spark):
    df = spark.createDataFrame([(0.0625, 3.0, 0.0)], "a double, b double, c double")
    r = df.select(N.round_even(F.col("a"), 3), N.safe_divide(F.col("b"), F.col("c")), N.expectation(F.col("c"), F.col("b"), 1.83)).first()
    assert tuple(r) == (0.062, None, 0.0)


def test_corr_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(N.corr_or_null(F.col("a"), F.col("b"))).first()[0] is None
    assert df.where("a > 5").agg(N.rmse(F.col("a"), F.col("b"))).first()[0] is None
