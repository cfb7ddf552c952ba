import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dugout.llm import person_names as P
from dugout.llm import school_names as S


@pytest.mark.parametrize("a, b", [
    ("University of Calvenia", "Calvenia, Univ. of"), ("Kordane A&M University", "Kordane Agricultural & Mechanical"),
    ("Penwyth Institute of Technology", "penwyth  tech"), ("Saint Perrin University", "St. Perrin"), ("Merridale State University", "Merridale St. U."),
    ("University of Southern Wexmoor", "S. Wexmoor (WX)"), ("Falkhollow Community College", "CC of Falkhollow"), ("Roskwick Military Academy", "Roskwick M.A."),
    ("University of Ithmarra-Yarlwater", "Ithmarra — Yarlwater campus"), ("Grimsbury Christian University", "Christian Univ. of Grimsbury"),
    ("Fenskwick High School", "FENSKWICK H.S."), ("Lindodale Junior College", "Lindodale J.C."), ("Ruddridge University", "Ruddridge Uinv.")])
def test_same_key(a, b):
    assert S.parse(a).key == S.parse(b).key


@pytest.mark.parametrize("value", [None, "", "  ", "TBD", "see notes", "N/A", "-", "?"])
def test_placeholders(value):
    assert S.parse(value) is None and S.rewritings(value) == []


def test_unlike_forms_differ():
    keys = {S.parse(x).key for x in ("Caldstead College", "Caldstead University", "Caldstead Junior College", "Caldstead State University", "Caldstead High School", "Southern Caldstead")}
    assert len(keys) == 6


def test_one_typing_error_shares_a_form():
    rng, name = random.Random(3), "Trevobury University"
    for _ in range(60):
        i = rng.randrange(9)
        typo = rng.choice([name[:i] + name[i + 1:], name[:i] + name[i] + name[i:], name[:i] + "x" + name[i + 1:], name[:i] + name[i + 1] + name[i] + name[i + 2:]])
        assert {f for f, _ in S.rewritings(name)} & {f for f, _ in S.rewritings(typo)}, typo


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_parse_never_fails(s):
    S.rewritings(s)
    P.rewritings(s)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_osa_against_table(a, b):
    m = [[max(i, j) if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            m[i][j] = min(m[i - 1][j] + 1, m[i][j - 1] + 1, m[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                m[i][j] = min(m[i][j], m[i - 2][j - 2] + 1)
    assert S.osa(a, b, 10) == m[-1][-1]
    assert S.osa(a, b, 1) == min(2, m[-1][-1]) or S.osa(a, b, 1) > 1


@pytest.mark.parametrize("a, b", [
    ("Benjamin Okafor", "Ben Okafor"), ("Okafor, Benjamin J.", "benjamin okafor"), ("B.J. Okafor", "Benjamin Okafor"), ("Okafor Benjamin", "Benjamin Okafor"),
    ("Benjamin (Ben) Okafor III", "Benjamin Ókafor"), ("Benjamin Okafr", "Benjamin Okafor"), ("BJ Okafor", "Benny Okafor")])
def test_person_forms_meet(a, b):
    meet = lambda n: {(i, t) for k, r in enumerate(P.rewritings(n)) for i in P.initials(r[0], r[4]) for t in P.tails(r[2], k == 0)}
    assert meet(a) & meet(b)


def test_person_parse():
    assert P.parse("Okafor, Benjamin J.") == ("benjamin", "j", "okafor", "", True)
    assert P.parse("Benjamin 'Ben' Okafor Jr.")[:4] == ("benjamin", "", "okafor", "jr")
    assert P.rewritings(None) == [] and P.rewritings("") == []
    assert P.formals("mason") == ("mason",) and "jason" in P.formals("jaspn")


def test_parts_of_rewritings_are_the_same_in_columns(spark):
    from pyspark.sql import functions as F

    from dugout.llm import spellings

    names = ["Benjamin Okafor", "Okafor, Ben", "B. Li", "ÓKAFOR BENJAMIN", "J.P. O'Brien-Smythe Jr.", "x", "", None, "Ana Ng", "Okafor " * 40]
    df = spark.createDataFrame([(n,) for n in names], "name string").select(F.col("name").alias("typed"), F.posexplode(spellings.rewritten("name")).alias("k", "reading"))
    got = df.select("typed", "k", "reading.letters", spellings.initials(F.col("reading")).alias("i"), spellings.tails(F.col("reading"), F.col("k")).alias("t")).collect()
    want = {(n, k): r for n in names for k, r in enumerate(P.rewritings(n))}
    assert {(r["typed"], r["k"]) for r in got} == set(want)
    for r in got:
        w = want[r["typed"], r["k"]]
        assert sorted(r["i"]) == P.initials(w[0], w[4]) and sorted(r["t"]) == P.tails(w[2], r["k"] == 0) and r["letters"] == w[5]


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefgh", min_size=2, max_size=8), st.integers(0, 7), st.sampled_from("abxyz"))
def test_letters_of_mistyped_first_names_are_near(s, i, c):
    one = s[:i] + c + s[i + 1:]
    two = one[:1] + c + one[2:]
    bits = lambda x: P.letters(x, (x,))
    assert len(two) < 2 or bin(bits(s) ^ bits(two)).count("1") <= 4
