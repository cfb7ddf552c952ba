"""String functions as Column expressions; all stay inside generated code except the token-set ratio."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of null in CSV files.
NA_TOKENS = ["", "NA", "N/A", "NAN", "NULL", "-", "--", "#N/A", "NONE"]


def clean(c: Column, fold_dashes: bool = False) -> Column:
    """Null to '', lower case, ``&`` to ``and``, ``univ``/``univ.`` to ``university``, without ``college of``, blanks single."""
    t = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    if fold_dashes:
        t = F.regexp_replace(t, "[‐-―]", "-")
    t = F.replace(t, F.lit("&"), F.lit("and"))
    t = F.regexp_replace(t, r"\buniv\b\.?", "university")
    t = F.replace(t, F.lit("college of"), F.lit(""))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def split_team_league(c: Column) -> tuple[Column, Column]:
    """Team and league of ``Team (League)``; both null unless both brackets are there. A second bracket is not read."""
    ok = c.contains("(") & c.contains(")")
    parts = F.split(c, r"\(")
    team = F.trim(parts[0])
    league = F.trim(F.replace(F.get(parts, F.lit(1)), F.lit(")"), F.lit("")))
    return F.when(ok, team), F.when(ok, league)


def na_to_null(c: Column) -> Column:
    """A CSV null token becomes null; other values are trimmed."""
    t = F.trim(c)
    return F.when(~F.upper(t).isin(NA_TOKENS), t)


def to_number(c: Column) -> Column:
    """Lenient number: null where the text is none, is NaN or infinite."""
    x = c.cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def win_loss(c: Column) -> tuple[Column, Column]:
    """Wins and losses of ``W-L``."""
    ok = c.rlike(r"^\s*\d+\s*-\s*\d+\s*$")
    parts = F.split(c, "-")
    return F.when(ok, F.trim(parts[0])).try_cast("int"), F.when(ok, F.trim(F.get(parts, F.lit(1)))).try_cast("int")


def _indel_ratio(a: str, b: str) -> float:
    """100 (1 - indel distance / total length) by a bit-parallel longest common subsequence."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & masks.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    lcs = len(a) - bin(row).count("1")
    return 100.0 * 2 * lcs / (len(a) + len(b))


def token_set(a: str | None, b: str | None) -> float:
    """Token-set ratio of two strings, 0 to 100; 0 if either has no token."""
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = _indel_ratio(with_left, with_right)
    if both:
        best = max(best, _indel_ratio(both, with_left), _indel_ratio(both, with_right))
    return best


def _token_set_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_set_ratio(a: Column, b: Column) -> Column:
    """Arrow-batched token-set ratio; feed it distinct pairs."""
    return F.pandas_udf(_token_set_series, "double")(a, b)
