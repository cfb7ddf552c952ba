"""Every query that has a SQL twin gives its rows on the smallest tables."""

import os
import re
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry


def normal(columns, rows):
    """Rows as sorted texts, columns by name; null and NaN are told apart."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if v is None:
            return "-"
        if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool):
            return "NaN" if v != v else f"{float(v):.6g}"
        return str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{data}/{f}')")
    return c


CORE = sorted(k for k in entry.oracle_sql() if k in {n for m in entry._all() if ".llm." not in m.__name__ for n in m.QUERIES})


#: Queries whose only group is the whole table: they join one row, its threshold.
ONE_ROW = {"random_split", "split_for_two_targets"}


@pytest.mark.parametrize("name", CORE)
def test_same_rows(spark, data, db, name):
    got, want = entry.queries()[name](spark, data), db.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got.columns, got.collect()) == normal(want.columns, want.fetchall())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert name in ONE_ROW or not re.search("NestedLoop|Cartesian", plan)


def test_entry(spark, data):
    assert entry.entry(spark).columns[0] == "year"
