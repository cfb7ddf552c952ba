"""Empty tables give empty results; nulls in any column, repeated rows and clashing further columns do no harm."""

import pytest
from pyspark.sql import functions as F

from dugout.llm import queries
from dugout.sources.tables import table as read

KEYS = {"all_drafts": "_ord", "documents": "doc_id", "eval_items": "item_id"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, data, monkeypatch, name):
    monkeypatch.setattr(queries, "table", lambda s, d, t: read(s, d, t).limit(0))
    assert queries.QUERIES[name](spark, data).count() == 0


def holed(spark, d, name):
    """A table in which a third of the values of each column is gone and five rows come twice, with columns of other meanings."""
    t = read(spark, d, name)
    key = KEYS.get(name, "row_id")
    if key not in t.columns:
        return t
    gone = lambda c: F.abs(F.xxhash64(F.lit(c), F.col(key))) % 3 == 0
    out = t.select(*[F.col(f"`{c}`") if c == key else F.when(~gone(c), F.col(f"`{c}`")).alias(c) for c in t.columns])
    extra = {"institution": F.lit("clash"), "spelling": F.lit("clash"), "level": F.lit("E"), "h": F.lit(1), "w": F.lit("x")}
    return out.unionByName(out.limit(5)).withColumns({k: v for k, v in extra.items() if k not in t.columns})


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p5_wpct_by_league", "p7_found", "p8_shares", "p9_found"])
def test_nulls_in_any_column(spark, data, monkeypatch, name):
    monkeypatch.setattr(queries, "table", holed)
    rows = queries.QUERIES[name](spark, data).collect()
    assert rows and len(set(rows)) == len(rows)
