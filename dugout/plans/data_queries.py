"""Queries of the general data problems: orphan references (p4) and drifting schemas (p6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.operators import references as R
from dugout.operators import schema_drift as D
from dugout.sources.tables import table

#: The years for which every conference should have a ranking.
RANKED_YEARS = [2021, 2022, 2023, 2024, 2025]


def _reference_sets(spark: SparkSession, d: str) -> list[tuple[str, dict]]:
    pitching, teams = table(spark, d, "pitching_combined_all"), table(spark, d, "unique_teams")
    stats, conf = table(spark, d, "ncaabb_dataset"), table(spark, d, "missing_conf")
    ranks = table(spark, d, "conference_rankings")
    yearly = conf.select("row_id", "conf name", F.explode(F.lit(RANKED_YEARS)).alias("year"))
    return [
        ("pitching_combined_all", dict(refs=pitching, key=F.col("team"), period=F.col("year"), targets=teams,
                                       target_key=F.col("Acronym"), valid_from=F.col("first_year"), valid_to=F.col("last_year"))),
        ("ncaabb_dataset", dict(refs=stats, key=F.col("league"), period=F.col("year"), targets=conf, target_key=F.col("league name"))),
        ("missing_conf", dict(refs=yearly, key=F.col("conf name"), period=F.col("year"), targets=ranks,
                              target_key=F.col("conference"), valid_from=F.col("year"), valid_to=F.col("year"))),
        ("conference_rankings", dict(refs=ranks, key=F.col("conference"), period=F.col("year"), targets=conf, target_key=F.col("conf name"))),
    ]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        R.orphan_rows(row_id=F.col("row_id"), **kw).select(F.lit(name).alias("source_table"), "row_id", "period")
        for name, kw in _reference_sets(spark, d)
    ]
    return reduce(DataFrame.unionByName, parts)


def p4_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        R.orphan_counts(**kw).groupBy(F.col("_period").alias("period"))
        .agg(F.count(F.lit(1)).alias("n_keys"), F.sum("_n").alias("n_rows"))
        .select(F.lit(name).alias("source_table"), "period", "n_keys", "n_rows")
        for name, kw in _reference_sets(spark, d)
    ]
    return reduce(DataFrame.unionByName, parts)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return D.schema_changes(table(spark, d, "batting_files")).select("file_id", "column_name", "change")


def p6_change_report(spark: SparkSession, d: str) -> DataFrame:
    return D.schema_changes(table(spark, d, "batting_files")).groupBy("feed", "kind", "season", "change").agg(
        F.count(F.lit(1)).alias("n"))


def p6_name_differences(spark: SparkSession, d: str) -> DataFrame:
    return D.name_differences(table(spark, d, "batting_files"))


#: Kinds of the columns that every season has; all further ones come from the files.
UNIFIED = {
    "name": "string", "team": "string", "age": "int", "playerid": "id", "year": "season",
    **{c: "int" for c in "g ab pa h 2b 3b hr r rbi bb so hbp sf sh gdp sb cs wrc+".split()},
    **{c: "double" for c in "avg bb% k% bb/k obp slg ops iso spd babip wsb wrc wraa woba".split()},
}


def p6_unified(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "batting_files")
    plan = D.unify(lines)
    kinds = {**plan.columns, **UNIFIED}
    return D.unified_table(lines, plan, [*UNIFIED, *(c for c in kinds if c not in UNIFIED)], kinds)


_N = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"


def _p4_sql(select: str, tail: str) -> str:
    n = _N.format
    return f"""
WITH f AS (
  SELECT 'pitching_combined_all' AS source_table, p.row_id, p.year AS period, {n('p.team')} AS k FROM pitching_combined_all p
  WHERE {n('p.team')} <> '' AND NOT EXISTS (SELECT 1 FROM unique_teams u WHERE {n('u."Acronym"')} = {n('p.team')}
    AND u.first_year <= p.year AND (u.last_year IS NULL OR u.last_year >= p.year))
  UNION ALL
  SELECT 'ncaabb_dataset', b.row_id, b.year, {n('b.league')} FROM ncaabb_dataset b
  WHERE {n('b.league')} <> '' AND NOT EXISTS (SELECT 1 FROM missing_conf m WHERE {n('m."league name"')} = {n('b.league')})
  UNION ALL
  SELECT 'missing_conf', m.row_id, y.y, {n('m."conf name"')} FROM missing_conf m, (SELECT unnest([2021,2022,2023,2024,2025]) AS y) y
  WHERE {n('m."conf name"')} <> '' AND NOT EXISTS (SELECT 1 FROM conference_rankings r WHERE {n('r.conference')} = {n('m."conf name"')} AND r.year = y.y)
  UNION ALL
  SELECT 'conference_rankings', r.row_id, r.year, {n('r.conference')} FROM conference_rankings r
  WHERE {n('r.conference')} <> '' AND NOT EXISTS (SELECT 1 FROM missing_conf m WHERE {n('m."conf name"')} = {n('r.conference')})
)
SELECT {select} FROM f {tail}"""


QUERIES = {
    "p4_found": p4_found,
    "p4_orphan_counts": p4_orphan_counts,
    "p6_found": p6_found,
    "p6_change_report": p6_change_report,
    "p6_name_differences": p6_name_differences,
    "p6_unified": p6_unified,
}

ORACLE = {
    "p4_found": _p4_sql("source_table, row_id, CAST(period AS INTEGER) AS period", ""),
    "p4_orphan_counts": _p4_sql(
        "source_table, CAST(period AS INTEGER) AS period, count(DISTINCT k) AS n_keys, count(*) AS n_rows", "GROUP BY source_table, period"),
    "p6_name_differences": """
WITH h AS (SELECT file_id, feed, kind, season, list_distinct([lower(trim(x)) for x in string_split(line, ',')]) AS names FROM batting_files WHERE line_no = 0 AND line IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line) = 1),
o AS (SELECT file_id, names, lag(names) OVER (PARTITION BY feed, kind ORDER BY season NULLS FIRST, file_id) AS old FROM h)
SELECT file_id, unnest([x for x in names if NOT list_contains(old, x)]) AS column_name, 'came' AS side FROM o WHERE old IS NOT NULL
UNION ALL SELECT file_id, unnest([x for x in old if NOT list_contains(names, x)]), 'went' FROM o WHERE old IS NOT NULL""",
}
