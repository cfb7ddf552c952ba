"""Queries of the training-data problems tagged llm, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.llm import canonical, graph, language, leakage, matching, mixing, percentiles, spellings
from dugout.session import cut, unsent
from dugout.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# ------------------------------------------------------------------ 1: variant spellings of names


def _listed(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "unique_teams")
    return t.select(F.col("Acronym").alias("acronym"), F.col("Full Name").alias("spelling"))


def _institutions(spark: SparkSession, d: str) -> DataFrame:
    drafts, known = table(spark, d, "all_drafts"), table(spark, d, "missing_schools")
    parts = drafts.select(F.col("Drafted From").alias("spelling"))
    for c in ("Old name", "New name"):
        parts = parts.unionByName(known.select(F.col(c).alias("spelling")))
    teams = _listed(spark, d)
    return cut(spellings.institutions(spellings.spell_support(parts), teams.select("spelling"), teams))


def _drafts(spark: SparkSession, d: str, inst: DataFrame) -> DataFrame:
    t = table(spark, d, "all_drafts").select(
        F.col("_ord").alias("ord"), F.col("Player Name").alias("name"), F.col("Drafted From").alias("spelling"),
        F.col("Year").alias("year"), F.col("Round").alias("round"), F.col("Pick").alias("pick"))
    # spellings are few against rows: where they are not small enough to broadcast, AQE splits a hot spelling
    return t.join(inst.select("spelling", "institution"), "spelling", "left").drop("spelling")


def _player_links(spark: SparkSession, d: str, inst: DataFrame) -> DataFrame:
    drafts = cut(_drafts(spark, d, inst))
    found = spellings.draft_evidence(drafts.select("ord", "name", "year", "institution")).where("confidence >= 0.5").select("a", "b")
    return drafts, cut(found.unionByName(spellings.same_pick(drafts)))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    inst = _institutions(spark, d)
    entered = inst.where("entered")
    x, y = entered.select("institution", F.col("spelling").alias("key_a")), entered.select("institution", F.col("spelling").alias("key_b"))
    schools = x.join(unsent(y), "institution").where("key_a < key_b").select(F.lit("school").alias("kind"), "key_a", "key_b")
    drafts, links = _player_links(spark, d, inst)
    comp = unsent(graph.components(links)).join(drafts.select(F.col("ord").alias("node"), "name"), "node")
    comp = cut(comp.select("component", F.lpad(F.col("node").cast("string"), 12, "0").alias("key"), "name").distinct())
    a, b = comp.select("component", F.col("key").alias("key_a"), F.col("name").alias("name_a")), comp.select(
        "component", F.col("key").alias("key_b"), F.col("name").alias("name_b"))
    players = a.join(unsent(b), "component").where("key_a < key_b and name_a <> name_b").select(F.lit("player").alias("kind"), "key_a", "key_b")
    return schools.unionByName(players)


@query
def p1_persons(spark: SparkSession, d: str) -> DataFrame:
    """The membership form: every draft row with the least row of its person and the person's number of rows."""
    drafts, links = _player_links(spark, d, _institutions(spark, d))
    c = drafts.select("ord", "name").join(unsent(graph.components(links)), F.col("ord") == F.col("node"), "left")
    c = c.select("ord", "name", F.coalesce("component", "ord").alias("person"))
    size = c.groupBy("person").agg(F.count(F.lit(1)).alias("n_rows"))
    return c.join(unsent(size), "person").select(F.col("ord").alias("_ord"), F.col("name").alias("player_name"), "person", "n_rows")


@query
def p1_institutions(spark: SparkSession, d: str) -> DataFrame:
    return _institutions(spark, d).where("entered").select("spelling", "institution")


# ------------------------------------------------------------------ 2: mapping to a canonical list


def _entered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(source_field, value) of the two entry fields, each value once, and the reference list."""
    drafts, stats = table(spark, d, "all_drafts"), table(spark, d, "ncaabb_dataset")
    entered = drafts.select(F.lit("all_drafts.Drafted From").alias("source_field"), F.col("Drafted From").alias("value")).unionByName(
        stats.select(F.lit("ncaabb_dataset.team").alias("source_field"), F.col("team").alias("value")))
    ref = table(spark, d, "unique_teams").select(F.col("Full Name").alias("name"), F.col("Acronym").alias("acronym"))
    return cut(entered.where(F.col("value").isNotNull()).distinct()), ref


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    """(source_field, value, entry, cost, n_near, ambiguous) of every distinct value of the two entry fields."""
    entered, ref = _entered(spark, d)
    return entered.join(canonical.map_values(entered, ref), "value").select("source_field", "value", "entry", "cost", "n_near", "ambiguous")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    m = _mapped(spark, d).where("cost is null or cost > 0")
    return m.select("source_field", F.col("value").alias("entered"), F.coalesce("entry", F.lit("UNMATCHED")).alias("full_name"))


@query
def p2_mapping_report(spark: SparkSession, d: str) -> DataFrame:
    how = F.when(F.col("cost").isNull(), "unmatched").when(F.col("cost") == 0, "exact").when(F.col("cost") < 1, "acronym").otherwise("near")
    return _mapped(spark, d).groupBy("source_field", how.alias("how")).agg(F.count(F.lit(1)).alias("n_values"), F.count_if("ambiguous").alias("n_ambiguous"))


@query
def p2_near_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every entry within the distance of each value, not only the nearest."""
    entered, ref = _entered(spark, d)
    return canonical.near_entries(entered, ref).select(F.col("value").alias("entered"), F.col("entry").alias("full_name"), F.round("cost", 4).alias("cost"))


# ------------------------------------------------------------------ 3: matching without keys


def _pitcher_matches(spark: SparkSession, d: str) -> DataFrame:
    inst = _institutions(spark, d)
    drafts = _drafts(spark, d, inst)
    drafts = cut(drafts.select(
        "ord", "name", "year", "institution",
        F.coalesce(F.concat_ws("-", "year", F.when(F.col("round").isNotNull() & F.col("pick").isNotNull(), F.concat_ws("-", "round", "pick"))),
                   F.lit("")).alias("p")).select(
        "ord", "name", "year", "institution",
        F.when(F.size(F.split("p", "-")) == 3, F.col("p")).otherwise(F.concat(F.lit("row "), F.col("ord"))).alias("pick_id")))
    teams = _listed(spark, d).join(inst, "spelling").groupBy(F.lower(F.trim("acronym")).alias("code")).agg(F.min("institution").alias("institution"))
    p = table(spark, d, "pitching_combined_all").select(
        F.col("playerid").alias("left_id"), F.coalesce("name", "nameascii").alias("name"), "year", F.lower(F.trim("team")).alias("code")).where(
        F.col("playerid").isNotNull()).distinct()
    return matching.match_drafts(p.join(teams, "code", "left").drop("code"), drafts)


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    m = _pitcher_matches(spark, d).where("confidence > 0.5")
    return m.select(F.col("left_id").alias("playerid"), F.col("ord").alias("draft_ord")).distinct()


@query
def p3_confidences(spark: SparkSession, d: str) -> DataFrame:
    return _pitcher_matches(spark, d).select(F.col("left_id").alias("playerid"), F.col("ord").alias("draft_ord"), "relation", F.round("confidence", 6).alias("confidence"), "converged")


# ------------------------------------------------------------------ 5: percentiles

QS = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def _era(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pitching_combined_all")
    return percentiles.usable(t, F.col("year").cast("string"), F.col("era")).where("v >= 0")


def _wpct(spark: SparkSession, d: str) -> DataFrame:
    """WPCT per league; values above 1 are in per cent or per mille and are brought to a share."""
    t = table(spark, d, "ncaabb_dataset")
    w = F.col("WPCT")
    unit = F.when(w <= 1, w).when(w <= 100, w / 100).when(w <= 1000, w / 1000)
    league = F.upper(F.regexp_replace("league", r"(?U)^\s+|\s+$", ""))
    return percentiles.usable(t, F.when(league != "", league), unit).where("v >= 0")


def _report(df: DataFrame, group: str) -> DataFrame:
    return df.select(F.col("g").alias(group), "q", F.col("total").alias("n"), F.round("value", 9).alias("value"), F.round("error", 9).alias("error"))


@query
def p5_era_by_year(spark: SparkSession, d: str) -> DataFrame:
    return _report(percentiles.percentiles([_era(spark, d)], QS), "year")


@query
def p5_wpct_by_league(spark: SparkSession, d: str) -> DataFrame:
    return _report(percentiles.percentiles([_wpct(spark, d)], QS), "league")


@query
def p5_era_of_merged_slices(spark: SparkSession, d: str) -> DataFrame:
    """The same percentiles from three slices counted apart."""
    t = table(spark, d, "pitching_combined_all")
    part = F.pmod(F.xxhash64("row_id"), F.lit(3))
    slices = [percentiles.usable(t.where(part == i), F.col("year").cast("string"), F.col("era")).where("v >= 0") for i in range(3)]
    return _report(percentiles.percentiles(slices, QS), "year")


@query
def p5_era_bounded_error(spark: SparkSession, d: str) -> DataFrame:
    """One level of digits only: every value within the stated error, from one pass over the data."""
    return _report(percentiles.percentiles([_era(spark, d)], QS, depth=1), "year")


def _percentile_sql(g: str, v: str, tab: str, where: str, name: str) -> str:
    return f"""
WITH u AS (SELECT {g} AS g, {v} AS v FROM {tab}),
r AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS k, count(*) OVER (PARTITION BY g) AS n FROM u
      WHERE g IS NOT NULL AND v IS NOT NULL AND isfinite(v) AND {where}),
q AS (SELECT unnest({QS}::DOUBLE[]) AS q)
SELECT g AS {name}, q, n, round(v, 9) AS value, CAST(0 AS DOUBLE) AS error FROM r, q
WHERE k = greatest(1, least(n, CAST(ceil(round(q * n, 9)) AS BIGINT)))"""


ORACLE["p5_era_by_year"] = _percentile_sql("CAST(year AS VARCHAR)", "era", "pitching_combined_all", "v >= 0", "year")
ORACLE["p5_era_of_merged_slices"] = ORACLE["p5_era_by_year"]
ORACLE["p5_wpct_by_league"] = _percentile_sql(
    "nullif(upper(regexp_replace(league, '^\\s+|\\s+$', '', 'g')), '')",
    'CASE WHEN "WPCT" <= 1 THEN "WPCT" WHEN "WPCT" <= 100 THEN "WPCT" / 100 WHEN "WPCT" <= 1000 THEN "WPCT" / 1000 END',
    "ncaabb_dataset", "v >= 0", "league")


# ------------------------------------------------------------------ 7: evaluation texts in training text


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "text"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


@query
def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("longest"))


# ------------------------------------------------------------------ 8: mixing sources


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = cut(mixing.with_tokens(table(spark, d, "documents")))
    planned = cut(mixing.plan(sized, table(spark, d, "mix_targets")))
    return mixing.mixture(sized, planned), planned


@query
def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mix(spark, d))


# ------------------------------------------------------------------ 9: document languages


def _languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    return language.label_documents(docs, language.train(docs))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(_languages(spark, d)).select("doc_id", "segment_no", "language")


@query
def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("doc_id", "segment_no", "language", F.round("confidence", 4).alias("confidence"), "ambiguous", "n_chars")
