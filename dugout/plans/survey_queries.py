"""Queries of the analytics operators, one or more for each capability, with their SQL twins."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.functions import numeric as N
from dugout.functions import text as T
from dugout.operators import boosting, draft, features, metrics, models, pyth, relational, sampling, stats
from dugout.operators.relational import q
from dugout.session import cut, evenly
from dugout.sources import files, sinks
from dugout.sources.tables import nan_to_null, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def fin(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


# ------------------------------------------------------------------ exponent fits

FIRST, LAST, LEAST = 2021, 2025, 3
_SHARE = '(CASE WHEN "WPCT" <= 1 THEN "WPCT" WHEN "WPCT" <= 100 THEN "WPCT" / 100 WHEN "WPCT" <= 1000 THEN "WPCT" / 1000 END)'


def _seasons(spark: SparkSession, d: str, recent: bool = False) -> DataFrame:
    t = table(spark, d, "ncaabb_dataset").withColumn("WPCT", N.share_of(F.col("WPCT")))
    return pyth.usable_seasons(t, "R (Batting)", "R (Pitching)", "WPCT", *((FIRST, LAST) if recent else (None, None)))


def _fit_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, "n", "best_x", r6(F.col("best_rmse"), "best_rmse"), r6(F.col("mlb_rmse"), "mlb_rmse"), F.round("improvement_pct", 4).alias("improvement_pct"))


def _fit_sql(keys: list[str], recent: bool, least: int) -> str:
    k = "".join(x + ", " for x in keys)
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    null = "".join(f" AND {x} IS NOT NULL" for x in keys)
    years = f" AND year BETWEEN {FIRST} AND {LAST}" if recent else ""
    return f"""
s AS (SELECT year, league, "R (Batting)" AS rs, "R (Pitching)" AS ra, {_SHARE} AS wpct FROM ncaabb_dataset
  WHERE isfinite("R (Batting)") AND isfinite("R (Pitching)") AND isfinite({_SHARE}) AND "R (Batting)" + "R (Pitching)" > 0{years}{null}),
e AS (SELECT {k}x, count(*) AS n, sqrt(avg(pow(wpct - pow(rs, x) / (pow(rs, x) + pow(ra, x)), 2))) AS e
  FROM s, (SELECT CAST(i AS DOUBLE) / 100 AS x FROM range(50, 351) t(i)) GROUP BY {k}x),
b AS (SELECT *, row_number() OVER ({part} ORDER BY e, x) AS k, max(CASE WHEN x = 1.83 THEN e END) OVER ({part}) AS m FROM e),
fit AS (SELECT {k}n, x AS best_x, e AS best_rmse, m AS mlb_rmse, (m - e) / m * 100 AS improvement_pct FROM b WHERE k = 1 AND n >= {least})"""


def _fit_select(keys: list[str]) -> str:
    k = "".join(x + ", " for x in keys)
    return f"SELECT {k}n, best_x, round(best_rmse, 6) AS best_rmse, round(mlb_rmse, 6) AS mlb_rmse, round(improvement_pct, 4) AS improvement_pct FROM fit"


@query("WITH " + _fit_sql([], True, 10) + _fit_select([]))
def pyth_fit_global(spark, d):
    return _fit_rows(pyth.fit_exponent(_seasons(spark, d, True), [], 10), [])


@query("WITH " + _fit_sql(["year"], False, LEAST) + _fit_select(["year"]))
def pyth_fit_by_year(spark, d):
    return _fit_rows(pyth.fit_exponent(_seasons(spark, d), ["year"], LEAST), ["year"])


@query("WITH " + _fit_sql(["year", "league"], False, LEAST) + _fit_select(["year", "league"]))
def pyth_fit_by_year_league(spark, d):
    return _fit_rows(pyth.fit_exponent(_seasons(spark, d), ["year", "league"], LEAST), ["year", "league"])


@query("WITH " + _fit_sql(["league"], False, 10) + _fit_select(["league"]))
def pyth_fit_by_league(spark, d):
    return _fit_rows(pyth.fit_exponent(_seasons(spark, d), ["league"], 10), ["league"])


_BOTH = "WITH y AS (WITH " + _fit_sql(["year"], False, LEAST) + " SELECT * FROM fit), l AS (WITH " + _fit_sql(["year", "league"], False, LEAST) + " SELECT * FROM fit) "


def _differences(spark, d):
    s = _seasons(spark, d)
    y = pyth.fit_exponent(s, ["year"], LEAST).select("year", F.col("best_x").alias("year_x"))
    return pyth.fit_exponent(s, ["year", "league"], LEAST).join(y, "year").select(
        "year", "league", "best_x", "year_x", N.round_even(F.col("best_x") - F.col("year_x"), 4).alias("diff"))


@query(_BOTH + "SELECT l.year, l.league, l.best_x, y.best_x AS year_x, round_even(l.best_x - y.best_x, 4) AS diff FROM l JOIN y USING (year)")
def pyth_league_vs_year_diff(spark, d):
    return _differences(spark, d)


@query(_BOTH + """SELECT l.league, round(avg(l.best_x - y.best_x), 6) AS mean_diff, round(stddev_pop(l.best_x - y.best_x), 6) AS std_diff, count(*) AS n
FROM l JOIN y USING (year) GROUP BY l.league""")
def pyth_diff_summary(spark, d):
    x = F.col("best_x") - F.col("year_x")
    return _differences(spark, d).groupBy("league").agg(r6(F.avg(x), "mean_diff"), r6(F.stddev_pop(x), "std_diff"), F.count(F.lit(1)).alias("n"))


@query("WITH " + _fit_sql(["year", "league"], False, LEAST) + " SELECT year, league, best_x, round(abs(best_x - 1.83), 6) AS deviation FROM fit ORDER BY abs(best_x - 1.83) DESC, year, league LIMIT 1")
def pyth_max_deviation(spark, d):
    f = pyth.fit_exponent(_seasons(spark, d), ["year", "league"], LEAST)
    return pyth.most_deviating(f, ["year", "league"]).select("year", "league", "best_x", r6(F.col("deviation"), "deviation"))


@query("WITH " + _fit_sql(["year", "league"], False, LEAST) + """ SELECT round(avg(best_x), 6) AS mean, round(median(best_x), 6) AS median, round(stddev_samp(best_x), 6) AS std,
min(best_x) AS min, max(best_x) AS max, count(*) FILTER (best_x < 1.83) AS below, count(*) FILTER (best_x > 1.83) AS above, count(*) FILTER (best_x BETWEEN 1.73 AND 1.93) AS near FROM fit""")
def pyth_exponent_summary(spark, d):
    f = pyth.fit_exponent(_seasons(spark, d), ["year", "league"], LEAST)
    f = cut(f)
    s = f.agg(*stats.summary("best_x"), F.count_if(F.col("best_x") < 1.83).alias("below"), F.count_if(F.col("best_x") > 1.83).alias("above"),
              F.count_if(F.col("best_x").between(1.73, 1.93)).alias("near"))
    # two rows become one without a join
    both = s.unionByName(stats.medians(f, "best_x"), allowMissingColumns=True)
    s = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return s.select(*[r6(F.col(c), c) for c in ("mean", "median", "std")], "min", "max", "below", "above", "near")


@query("WITH " + _fit_sql(["league"], False, 10) + """ SELECT league, best_x, CASE WHEN best_x < 1.83 THEN 'green' WHEN best_x > 1.83 THEN 'red' ELSE 'blue' END AS colour FROM fit""")
def exponent_colour(spark, d):
    x = F.col("best_x")
    return pyth.fit_exponent(_seasons(spark, d), ["league"], 10).select(
        "league", "best_x", F.when(x < N.MLB_EXPONENT, "green").when(x > N.MLB_EXPONENT, "red").otherwise("blue").alias("colour"))


_S = f"""s AS (SELECT year, league, "R (Batting)" AS rs, "R (Pitching)" AS ra, {_SHARE} AS wpct FROM ncaabb_dataset
  WHERE isfinite("R (Batting)") AND isfinite("R (Pitching)") AND isfinite({_SHARE}) AND "R (Batting)" + "R (Pitching)" > 0)"""
_PE = "pow(rs, 1.83::DOUBLE) / (pow(rs, 1.83::DOUBLE) + pow(ra, 1.83::DOUBLE))"


@query(f"""WITH {_S}, p AS (SELECT league, wpct, {_PE} AS pe FROM s WHERE league IS NOT NULL),
a AS (SELECT league, count(*) AS n, covar_pop(wpct, pe) AS c, stddev_pop(wpct) AS u, stddev_pop(pe) AS v FROM p GROUP BY league HAVING count(*) >= 10)
SELECT league, n, round(CASE WHEN u * v > 0 THEN c / (u * v) END, 5) AS r FROM a""")
def pyth_league_corr(spark, d):
    s = _seasons(spark, d).where("league is not null").withColumn("pe", N.expectation(F.col("rs"), F.col("ra"), N.MLB_EXPONENT))
    return s.groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.round(N.corr_or_null(F.col("wpct"), F.col("pe")), 5).alias("r")).where("n >= 10")


@query(f"""WITH {_S} SELECT year, round(regr_slope(wpct, {_PE}), 5) AS slope, round(regr_intercept(wpct, {_PE}), 5) AS intercept FROM s GROUP BY year HAVING count(*) >= 10""")
def pyth_linreg(spark, d):
    s = _seasons(spark, d).withColumn("pe", N.expectation(F.col("rs"), F.col("ra"), N.MLB_EXPONENT))
    g = s.groupBy("year").agg(F.count(F.lit(1)).alias("n"), *stats.regression(F.col("wpct"), F.col("pe"))).where("n >= 10")
    return g.select("year", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query(f"""WITH {_S}, m AS (SELECT min(wpct) AS a, max(wpct) AS b FROM s), i AS (SELECT unnest(range(0, 15)) AS bin),
h AS (SELECT least(14, CAST(floor((wpct - a) / ((b - a) / 15)) AS INTEGER)) AS bin, count(*) AS n FROM s, m GROUP BY 1)
SELECT CAST(i.bin AS INTEGER) AS bin, round(a + i.bin * (b - a) / 15, 6) AS lo, round(a + (i.bin + 1) * (b - a) / 15, 6) AS hi, coalesce(n, 0) AS n FROM i JOIN m ON true LEFT JOIN h ON h.bin = i.bin""")
def pyth_hist(spark, d):
    return stats.histogram(_seasons(spark, d), "wpct", 15).select("bin", r6(F.col("lo"), "lo"), r6(F.col("hi"), "hi"), "n")


@query(f"WITH {_S}, m AS (SELECT min(rs) AS a, max(rs) AS b FROM s) SELECT CAST(i AS INTEGER) AS point, round(a + (b - a) * i / 99.0, 6) AS x FROM m, range(0, 100) t(i)")
def pyth_line(spark, d):
    m = _seasons(spark, d).agg(F.min("rs").alias("a"), F.max("rs").alias("b"))
    return m.select(F.posexplode(files.line_points(F.col("a"), F.col("b"), 100)).alias("point", "x")).select("point", r6(F.col("x"), "x"))


# ------------------------------------------------------------------ sources and projections


@query(r"""WITH f AS (SELECT DISTINCT feed, lower(regexp_extract(file_name, '([^/]*)$', 1)) AS b FROM batting_files),
m AS (SELECT feed, regexp_extract(b, '^(batting|pitching)_(standard|advanced)_(\d{4})\.csv$', 1) AS type, regexp_extract(b, '^(batting|pitching)_(standard|advanced)_(\d{4})\.csv$', 2) AS kind,
  try_cast(regexp_extract(b, '^(batting|pitching)_(standard|advanced)_(\d{4})\.csv$', 3) AS INTEGER) AS year FROM f)
SELECT feed, type, year, count(DISTINCT kind) = 2 AS complete FROM m WHERE type <> '' GROUP BY feed, type, year""")
def season_files(spark, d):
    return files.complete_seasons(table(spark, d, "batting_files").where("line_no = 0").select("feed", "file_name").distinct(), "file_name", "feed")


@query("SELECT \"Acronym\" AS team, CAST(y AS INTEGER) AS year FROM unique_teams, range(2002, 2026) t(y)")
def year_team_grid(spark, d):
    return files.year_grid(table(spark, d, "unique_teams").select(F.col("Acronym").alias("team")), 2002, 2025)


@query("SELECT name, team, age, playerid, year, row_id, " + fin('"k/9"') + " AS k_per_9, 'pitching' AS source FROM pitching_combined_all")
def normalised_players(spark, d):
    t = relational.normalise_header(nan_to_null(table(spark, d, "pitching_combined_all")).select("row_id", "year", "k/9", "name", "playerid", "team", "age"))
    t = relational.reorder(t.withColumnRenamed("k/9", "k_per_9").withColumn("source", F.lit("pitching")), ["name", "team", "age", "playerid", "year"])
    return t


@query("SELECT row_id, \"Old name\" FROM missing_schools")
def dropped_columns(spark, d):
    return relational.drop_strict(table(spark, d, "missing_schools"), ["New name"]).drop("not there")


@query(r"""SELECT row_id, conference, "conf-national-rec" AS record,
try_cast(CASE WHEN regexp_matches("conf-national-rec", '^\s*\d+\s*-\s*\d+\s*$') THEN trim(split_part("conf-national-rec", '-', 1)) END AS INTEGER) AS wins,
try_cast(CASE WHEN regexp_matches("conf-national-rec", '^\s*\d+\s*-\s*\d+\s*$') THEN trim(split_part("conf-national-rec", '-', 2)) END AS INTEGER) AS losses FROM conference_rankings""")
def win_loss_split(spark, d):
    w, x = T.win_loss(F.col("conf-national-rec"))
    return table(spark, d, "conference_rankings").select("row_id", "conference", F.col("conf-national-rec").alias("record"), w.alias("wins"), x.alias("losses"))


@query("SELECT row_id, try_cast(mlbamid AS DOUBLE) AS mlbam, " + fin("ip") + " AS ip FROM pitching_combined_all")
def lenient_numbers(spark, d):
    return table(spark, d, "pitching_combined_all").select("row_id", T.to_number(F.col("mlbamid")).alias("mlbam"), T.to_number(F.col("ip")).alias("ip"))


@query("SELECT column_name, n_values, n_rows FROM (SELECT count(*) AS n_rows, count(name) AS name, count(team) AS team, count(age) AS age, count(year) AS year FROM pitching_combined_all) UNPIVOT (n_values FOR column_name IN (name, team, age, year))")
def column_overview(spark, d):
    return sinks.overview(table(spark, d, "pitching_combined_all").select("name", "team", "age", "year")).drop("type")


@query(f"SELECT row_id, year, {fin('era')} AS era, age FROM pitching_combined_all WHERE isfinite(era) AND age IS NOT NULL")
def dropna_any(spark, d):
    return nan_to_null(table(spark, d, "pitching_combined_all").select("row_id", "year", "era", "age")).na.drop(how="any", subset=["era", "age"])


@query(f"SELECT row_id, {fin('era')} AS era, age, mlbamid FROM pitching_combined_all WHERE isfinite(era) OR age IS NOT NULL OR mlbamid IS NOT NULL")
def dropna_all(spark, d):
    return nan_to_null(table(spark, d, "pitching_combined_all").select("row_id", "era", "age", "mlbamid")).na.drop(how="all", subset=["era", "age", "mlbamid"])


@query("SELECT row_id, year FROM ncaabb_dataset WHERE year BETWEEN 2021 AND 2025")
def between_filter(spark, d):
    return table(spark, d, "ncaabb_dataset").where(F.col("year").between(2021, 2025)).select("row_id", "year")


@query("SELECT row_id, name, team, year FROM pitching_combined_all WHERE team = 'CAL' AND year = 2019 AND age = 20")
def point_lookup(spark, d):
    return table(spark, d, "pitching_combined_all").where((F.col("team") == "CAL") & (F.col("year") == 2019) & (F.col("age") == 20)).select("row_id", "name", "team", "year")


@query("SELECT row_id, team FROM ncaabb_dataset WHERE NOT coalesce(contains(lower(team), 'division'), false)")
def null_safe_not_contains(spark, d):
    return table(spark, d, "ncaabb_dataset").where(relational.not_containing(F.col("team"), "division")).select("row_id", "team")


@query("""WITH v AS (SELECT DISTINCT "New name" AS n FROM missing_schools WHERE "New name" IS NOT NULL),
j AS (SELECT n, "Full Name" AS f, row_number() OVER (PARTITION BY n ORDER BY "Acronym") AS k FROM v JOIN unique_teams ON contains("Full Name", n))
SELECT n AS new_name, f AS full_name FROM j WHERE k = 1""")
def contains_first_hit(spark, d):
    v = table(spark, d, "missing_schools").where(F.col("New name").isNotNull())
    return relational.contains_first(v, "New name", table(spark, d, "unique_teams"), "Full Name", "Acronym").select(
        F.col("New name").alias("new_name"), F.col("Full Name").alias("full_name"))


@query("""WITH a AS (SELECT "Acronym" AS a, min("Full Name") AS f FROM unique_teams GROUP BY 1),
m AS (SELECT o, n FROM (SELECT lower(trim("Old name")) AS o, "New name" AS n, row_number() OVER (PARTITION BY lower(trim("Old name")) ORDER BY row_id) AS k FROM missing_schools
  WHERE trim("Old name") <> '' AND trim("New name") <> '') WHERE k = 1),
h AS (SELECT n, f FROM (SELECT n, "Full Name" AS f, row_number() OVER (PARTITION BY n ORDER BY "Acronym") AS k FROM (SELECT DISTINCT n FROM m) JOIN unique_teams ON contains("Full Name", n)) WHERE k = 1)
SELECT d._ord, d."Drafted From" AS entered, coalesce(a.f, h.f) AS full_name FROM all_drafts d LEFT JOIN a ON d."Drafted From" = a.a
LEFT JOIN m ON lower(trim(d."Drafted From")) = m.o LEFT JOIN h ON m.n = h.n""")
def fallback_full_name(spark, d):
    """Full names by acronym, and where there is none by the correction of the entry and the first name that contains it."""
    u = table(spark, d, "unique_teams")
    a = u.groupBy(q("Acronym").alias("a")).agg(F.min(q("Full Name")).alias("full_name"))
    t = table(spark, d, "all_drafts").select("_ord", q("Drafted From").alias("entered")).join(a, F.col("entered") == F.col("a"), "left").drop("a")
    return relational.fallback_names(t, "entered", "full_name", u, "Full Name", "Acronym", table(spark, d, "missing_schools"), "Old name", "New name", "row_id")


@query(r"""WITH v AS (SELECT DISTINCT "Drafted From" AS s FROM all_drafts WHERE contains("Drafted From", '(') AND contains("Drafted From", ')')),
p AS (SELECT s, trim(split_part(s, '(', 1)) AS team, trim(replace(split_part(s, '(', 2), ')', '')) AS league FROM v)
SELECT s AS entered, team, league FROM p WHERE team <> '' AND league <> '' AND NOT starts_with(lower(team), 'division')""")
def valid_labels(spark, d):
    t = table(spark, d, "all_drafts").select(F.col("Drafted From").alias("entered")).distinct()
    return relational.valid_labels(t, "entered")


@query("SELECT team, count(*) AS n FROM pitching_combined_all WHERE team IS NOT NULL GROUP BY team HAVING count(*) > 20")
def value_counts_threshold(spark, d):
    return relational.frequent(table(spark, d, "pitching_combined_all"), "team", 20)


@query("SELECT row_id, team FROM pitching_combined_all WHERE team IN (SELECT team FROM pitching_combined_all WHERE team IS NOT NULL GROUP BY team HAVING count(*) > 20)")
def isin_semi(spark, d):
    t = table(spark, d, "pitching_combined_all")
    return t.join(relational.frequent(t, "team", 20), "team", "left_semi").select("row_id", "team")


@query("SELECT row_id, coalesce(w, 0) AS w, coalesce(l, 0) AS l, coalesce(nameascii, name) AS shown FROM pitching_combined_all")
def fill_and_coalesce(spark, d):
    t = table(spark, d, "pitching_combined_all").select("row_id", "w", "l", F.coalesce("nameascii", "name").alias("shown"))
    return t.na.fill(0, ["w", "l"])


@query(f"SELECT row_id, CASE WHEN {fin('ip')} >= 50 THEN {fin('era')} END AS era_of_regulars, CAST({fin('whip')} > 1.4 AS INTEGER) AS high_whip FROM pitching_combined_all")
def masked_assign(spark, d):
    t = nan_to_null(table(spark, d, "pitching_combined_all").select("row_id", "ip", "era", "whip"))
    return t.select("row_id", F.when(F.col("ip") >= 50, F.col("era")).alias("era_of_regulars"), (F.col("whip") > 1.4).cast("int").alias("high_whip"))


@query("SELECT b.row_id, coalesce(b.year, r.year) AS year FROM ncaabb_dataset b LEFT JOIN conference_rankings r ON b.row_id = r.row_id")
def coalesce_year_columns(spark, d):
    a = table(spark, d, "ncaabb_dataset").select("row_id", F.col("year").alias("year_x"))
    b = table(spark, d, "conference_rankings").select(F.col("row_id").alias("rid"), F.col("year").alias("year_y"))
    j = a.join(b, F.col("row_id") == F.col("rid"), "left")
    return j.select("row_id", F.coalesce(*[q(c) for c in relational.columns_like(j, "year")[:2]]).alias("year"))


# ------------------------------------------------------------------ text


@query(r"""WITH v AS (SELECT DISTINCT "Drafted From" AS s FROM all_drafts WHERE "Drafted From" IS NOT NULL)
SELECT s AS entered, trim(regexp_replace(replace(regexp_replace(replace(lower(s), '&', 'and'), '\buniv\b\.?', 'university', 'g'), 'college of', ''), '[\s\x{00A0}]+', ' ', 'g')) AS cleaned FROM v""")
def clean_text(spark, d):
    s = F.col("Drafted From")
    return table(spark, d, "all_drafts").where(s.isNotNull()).select(s.alias("entered")).distinct().withColumn("cleaned", T.clean(F.col("entered")))


@query(r"""WITH v AS (SELECT DISTINCT "Drafted From" AS s FROM all_drafts WHERE contains("Drafted From", '(') AND contains("Drafted From", ')'))
SELECT s AS entered, trim(split_part(s, '(', 1)) AS team, trim(replace(split_part(s, '(', 2), ')', '')) AS league FROM v""")
def split_label(spark, d):
    team, league = T.split_team_league(F.col("Drafted From"))
    return table(spark, d, "all_drafts").select(F.col("Drafted From").alias("entered"), team.alias("team"), league.alias("league")).where("team is not null").distinct()


@query("""SELECT row_id, CASE WHEN "G" <> 0 THEN round_even("W" / "G", 3) END AS wpct, round_even("PE", 3) AS pe,
round_even(CASE WHEN "G" <> 0 THEN round_even("W" / "G", 3) END - round_even("PE", 3), 3) AS difference
FROM (SELECT row_id, team, CASE WHEN isfinite("W") THEN "W" END AS "W", CASE WHEN isfinite("G") THEN "G" END AS "G", CASE WHEN isfinite("PE") THEN "PE" END AS "PE" FROM ncaabb_dataset)
WHERE NOT coalesce(contains(lower(team), 'division'), false) AND team IS NOT NULL AND trim(team) <> ''""")
def team_season(spark, d):
    t = nan_to_null(table(spark, d, "ncaabb_dataset").select("row_id", "team", "W", "G", "PE"))
    t = t.where(relational.not_containing(F.col("team"), "division") & F.col("team").isNotNull() & (F.trim("team") != ""))
    w, pe = N.round_even(N.safe_divide(F.col("W"), F.col("G")), 3), N.round_even(F.col("PE"), 3)
    return t.select("row_id", w.alias("wpct"), pe.alias("pe"), N.round_even(w - pe, 3).alias("difference"))


@query("SELECT year, format('{} teams, {:.2f} wins', count(*), avg(CASE WHEN isfinite(\"W\") THEN \"W\" END)) AS line FROM ncaabb_dataset GROUP BY year")
def text_report(spark, d):
    t = nan_to_null(table(spark, d, "ncaabb_dataset").select("year", "W"))
    return t.groupBy("year").agg(F.format_string("%d teams, %.2f wins", F.count(F.lit(1)), F.avg("W")).alias("line"))


# ------------------------------------------------------------------ joins and unions

_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY playerid, year ORDER BY row_id) AS k FROM {}) WHERE k = 1 AND playerid IS NOT NULL)"


def _first_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    s = F.struct("row_id", *[q(c) for c in cols])
    g = df.where("playerid is not null").groupBy("playerid", "year").agg(F.min_by(s, "row_id").alias("s"))
    return g.select("playerid", "year", *[F.col("s")[c].alias(c) for c in cols])


@query(f"""WITH a AS {_FIRST.format('pitching_combined_all')}, b AS {_FIRST.format('batting_combined_all')}
SELECT coalesce(a.playerid, b.playerid) AS playerid, coalesce(a.year, b.year) AS year, a.name, a.w, a.l, b.ab, b.hr FROM a FULL JOIN b ON a.playerid = b.playerid AND a.year = b.year""")
def combine_outer(spark, d):
    a = _first_rows(table(spark, d, "pitching_combined_all"), ["name", "w", "l"])
    b = _first_rows(table(spark, d, "batting_combined_all"), ["name", "ab", "hr"])
    return relational.outer_merge(a, b, ["playerid", "year"])


@query("SELECT playerid, year, w, NULL::INTEGER AS ab FROM pitching_combined_all UNION ALL SELECT playerid, year, NULL, ab FROM batting_combined_all")
def union_by_name(spark, d):
    return relational.union_by_name([table(spark, d, "pitching_combined_all").select("playerid", "year", "w"), table(spark, d, "batting_combined_all").select("playerid", "year", "ab")])


_KEYS = ["name", "team", "age", "nameascii", "playerid", "mlbamid", "year"]


def _two_way(spark, d):
    a = table(spark, d, "pitching_combined_all").select(*_KEYS, "h", "hr", "ip")
    b = table(spark, d, "batting_combined_all").select(*_KEYS, "h", "hr", "ab")
    return relational.null_safe_merge(a, b, _KEYS, ("_pitch", "_bat")).withColumn("role", relational.role(F.col("_in_left"), F.col("_in_right")))


_TWO = "FROM (SELECT *, true AS x FROM pitching_combined_all) a FULL JOIN (SELECT *, true AS y FROM batting_combined_all) b ON " + " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in _KEYS)
_ROLE = "CASE WHEN x AND y THEN 'Two-Way' WHEN x THEN 'Pitcher' WHEN y THEN 'Batter' ELSE 'Unknown' END"


@query(f"SELECT {_ROLE} AS role, count(*) AS n {_TWO} GROUP BY 1")
def two_way_roles(spark, d):
    return _two_way(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT coalesce(a.playerid, b.playerid) AS playerid, coalesce(a.year, b.year) AS year, coalesce(a.h, b.h) AS h, coalesce(a.hr, b.hr) AS hr, {_ROLE} AS role {_TWO}")
def two_way_rows(spark, d):
    t = relational.coalesce_pairs(_two_way(spark, d), ["h", "hr"])
    return t.select("playerid", "year", "h", "hr", "role")


_SHARED = ["g", "h", "r", "hr", "bb", "hbp", "so", "avg", "bb%", "k%", "babip"]


@query("SELECT coalesce(a.playerid, b.playerid) AS playerid, coalesce(a.year, b.year) AS year, " + ", ".join(
    (f"coalesce({fin('a.' + chr(34) + c + chr(34))}, {fin('b.' + chr(34) + c + chr(34))})" if c in ("avg", "bb%", "k%", "babip") else f'coalesce(a."{c}", b."{c}")') + f' AS "{c}"'
    for c in _SHARED) + f" {_TWO}")
def two_way_all_shared(spark, d):
    """Every statistic that both tables have, of one or the other side, whatever the tables' columns are."""
    a, b = nan_to_null(table(spark, d, "pitching_combined_all")).drop("row_id", "loaded_at"), nan_to_null(table(spark, d, "batting_combined_all")).drop("row_id", "loaded_at")
    shared = [c for c in a.columns if c in b.columns and c not in _KEYS]
    t = relational.coalesce_pairs(relational.null_safe_merge(a, b, _KEYS, ("_pitch", "_bat")), shared)
    return t.select("playerid", "year", *[q(c) for c in shared])


@query("""SELECT p.row_id, p.team, u."Full Name" AS full_name FROM pitching_combined_all p LEFT JOIN unique_teams u ON upper(trim(p.team)) = u."Acronym" """)
def acronym_lookup(spark, d):
    u = table(spark, d, "unique_teams").select(q("Acronym").alias("a"), q("Full Name").alias("full_name"))
    return table(spark, d, "pitching_combined_all").join(u, F.upper(F.trim("team")) == F.col("a"), "left").select("row_id", "team", "full_name")


@query("""WITH m AS (SELECT "Old name" AS o, "New name" AS n FROM (SELECT *, row_number() OVER (PARTITION BY "Old name" ORDER BY row_id DESC) AS k FROM missing_schools
WHERE "Old name" IS NOT NULL AND trim("Old name") <> '') WHERE k = 1)
SELECT _ord, coalesce(m.n, "Drafted From") AS school FROM all_drafts LEFT JOIN m ON "Drafted From" = m.o""")
def lookup_last_wins(spark, d):
    t = table(spark, d, "missing_schools")
    m = t.where(F.col("Old name").isNotNull() & (F.trim("Old name") != "")).groupBy(q("Old name").alias("o")).agg(F.max_by("New name", "row_id").alias("n"))
    return relational.lookup(table(spark, d, "all_drafts").select("_ord", q("Drafted From").alias("school")), "school", m, "o", "n")


_TEAM_YEAR = "SELECT team, year, count(*) AS batters, CAST(sum(r) AS BIGINT) AS team_runs FROM batting_combined_all WHERE team IS NOT NULL GROUP BY team, year"


@query(f"""WITH s AS ({_TEAM_YEAR}) SELECT p.row_id, u."Full Name" AS full_name, s.batters, s.team_runs FROM pitching_combined_all p
LEFT JOIN unique_teams u ON upper(trim(p.team)) = u."Acronym" LEFT JOIN s ON p.team = s.team AND p.year = s.year""")
def enrich_year_join(spark, d):
    s = table(spark, d, "batting_combined_all").where("team is not null").groupBy("team", "year").agg(F.count(F.lit(1)).alias("batters"), F.sum("r").alias("team_runs"))
    p = table(spark, d, "pitching_combined_all").select("row_id", "team", "year")
    return draft.enrich(p, table(spark, d, "unique_teams"), s).select("row_id", "full_name", "batters", "team_runs")


@query("""SELECT m.row_id, m."league name" AS league, r.year, r."conf-rank" AS conf_rank FROM missing_conf m LEFT JOIN conference_rankings r ON m."conf name" = r.conference""")
def fanout_join(spark, d):
    r = table(spark, d, "conference_rankings").select("conference", "year", q("conf-rank").alias("conf_rank"))
    m = table(spark, d, "missing_conf").select("row_id", q("league name").alias("league"), q("conf name").alias("conf"))
    return m.join(r, F.col("conf") == F.col("conference"), "left").select("row_id", "league", "year", "conf_rank")


_MAPPED = """SELECT p.row_id, u."Full Name" AS full_name, m."Old name" AS team_old, {0} FROM pitching_combined_all p LEFT JOIN unique_teams u ON upper(trim(p.team)) = u."Acronym"
LEFT JOIN (SELECT * FROM missing_schools WHERE trim("Old name") <> '') m ON u."Full Name" = m."New name\" LEFT JOIN ncaabb_dataset n ON n.team = coalesce(m."Old name", u."Full Name"){1}"""


def _mapped_seasons(spark, d, on: list[str]) -> DataFrame:
    old = table(spark, d, "missing_schools").where(F.trim("Old name") != "").select(q("Old name").alias("team_old"), q("New name").alias("team_new"))
    p = table(spark, d, "pitching_combined_all").select("row_id", "team", "year")
    s = table(spark, d, "ncaabb_dataset").select(F.col("row_id").alias("season_id"), F.col("team").alias("season_team"), F.col("year").alias("season_year"))
    return draft.enrich_mapped(p, table(spark, d, "unique_teams"), old, s, with_year="year" in on)


@query(_MAPPED.format("n.row_id AS season_id", " AND n.year = p.year"))
def mapped_team_season(spark, d):
    """Players with their team's season of the year, through a mapping that fans out where a team has several old names."""
    return _mapped_seasons(spark, d, ["team", "year"]).select("row_id", "full_name", "team_old", "season_id")


@query("SELECT full_name, count(*) AS n_rows, count(season_id) AS n_seasons FROM (" + _MAPPED.format("n.row_id AS season_id", "") + ") GROUP BY full_name")
def team_only_fanout(spark, d):
    """The same join on the team alone: a player gets every season of the team."""
    return _mapped_seasons(spark, d, ["team"]).groupBy("full_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count("season_id").alias("n_seasons"))


@query("""SELECT p.row_id, a._ord AS ord, coalesce(a."Round", 0) AS round, coalesce(a."Pick", 0) AS pick, CAST(a._ord IS NOT NULL AS INTEGER) AS drafted FROM pitching_combined_all p
LEFT JOIN all_drafts a ON p.name = a."Player Name" AND p.year = a."Year" """)
def draft_join(spark, d):
    a = table(spark, d, "all_drafts").select(F.col("_ord").alias("ord"), q("Player Name").alias("pn"), q("Year").alias("y"), q("Round").alias("round"), q("Pick").alias("pick"))
    p = table(spark, d, "pitching_combined_all").select("row_id", "name", "year")
    j = p.join(a, (F.col("name") == F.col("pn")) & (F.col("year") == F.col("y")), "left")
    return j.na.fill(0, ["round", "pick"]).select("row_id", "ord", "round", "pick", F.col("ord").isNotNull().cast("int").alias("drafted"))


def _fuzzy(spark, d):
    u = table(spark, d, "unique_teams").groupBy(q("Acronym").alias("a")).agg(F.min(q("Full Name")).alias("school"))
    p = table(spark, d, "pitching_combined_all").where("name is not null and year is not null").join(u, F.upper(F.trim("team")) == F.col("a"), "left")
    p = p.select(F.col("row_id").alias("pid"), "name", "school", "year")
    a = table(spark, d, "all_drafts").select(F.col("_ord").alias("ord"), q("Player Name").alias("name"), q("Drafted From").alias("school"), q("Year").alias("year"))
    return draft.fuzzy_match(p, a)


@query()
def fuzzy_match(spark, d):
    return _fuzzy(spark, d)


# ------------------------------------------------------------------ aggregation, windows, order


@query(f"""SELECT year, count(*) AS n, round(avg({fin('era')}), 6) AS mean, round(median({fin('era')}), 6) AS median, round(stddev_samp({fin('era')}), 6) AS std,
min({fin('era')}) AS min, max({fin('era')}) AS max FROM pitching_combined_all WHERE year IS NOT NULL GROUP BY year""")
def summary_by_year(spark, d):
    t = nan_to_null(table(spark, d, "pitching_combined_all").select("year", "era")).where("year is not null")
    g = t.groupBy("year").agg(F.count(F.lit(1)).alias("n"), *stats.summary("era")).join(stats.medians(t, "era", ["year"]), "year", "left")
    return g.select("year", "n", *[r6(F.col(c), c) for c in ("mean", "median", "std")], "min", "max")


@query(f"SELECT year, round(sqrt(avg(pow({fin('era')} - {fin('fip')}, 2))), 6) AS rmse FROM pitching_combined_all GROUP BY year")
def rmse_by_year(spark, d):
    t = nan_to_null(table(spark, d, "pitching_combined_all").select("year", "era", "fip"))
    return t.groupBy("year").agg(r6(N.rmse(F.col("era"), F.col("fip")), "rmse"))


@query('SELECT "Year" AS year, "Round" AS round, max("Pick") AS picks FROM all_drafts WHERE "Round" IS NOT NULL GROUP BY 1, 2')
def max_pick_per_round(spark, d):
    return table(spark, d, "all_drafts").where(q("Round").isNotNull()).groupBy(q("Year").alias("year"), q("Round").alias("round")).agg(F.max("Pick").alias("picks"))


@query("""WITH s AS (SELECT "Year" AS year, "Round" AS round, max("Pick") AS picks FROM all_drafts WHERE "Round" IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(picks) OVER (PARTITION BY year ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT year, round, picks, CAST(before AS BIGINT) AS before, CAST(least(picks, before + 1) AS BIGINT) AS pick FROM w""")
def pick_allocator(spark, d):
    a = table(spark, d, "all_drafts").select(q("Year").alias("year"), q("Round").alias("round"), q("Pick").alias("pick"))
    return draft.pick_allocation(a)


@query("""WITH s AS (SELECT "Year" AS year, "Round" AS round, max("Pick") AS picks FROM all_drafts WHERE "Round" IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(picks) OVER (PARTITION BY year ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
y AS (SELECT DISTINCT "Year" AS year FROM all_drafts WHERE "Year" IS NOT NULL), g AS (SELECT year, CAST(r AS INTEGER) AS round FROM y, range(1, 61) t(r))
SELECT g.year, g.round, CAST(coalesce(w.picks, 30) AS INTEGER) AS picks, CAST(coalesce(least(w.picks, before + 1), 1) AS BIGINT) AS pick FROM g LEFT JOIN w ON g.year = w.year AND g.round = w.round""")
def pick_of_any_round(spark, d):
    """Picks and pick of rounds 1 to 60 of every year; rounds that a year does not have get the fallback."""
    a = table(spark, d, "all_drafts").select(q("Year").alias("year"), q("Round").alias("round"), q("Pick").alias("pick"))
    asked = a.where("year is not null").select("year").distinct().withColumn("predicted_round", F.explode(F.sequence(F.lit(1), F.lit(60))))
    return draft.with_pick(asked, a).select("year", F.col("predicted_round").alias("round"), "picks", "pick")


@query("SELECT DISTINCT year FROM pitching_combined_all")
def distinct_years(spark, d):
    return table(spark, d, "pitching_combined_all").select("year").distinct()


@query(f"SELECT row_id, so, name FROM pitching_combined_all WHERE so IS NOT NULL ORDER BY so DESC, row_id LIMIT 20")
def top_k(spark, d):
    return table(spark, d, "pitching_combined_all").where("so is not null").orderBy(F.desc("so"), "row_id").limit(20).select("row_id", "so", "name")


_MISS = ["age", "mlbamid", "nameascii", "era", "ip", "team", "name"]


@query("SELECT column_name, round(missing, 6) AS missing FROM (SELECT " + ", ".join(
    f"avg(CASE WHEN {c} IS NULL{' OR isnan(' + c + ')' if c in ('era', 'ip') else ''} THEN 1.0 ELSE 0.0 END) AS {c}" for c in _MISS)
    + f" FROM pitching_combined_all) UNPIVOT (missing FOR column_name IN ({', '.join(_MISS)})) WHERE missing > 0 ORDER BY missing DESC, column_name LIMIT 100")
def missingness(spark, d):
    return stats.missingness(table(spark, d, "pitching_combined_all").select(*_MISS), 100).select("column_name", r6(F.col("missing"), "missing"))


@query("""WITH s AS (SELECT era AS a, whip AS b FROM pitching_combined_all WHERE isfinite(era) AND isfinite(whip)),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM s)
SELECT round(corr(x, y), 6) AS rho FROM r""")
def spearman(spark, d):
    return stats.spearman(nan_to_null(table(spark, d, "pitching_combined_all").select("era", "whip")), "era", "whip").select(r6(F.col("rho"), "rho"))


# ------------------------------------------------------------------ sampling and features


def _labelled(spark, d) -> DataFrame:
    """Pitcher seasons with whether a draft row has their name and year."""
    a = table(spark, d, "all_drafts").groupBy(q("Player Name").alias("pn"), q("Year").alias("y")).agg(F.min("Pick").alias("pick"), F.min("Round").alias("round"))
    p = nan_to_null(table(spark, d, "pitching_combined_all"))
    return p.join(a, (F.col("name") == F.col("pn")) & (F.col("year") == F.col("y")), "left").withColumn("label", F.col("pn").isNotNull().cast("int")).drop("pn", "y")


_LAB = """l AS (SELECT p.row_id, CAST(a.n IS NOT NULL AS INTEGER) AS label FROM pitching_combined_all p LEFT JOIN (SELECT "Player Name" AS n, "Year" AS y FROM all_drafts GROUP BY 1, 2) a ON p.name = a.n AND p.year = a.y)"""


@query(f"""WITH {_LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(row_id::VARCHAR || '-42'), row_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM l)
SELECT row_id, label, k <= ceil(n * 0.2) AS is_test FROM r""")
def stratified_split(spark, d):
    return sampling.stratified_split(_labelled(spark, d).select("row_id", "label"), "label", "row_id")


@query("""WITH r AS (SELECT row_id, row_number() OVER (ORDER BY md5(row_id::VARCHAR || '-42'), row_id) AS k, count(*) OVER () AS n FROM pitching_combined_all) SELECT row_id, k <= ceil(n * 0.2) AS is_test FROM r""")
def random_split(spark, d):
    return sampling.split(table(spark, d, "pitching_combined_all").select("row_id"), "row_id")


@query(f"""WITH {_LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(row_id::VARCHAR || '-42'), row_id) AS k FROM l),
m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM l GROUP BY label)) SELECT row_id, label FROM r, m WHERE k <= m""")
def undersample(spark, d):
    return sampling.undersample(_labelled(spark, d).select("row_id", "label"), "label", "row_id")


@query("""WITH l AS (SELECT p.row_id, a.round, a.pick FROM pitching_combined_all p JOIN (SELECT "Player Name" AS n, "Year" AS y, min("Round") AS round, min("Pick") AS pick FROM all_drafts GROUP BY 1, 2) a
  ON p.name = a.n AND p.year = a.y),
r AS (SELECT *, row_number() OVER (ORDER BY md5(row_id::VARCHAR || '-42'), row_id) AS k, count(*) OVER () AS n FROM l) SELECT row_id, round, pick, k <= ceil(n * 0.2) AS is_test FROM r""")
def split_for_two_targets(spark, d):
    """One split serves both targets, so a row is on the same side for the round and for the pick."""
    return sampling.split(_labelled(spark, d).where("label = 1").select("row_id", "round", "pick"), "row_id")


@query("SELECT x AS feature FROM (SELECT unnest([" + ", ".join("'" + f + "'" for f in features.SELECTED) + "]) AS x) WHERE x NOT IN ('k%', 'bb%', 'K/BB', 'k/bb')")
def selected_features(spark, d):
    return spark.createDataFrame([(f,) for f in features.without(features.SELECTED, features.REDUNDANT)], "feature string")


@query(f"WITH {_LAB} SELECT row_id, label, CASE WHEN label = 1 THEN round((SELECT count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1) FROM l), 6) ELSE 1.0 END AS weight FROM l")
def class_weight(spark, d):
    return features.class_weight(_labelled(spark, d).select("row_id", "label"), "label").withColumn("weight", F.round("weight", 6))


@query(f"WITH {_LAB} SELECT label, count(*) AS n FROM l GROUP BY label")
def class_distribution(spark, d):
    return _labelled(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT feed, kind, file_id, CAST(coalesce(kind = 'standard', false) AS INTEGER) AS kind_standard FROM batting_files WHERE line_no = 0")
def one_hot_drop_first(spark, d):
    t = table(spark, d, "batting_files").where("line_no = 0").select("feed", "kind", "file_id")
    return features.one_hot(t.withColumn("k", F.col("kind")), "k", ["advanced", "standard"], "kind_")


@query(f"""WITH l AS (SELECT row_id, team, {fin('era')} AS era FROM pitching_combined_all), m AS (SELECT team, avg(era) AS m FROM l WHERE team IS NOT NULL GROUP BY team)
SELECT row_id, round(coalesce(m.m, (SELECT avg(era) FROM l)), 6) AS team_era FROM l LEFT JOIN m USING (team)""")
def target_encode_mean(spark, d):
    t = nan_to_null(table(spark, d, "pitching_combined_all").select("row_id", "team", "era"))
    return features.target_encode(t, "team", "era", "team_era").select("row_id", r6(F.col("team_era"), "team_era"))


@query("SELECT row_id, team, year, CAST(row_number() OVER (PARTITION BY team, year ORDER BY row_id) AS INTEGER) AS n FROM pitching_combined_all")
def row_numbers(spark, d):
    return files.with_ordinal(table(spark, d, "pitching_combined_all").select("row_id", "team", "year"), "row_id", "n", ["team", "year"])


@query(f"""WITH u AS (SELECT row_id, {fin('era')} AS era, {fin('whip')} AS whip FROM pitching_combined_all), v AS (SELECT * FROM u WHERE era IS NOT NULL AND whip IS NOT NULL),
m AS (SELECT avg(era) AS a, stddev_samp(era) AS b, avg(whip) AS c, stddev_samp(whip) AS d FROM v) SELECT row_id, round((era - a) / b, 5) AS era, round((whip - c) / d, 5) AS whip FROM v, m""")
def standardised(spark, d):
    t = nan_to_null(table(spark, d, "pitching_combined_all").select("row_id", "era", "whip")).na.drop(subset=["era", "whip"])
    v = features.values_of(features.standardise(features.assemble(t, ["era", "whip"], fill="zero").select("row_id", "features")), "scaled", ["era", "whip"])
    return v.select("row_id", F.round("era", 5).alias("era"), F.round("whip", 5).alias("whip"))


_FEATURES_SQL = " AND ".join((fin(f'"{f}"') if f in ("era", "k/9", "whip", "fip", "ip", "avg") else f'"{f}"') + " IS NOT NULL" for f in ["era", "bb", "k/9", "whip", "fip", "ip", "so", "hr", "age", "avg"])


@query(f"SELECT row_id, year FROM pitching_combined_all WHERE {_FEATURES_SQL}")
def complete_cases(spark, d):
    return nan_to_null(table(spark, d, "pitching_combined_all")).na.drop(subset=FEATURES).select("row_id", "year")


@query("""SELECT p.row_id, a.round, a.pick FROM pitching_combined_all p JOIN (SELECT "Player Name" AS n, "Year" AS y, min("Round") AS round, min("Pick") AS pick FROM all_drafts GROUP BY 1, 2) a
ON p.name = a.n AND p.year = a.y WHERE a.round IS NOT NULL AND a.pick IS NOT NULL""")
def drafted_positives(spark, d):
    return _labelled(spark, d).where("label = 1").na.drop(subset=["round", "pick"]).select("row_id", "round", "pick")


@query(f"SELECT row_id, CAST(round_even({fin('era')} * 2, 0) AS INTEGER) AS halves FROM pitching_combined_all WHERE isfinite(era)")
def rounded_to_int(spark, d):
    t = nan_to_null(table(spark, d, "pitching_combined_all").select("row_id", "era")).where("era is not null")
    return t.select("row_id", F.rint(F.col("era") * 2).cast("int").alias("halves"))


# ------------------------------------------------------------------ evaluation

_RULE = """r AS (SELECT CAST("W" > "L" AS INTEGER) AS y, CAST("R (Batting)" > "R (Pitching)" AS INTEGER) AS p, "R (Batting)" - "R (Pitching)" AS s, """ + _SHARE + """ AS w, "PE" AS e FROM ncaabb_dataset
WHERE isfinite("W") AND isfinite("L") AND isfinite("R (Batting)") AND isfinite("R (Pitching)"))"""


def _ruled(spark, d) -> DataFrame:
    t = nan_to_null(table(spark, d, "ncaabb_dataset"))
    b, p = q("R (Batting)"), q("R (Pitching)")
    t = t.where(F.col("W").isNotNull() & F.col("L").isNotNull() & b.isNotNull() & p.isNotNull())
    return t.select((F.col("W") > F.col("L")).cast("int").alias("y"), (b > p).cast("int").alias("p"), (b - p).alias("s"), N.share_of(F.col("WPCT")).alias("w"), F.col("PE").alias("e"))


@query(f"""WITH {_RULE}, c AS (SELECT unnest([0, 1]) AS k), o AS (SELECT CAST(k AS VARCHAR) AS class, count(*) FILTER (y = k AND p = k) AS tp, count(*) FILTER (y = k) AS support, count(*) FILTER (p = k) AS claimed FROM r, c GROUP BY k),
m AS (SELECT class, CASE WHEN claimed > 0 THEN tp / claimed ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, support FROM o),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f""")
def classify_report(spark, d):
    c = metrics.classification_report(_ruled(spark, d), "y", "p")
    return c.select("class", *[r6(F.col(x), x) for x in ("precision", "recall", "f1")], "support")


@query(f"WITH {_RULE} SELECT round(avg(CAST(y = p AS INTEGER)), 6) AS accuracy FROM r")
def accuracy(spark, d):
    return _ruled(spark, d).agg(r6(metrics.accuracy("y", "p"), "accuracy"))


@query(f"""WITH {_RULE}, u AS (SELECT w, e FROM r WHERE isfinite(w) AND isfinite(e)) SELECT round(avg(abs(w - e)), 6) AS mae, round(1 - sum(pow(w - e, 2)) / (var_pop(w) * count(*)), 6) AS r2 FROM u""")
def mae_r2(spark, d):
    return metrics.r2(_ruled(spark, d), "w", "e").select(r6(F.col("mae"), "mae"), r6(F.col("r2"), "r2"))


@query(f"""WITH {_RULE}, k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM r), c AS (SELECT count(*) FILTER (y = 1) AS a, count(*) FILTER (y <> 1) AS b, sum(r) FILTER (y = 1) AS t FROM k)
SELECT round((t - a * (a + 1) / 2.0) / (a * b), 6) AS auc FROM c""")
def roc_auc(spark, d):
    return metrics.roc_auc(_ruled(spark, d), "y", "s").select(r6(F.col("auc"), "auc"))


# ------------------------------------------------------------------ models (rows only: no SQL twin exists)

#: Player features of the models. Forests, the logistic regression and the search are fitted at the operators' defaults, other boosted trees at fewer
#: (README has the times).
FEATURES = ["era", "bb", "k/9", "whip", "fip", "ip", "so", "hr", "age", "avg"]
BOOSTED = {"trees": 50, "depth": 6}


def _split_features(spark, d, balance: bool = True) -> tuple[DataFrame, DataFrame]:
    t = cut(_labelled(spark, d).select("row_id", "year", "label", "pick", "round", *[q(f) for f in FEATURES]))  # sampling reads it several times
    if balance:
        t = cut(sampling.undersample(t, "label", "row_id"))
    t = evenly(features.assemble(sampling.stratified_split(t, "label", "row_id"), FEATURES).select("row_id", "year", "label", "pick", "round", "is_test", "features"))
    return t.where("not is_test"), t.where("is_test")


@query()
def rf_drafted(spark, d):
    train, test = _split_features(spark, d)
    m = models.forest("label").fit(train)
    return metrics.classification_report(models.predict(m, test), "label", "predicted")


@query()
def rf_round(spark, d):
    train, test = _split_features(spark, d)
    pos = lambda t: t.where("label = 1 and round is not null")
    m = models.forest("round").fit(pos(train))
    return models.predict(m, pos(test)).select("row_id", "round", "predicted")


@query()
def gbt_drafted(spark, d):
    train, test = _split_features(spark, d)
    m = models.boosted_classifier("label", weight="weight", **BOOSTED).fit(features.class_weight(train, "label"))
    return models.predict(m, test, threshold=0.5).select("row_id", "label", F.round("predicted_p1", 6).alias("p1"), "predicted")


@query()
def gbt_pick(spark, d):
    train, test = _split_features(spark, d, balance=False)
    pos = lambda t: t.where("label = 1 and pick is not null")
    m = models.boosted_regressor("pick", **BOOSTED).fit(pos(train))
    return metrics.r2(models.predict(m, pos(test)), "pick", "predicted")


@query()
def gbt_round(spark, d):
    train, test = _split_features(spark, d, balance=False)
    pos = lambda t: t.where("label = 1 and round is not null")
    m = models.boosted_regressor("round", columns=0.8, **BOOSTED).fit(pos(train))
    return metrics.r2(models.predict(m, pos(test)), "round", "predicted")


@query()
def logreg_importance(spark, d):
    """Coefficients on scaled complete cases, joined to the importances of boosted trees."""
    t = _labelled(spark, d).na.drop(subset=FEATURES)
    full = cut(features.standardise(features.assemble(t, FEATURES, fill="zero").select("label", "features")))
    g = models.boosted_classifier("label", **BOOSTED).fit(full)
    lr = models.logistic("label", full.count()).fit(full)
    imp = metrics.importance(spark, g, FEATURES)
    return metrics.coefficients(spark, lr, FEATURES).join(imp, "feature").orderBy(F.desc("magnitude"), "feature")


CATEGORIES = ["team"]


def _encoded(spark, d) -> tuple[DataFrame, DataFrame]:
    t = cut(_labelled(spark, d).select("row_id", "label", "team", *[q(f) for f in FEATURES]))  # sampling reads it several times
    t = sampling.stratified_split(cut(sampling.undersample(t, "label", "row_id")), "label", "row_id")
    t = evenly(t.select("row_id", "label", "is_test", F.upper(F.trim("team")).alias("team"), *[F.coalesce(q(f).cast("double"), F.lit(0.0)).alias(f.replace("/", "_per_")) for f in FEATURES]))
    return t.where("not is_test"), t.where("is_test")


@query()
def encoder_pipeline(spark, d):
    """Team encoded by its mean label, then boosted trees."""
    train, test = _encoded(spark, d)
    m = models.encoder_pipeline("label", CATEGORIES, [f.replace("/", "_per_") for f in FEATURES], **BOOSTED).fit(train)
    return metrics.roc_auc(models.predict(m, test), "label", "predicted_p1")


@query()
def model_search(spark, d):
    """Ten steps of the model-based search, then the pipeline of the best values."""
    train, test = _encoded(spark, d)
    numbers = [f.replace("/", "_per_") for f in FEATURES]
    v, cv = models.bayes_search(train, "label", CATEGORIES, numbers)
    enc = Pipeline(stages=models.encoder("label", CATEGORIES, numbers)).fit(train)
    m = boosting.fit(enc.transform(train), models.boosted_at(v, "label"))
    auc = metrics.roc_auc(models.predict(m, enc.transform(test)), "label", "predicted_p1")
    return auc.select("auc", F.lit(cv).alias("cv_auc"), *[F.lit(float(x)).alias(k) for k, x in v.items()])


#: Features of the two served models.
PITCHING, BATTING = ["era", "bb", "k/9", "hr", "whip"], ["slg", "avg", "hr", "bb", "obp"]


def _served(spark, d, source: str, names: list[str], allocate: bool) -> DataFrame:
    a = table(spark, d, "all_drafts").select(q("Player Name").alias("pn"), q("Year").alias("y"), q("Round").alias("round"), q("Pick").alias("pick"))
    first = a.groupBy("pn", "y").agg(F.min("round").alias("round"))
    t = nan_to_null(table(spark, d, source)).where("name is not null").join(first, (F.col("name") == F.col("pn")) & (F.col("year") == F.col("y")), "left")
    t = t.withColumn("label", F.col("pn").isNotNull().cast("int")).select("row_id", "name", "year", "team", "label", "round", *[q(f) for f in names])
    t = evenly(features.assemble(t, names, fill="zero").select("row_id", "name", "year", "team", "label", "round", "features"))
    drafted = models.forest("label").fit(sampling.undersample(t, "label", "row_id"))
    rounds = models.forest("round").fit(t.where("label = 1 and round is not null"))
    return draft.serve(t, drafted, rounds, a.select(F.col("y").alias("year"), "round", "pick") if allocate else None)


@query()
def predict_pitcher(spark, d):
    """Every pitcher season scored: drafted or not, the round, the sentence; a point query filters on name, year and team."""
    return _served(spark, d, "pitching_combined_all", PITCHING, False).select("row_id", "name", "year", "team", F.round("drafted_p1", 6).alias("p_drafted"), "drafted", "predicted_round", "said")


@query()
def predict_batter(spark, d):
    """The same for batters, with the pick that the allocator gives the predicted round."""
    return _served(spark, d, "batting_combined_all", BATTING, True).select(
        "row_id", "name", "year", "team", F.round("drafted_p1", 6).alias("p_drafted"), "drafted", "predicted_round", "picks", "pick", "said")


@query()
def two_stage_score(spark, d):
    train, test = _split_features(spark, d)
    a = models.boosted_classifier("label", **BOOSTED).fit(train)
    b = models.boosted_regressor("pick", **BOOSTED).fit(train.where("label = 1 and pick is not null"))
    return draft.two_stage(test, a, b).select("row_id", F.round("drafted_p1", 6).alias("p_drafted"), "drafted", "predicted_pick")


SYNTHETIC = {"age": ("int", 18, 24), "g": ("int", 5, 40), "so": ("int", 5, 120), "ip": ("float", 5.0, 110.0), "era": ("float", 1.5, 9.0), "whip": ("float", 0.8, 2.2)}


@query()
def synthetic_players(spark, d):
    return files.synthetic(spark, 1000, SYNTHETIC)
