"""Draft matching, enrichment, pick allocation and two-stage scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.functions.text import clean, token_set_ratio
from dugout.operators.models import predict
from dugout.operators.relational import q

#: Token-set ratio from which two strings count as alike.
ALIKE = 90.0


def _rare_pieces(df: DataFrame, keep: list[str], alike: float) -> DataFrame:
    """``keep`` and ``k`` of (tokens, ...): of the letter pairs of a text's tokens (each token with a mark before it), numbered where they repeat, so many in the order of
    their hashes that two texts of at least this ratio share one. A text has at most d differences from one so alike, each spoils two
    pairs, so 2 d + 1 of them suffice; under a ratio of about 89 there may not be as many, and all texts get one piece."""
    slack = (100.0 - alike) / 100.0
    worst = 2 * slack / (1 - slack) if slack < 1 else 1.0
    if worst > 0.25:
        return df.select(*keep, F.lit(0).cast("bigint").alias("k"))
    pairs = F.flatten(F.transform("tokens", lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit("^"), w), i, F.lit(2)))))
    # a column of its own, so that it is made once a text and not once a pair
    d = df.select(*keep, "tokens", F.array_sort(pairs).alias("pairs"))
    numbered = F.transform("pairs", lambda x, i: F.xxhash64(x, i - F.array_position("pairs", x)))
    most = F.floor((F.size("pairs") + F.size("tokens") - 1) * worst + 1e-9).cast("int")
    return d.select(*keep, F.explode(F.slice(F.array_sort(numbered), F.lit(1), 2 * most + 1)).alias("k"))


def _near(x: DataFrame, y: DataFrame, by: list[str], a: str, b: str, alike: float) -> DataFrame:
    """(by..., a, b): pairs of two frames of distinct (by..., text) that can reach the ratio ``alike``, from equi-joins only.

    A token-set ratio is reached by the tokens in common, which then hold the longest token of one side (any token, where
    none has a fifth of the letters), or by all tokens, which then share a rare piece (see ``_rare_pieces``) and differ little in length."""
    def keyed(t: DataFrame, c: str, o: str) -> DataFrame:
        t = t.withColumn("tokens", F.array_distinct(F.array_remove(F.split(F.col(c), " "), ""))).where(F.size("tokens") > 0)
        tokens = F.col("tokens")
        longest = F.array_max(F.transform(tokens, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
        size = F.length(F.array_join(tokens, " "))
        ask = F.when(longest["n"] * 5 > size, F.array(longest["w"])).otherwise(tokens) if alike >= 90 else tokens
        return t.select(*by, c, "tokens", ask.alias("ask"), size.alias(o))

    l, r = keyed(x, a, "na"), keyed(y, b, "nb")
    # exploded tokens and pieces are many times what the planner thinks from the tables' files: none is ever broadcast
    pick = lambda t, c, what: t.select(*by, c, F.explode(what).alias("k")).hint("merge")
    shared = pick(l, a, "ask").join(pick(r, b, "tokens"), [*by, "k"]).select(*by, a, b).unionByName(
        pick(l, a, "tokens").join(pick(r, b, "ask"), [*by, "k"]).select(*by, a, b))
    close = _rare_pieces(l, [*by, a, "na"], alike).hint("merge").join(_rare_pieces(r, [*by, b, "nb"], alike), [*by, "k"]).where(
        F.abs(F.col("na") - F.col("nb")) <= (F.col("na") + F.col("nb")) * ((100.0 - alike) / 100.0) + 1e-9).select(*by, a, b)
    return shared.unionByName(close).distinct()


def fuzzy_match(players: DataFrame, drafts: DataFrame, alike: float = ALIKE, best: bool = False) -> DataFrame:
    """(pid, ord) of ``players`` (pid, name, school, year) and ``drafts`` (ord, name, school, year): same year and either
    equal schools with alike names or equal names with alike schools; the first draft row in file order wins (or, with
    ``best``, the most alike). Each alternative is an equi-join of its own on distinct strings that can be alike (see ``_near``), and the ratio is taken once a
    pair of strings. A blank school equals none."""
    p = players.select("pid", "year", clean(F.col("name")).alias("pn"), clean(F.col("school")).alias("ps"))
    d = drafts.select("ord", "year", clean(F.col("name")).alias("dn"), clean(F.col("school")).alias("ds"))

    def scored(same_a: str, same_b: str, a: str, b: str) -> DataFrame:
        x = p.where((F.col(same_a) != "") & F.col("year").isNotNull()).select("year", F.col(same_a).alias("s"), a).distinct()
        y = d.where((F.col(same_b) != "") & F.col("year").isNotNull()).select("year", F.col(same_b).alias("s"), b).distinct()
        pairs = _near(x, y, ["year", "s"], a, b, alike)
        s = pairs.select(a, b).distinct().withColumn("score", token_set_ratio(F.col(a), F.col(b))).where(F.col("score") >= alike)
        return pairs.join(s.hint("merge"), [a, b]).withColumns({same_a: F.col("s"), same_b: F.col("s")}).select("year", "ps", "pn", "ds", "dn", "score")

    hits = scored("ps", "ds", "pn", "dn").unionByName(scored("pn", "dn", "ps", "ds")).groupBy("year", "ps", "pn", "ds", "dn").agg(F.max("score").alias("score"))
    rows = p.select("pid", "year", "ps", "pn").hint("merge").join(hits, ["year", "ps", "pn"]).join(
        d.select("ord", "year", "ds", "dn").hint("merge"), ["year", "ds", "dn"])
    order = F.struct((-F.col("score")).alias("s"), "ord") if best else F.struct("ord", "score")
    return rows.groupBy("pid").agg(F.min(order).alias("b")).select("pid", F.col("b.ord").alias("ord"))


def enrich(players: DataFrame, teams: DataFrame, seasons: DataFrame) -> DataFrame:
    """Players with the full name of their acronym (left join) and the stats of that team in that year (left join on both)."""
    t = teams.select(q("Acronym").alias("_a"), q("Full Name").alias("full_name"))
    return players.join(t, F.upper(F.trim("team")) == F.col("_a"), "left").drop("_a").join(seasons, ["team", "year"], "left")


def enrich_mapped(players: DataFrame, teams: DataFrame, mapping: DataFrame, seasons: DataFrame, with_year: bool = True) -> DataFrame:
    """Players (team, year, ...) with full name, the old names that ``mapping`` (team_old, team_new) has for it, and the rows of ``seasons``
    (season_team, season_year, ...) under that name, of the player's year or, without ``with_year``, of all. A team with several old
    names fans out; one without any is looked up by its full name."""
    t = teams.select(q("Acronym").alias("_a"), q("Full Name").alias("full_name"))
    j = players.join(t, F.upper(F.trim("team")) == F.col("_a"), "left").drop("_a").join(mapping, F.col("full_name") == F.col("team_new"), "left")
    on = F.coalesce("team_old", "full_name") == F.col("season_team")
    return j.join(seasons, on & (F.col("year") == F.col("season_year")) if with_year else on, "left")


def pick_allocation(rounds: DataFrame) -> DataFrame:
    """(year, round, picks, before, pick) from (year, round, pick): picks of a round are its largest pick, ``before`` those of
    all earlier rounds of the year, and the next pick is the smaller of the round's size and ``before`` + 1."""
    size = rounds.where(F.col("round").isNotNull()).groupBy("year", "round").agg(F.max("pick").alias("picks"))
    w = Window.partitionBy("year").orderBy("round")  # rounds of one year
    upto = F.sum("picks").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = size.withColumn("_u", upto).withColumn("before", F.lag("_u", 1, 0).over(w)).drop("_u")
    return d.withColumn("pick", F.least(F.col("picks"), F.col("before") + 1))


#: Picks and pick of a round that the year's drafts do not have.
UNKNOWN_PICKS, UNKNOWN_PICK = 30, 1


def with_pick(df: DataFrame, rounds: DataFrame, year: str = "year", round_: str = "predicted_round") -> DataFrame:
    """``df`` with picks and pick of its year and round by ``pick_allocation`` of ``rounds``; a round the year does not have gets
    the fallback, a null round nothing."""
    a = pick_allocation(rounds).select(F.col("year").alias("_y"), F.col("round").alias("_r"), F.col("picks").alias("_ps"), F.col("pick").alias("_p"))
    known = F.col(round_).isNotNull()
    j = df.join(a, (q(year) == F.col("_y")) & (q(round_) == F.col("_r")), "left")
    return j.withColumns({"picks": F.when(known, F.coalesce("_ps", F.lit(UNKNOWN_PICKS))), "pick": F.when(known, F.coalesce("_p", F.lit(UNKNOWN_PICK)))}).drop("_y", "_r", "_ps", "_p")


def serve(df: DataFrame, drafted, round_model, rounds: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``df`` (year, features...) with P(drafted), and where that reaches the threshold the predicted round and, if the drafts'
    ``rounds`` (year, round, pick) are given, the pick; and the sentence that says so. A point query is a filter on ``df``."""
    d = predict(drafted, df, "drafted")
    d = d.withColumn("drafted", (F.col("drafted_p1") >= threshold).cast("int"))
    d = predict(round_model, d, "_round", where=F.col("drafted") == 1).drop("_round_p1").withColumn("predicted_round", F.when(F.col("drafted") == 1, F.col("_round").cast("int"))).drop("_round")
    said = F.format_string("Drafted (prob=%.2f), round %d", "drafted_p1", "predicted_round")
    if rounds is not None:
        d = with_pick(d, rounds)
        said = F.format_string("Drafted (prob=%.2f), round %d, pick %d", "drafted_p1", "predicted_round", "pick")
    return d.withColumn("said", F.when(F.col("drafted") == 1, said).otherwise(F.format_string("Not drafted (prob=%.2f)", "drafted_p1")))


def two_stage(df: DataFrame, drafted, pick, threshold: float = 0.5) -> DataFrame:
    """``df`` with P(drafted), the decision and, only where drafted, the predicted pick."""
    d = predict(drafted, df, "drafted", threshold)
    d = predict(pick, d, "raw_pick")
    return d.withColumn("predicted_pick", F.when(F.col("drafted") == 1, F.rint("raw_pick").cast("int"))).drop("raw_pick")
