"""Matching entities across sources without keys: pitchers and draft rows.

Candidate pairs meet on a rewriting of the name and a stretch of years; each gets odds from name rarity,
school and year: the prior of such a pair, learned from all candidates by expectation maximisation, against how often chance
alone would bring it about. Where candidates compete,
loopy belief propagation with at-most-one factors settles them: a draft pick belongs to one pitcher
at most, a pitcher has one pick a season at most. The messages are exchanged by joins on the two
factors until none moves any more, under damping that grows with the rounds. The marginal probability of each pair is its confidence, and ``converged`` tells whether its messages came to rest
within ``MAX_ROUNDS``. Pairs without a rival on either side have their marginal at once and send no messages.

Defined results: rows without name or year have no candidates; repeated seasons and rows count
once; two draft rows of one pick share its marginal; ties share the probability and fall below the
threshold of one half if exactly even; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dugout.llm import evidence
from dugout.llm import spellings as S
from dugout.session import cut, spread, stage

#: Where learning starts: shares of pitchers that have a draft row of the same school, of another one (entered wrongly), or of
#: an unknown one, in the last season, the year after it, or an earlier season.
PRIORS = {
    "same last": 0.3, "same after": 0.1, "same earlier": 0.05, "other last": 0.01, "other after": 0.001, "other earlier": 0.0001,
    "unknown last": 0.2, "unknown after": 0.05, "unknown earlier": 0.01,
}

#: Messages stop once no marginal moves by more than TOLERANCE in a round; damping grows from the first value to the second, under
#: which even frustrated loops come to rest. MAX_ROUNDS is far above what any input needed; see ``converged``.
MAX_ROUNDS, TOLERANCE, DAMPING = 200, 1e-3, (0.3, 0.9)
#: Years of a stretch in which careers and drafts meet.
STRETCH = 4


def _keys(rows: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, id...) of ``rows`` and of ``drafts`` (reading and further columns): hashes of initial and surname less a letter, which every finer
    rewriting implies. However many drafts share one, all its pairs are met: a likelier school may outweigh the crowd, and each pair takes its part in the messages."""
    coarse = lambda t: t.withColumn("h", F.explode(S.coarse_keys("reading", "k")))
    return coarse(rows), coarse(drafts)


def distinct_pairs(people: DataFrame, base: DataFrame, n: float) -> DataFrame:
    """(row, ord, kr) of ``people`` (row, k, years, reading) and ``base`` (ord, year, readings n) that share a hash, met one run of stretches after another
    (see ``spellings.slices``), so that no more than a run's share of the hashed rows is on disk at a time."""
    stretch = lambda y: F.floor(y / STRETCH)
    bit = lambda y: F.element_at(F.array(*[F.lit(1 << i) for i in range(STRETCH)]), (F.pmod(y, F.lit(STRETCH)) + 1).cast("int"))
    within = lambda s: F.aggregate(F.filter("years", lambda y: stretch(y) == s), F.lit(0), lambda m, y: m.bitwiseOR(bit(y)))
    # beside its number a row carries what turns most pairs down before they are written: years of the stretch as bits, letters and first name
    letters, first = F.col("reading.letters").cast("bigint"), S.telling(F.col("reading"))
    out = None
    for lo, hi in S.slices(base, STRETCH, n):
        inside = lambda s: s.between(lo, hi)  # noqa: B023, E731
        at = F.filter(F.array_distinct(F.transform("years", stretch)), inside)
        left, right = _keys(
            people.select("row", "k", F.transform(at, lambda s: F.struct(s.alias("s"), within(s).alias("m"))).alias("at"), "reading").where(F.size("at") > 0),
            base.where(inside(stretch(F.col("year")))).select("ord", "year", F.posexplode("n").alias("k", "reading")))
        left = left.withColumn("s", F.explode("at")).select(
            F.xxhash64("h", "s.s").alias("at"), "row", (F.shiftleft(letters, STRETCH) + F.col("s.m")).alias("q"), first.alias("fl"))
        right = right.select(F.xxhash64("h", stretch(F.col("year"))).alias("at"), "ord", (
            F.shiftleft(letters, 8 + STRETCH) + F.shiftleft(bit(F.col("year")), 8) + F.col("k")).alias("p"), first.alias("fr"))
        met = stage(left.join(right, "at").where(
            (F.shiftright("p", 8).bitwiseAND(F.col("q")).bitwiseAND(F.lit((1 << STRETCH) - 1)) != 0)
            & S.letters_agree(F.shiftright("q", STRETCH), F.shiftright("p", 8 + STRETCH)) & S.firsts_agree(F.col("fl"), F.col("fr"))
        ).select("row", "ord", F.col("p").bitwiseAND(F.lit(255)).cast("int").alias("kr")).distinct())
        out = met if out is None else out.unionByName(met)
    return out


def candidates(seasons: DataFrame, drafts: DataFrame, priors: dict[str, float] | None = None) -> DataFrame:
    """(left_id, ord, pick_id, year, odds, relation, level) of pairs of ``seasons`` (left_id, name, year, institution) and
    ``drafts`` (ord, pick_id, name, year, institution). Both meet on hashes, with row numbers only; ``priors`` are where learning starts."""
    priors = priors or PRIORS
    s = seasons.where(F.col("name").isNotNull() & F.col("year").isNotNull())
    # a career: tens of seasons, schools and spellings at most
    who = stage(s.groupBy("left_id").agg(
        F.collect_set("name").alias("names"), F.collect_set("institution").alias("schools"), F.collect_set("year").alias("years"), F.max("year").alias("final"))
        .withColumn("years", F.array_union("years", F.array(F.col("final") + 1))))
    people = stage(spread(who).select("left_id", F.explode("names").alias("name"), "years").select("left_id", "name", "years", F.posexplode(S.rewritten("name")).alias("k", "reading")).select(
        F.xxhash64("left_id", "name", "k").alias("row"), "left_id", "k", "years", "reading"))
    base = stage(spread(drafts).where(F.col("name").isNotNull() & F.col("year").isNotNull()).select("ord", "pick_id", "year", "institution", S.rewritten("name").alias("n")))
    heads, tails = S.rarity(base)
    size = drafts.agg(F.count(F.lit(1)), F.countDistinct("year")).first()
    n, years = float(max(size[0], 1)), float(max(size[1], 1))
    share = drafts.where(F.col("institution").isNotNull()).groupBy("institution").agg((F.count(F.lit(1)) / n).alias("share"))
    met = distinct_pairs(people, base, n)
    # two rows of one hash, if that ever happens, only bring one more pair to be judged
    met = met.join(people.select("row", "left_id", F.col("k").alias("kl"), F.col("reading").alias("l"), "years"), "row").drop("row")
    met = met.join(base.select("ord", "pick_id", "year", "institution", F.posexplode("n").alias("kr", "r")), ["ord", "kr"]).where(F.array_contains("years", F.col("year")))
    known = met.drop("years").join(who.select("left_id", "schools", "final"), "left_id")
    relation = F.when(F.col("institution").isNull() | (F.size("schools") == 0), "unknown").when(
        F.array_contains("schools", F.col("institution")), "same").otherwise("other")
    when = F.when(F.col("year") == F.col("final"), " last").when(F.col("year") > F.col("final"), " after").otherwise(" earlier")
    rank_of = S.level_maps()[0]
    known = known.withColumn("relation", F.concat(relation, when))
    scored = cut(
        S.chances(stage(S.agreeing(known, ["left_id", "ord", "pick_id", "year", "institution", "relation"])), heads, tails).join(share, "institution", "left")
        .withColumn("expected", F.col("chance") * F.col("n_head") * F.col("n_tail") / F.lit(n * years)
                    * F.when(F.col("relation").startswith("same"), F.col("share")).otherwise(F.lit(1.0)))
        .groupBy("left_id", "ord", "relation")
        .agg(F.first("pick_id").alias("pick_id"), F.first("year").alias("year"), F.max_by(F.struct("level", "expected"), F.struct(rank_of[F.col("level")], -F.col("expected"))).alias("e"))
        .select("left_id", "ord", "pick_id", "year", "relation", "e.level", "e.expected")
    )
    count = who.agg(F.count(F.lit(1)), F.sum(F.size("years") - 2), F.count_if(F.size("schools") == 0)).first()
    rows = {"last": count[0], "after": count[0], "earlier": max(count[1] or 0, 0)}
    known = (1 - (count[2] or 0) / max(count[0], 1)) * ((drafts.agg(F.count("institution")).first()[0] or 0) / n)
    prior, level = evidence.learn(
        scored.select(F.col("relation").alias("cell"), "level", "expected"), priors, {k: v[1] for k, v in S.LEVELS.items()}, 
        lambda c: rows[c.split()[1]] * (1 - known if c.startswith("unknown") else known))
    odds = evidence.as_map(prior)[F.col("relation")] * evidence.as_map(level)[F.col("level")] / F.col("expected")
    return scored.select("left_id", "ord", "pick_id", "year", odds.alias("odds"), "relation", "level")


def marginals(pairs: DataFrame, rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(left_id, right_id, probability, converged) by loopy belief propagation over (left_id, left_slot, right_id, odds): at most
    one pair holds of each right_id, and of each left_id and left_slot. A message is the odds of the pair seen from one
    side, so a factor's answer to a pair is odds over one plus the sum of its other pairs' messages."""
    a, b = Window.partitionBy("left_id", "left_slot"), Window.partitionBy("right_id")
    base = cut(pairs.withColumn("na", F.count(F.lit(1)).over(a)).withColumn("nb", F.count(F.lit(1)).over(b)))
    done = base.where("na = 1 and nb = 1").select("left_id", "right_id", (F.col("odds") / (1 + F.col("odds"))).alias("probability"), F.lit(True).alias("converged"))
    state = base.where("na > 1 or nb > 1").select("left_id", "left_slot", "right_id", "odds", F.col("odds").alias("to_a"), F.col("odds").alias("to_b"))
    state = cut(state.withColumn("p", F.lit(0.0)))
    for k in range(rounds):
        # what each factor answers: 1 / (1 + sum of the others' messages)
        reply = state.withColumn("from_a", 1 / (1 + F.sum("to_a").over(a) - F.col("to_a"))).withColumn(
            "from_b", 1 / (1 + F.sum("to_b").over(b) - F.col("to_b")))
        damping = min(DAMPING[1], DAMPING[0] + 0.02 * max(0, k - 10))
        keep, new = F.lit(damping), F.lit(1 - damping)
        nxt = reply.withColumn("to_a", keep * F.col("to_a") + new * F.col("odds") * F.col("from_b")).withColumn(
            "to_b", keep * F.col("to_b") + new * F.col("odds") * F.col("from_a"))
        both = F.col("odds") * F.col("from_a") * F.col("from_b")
        nxt = nxt.withColumn("was", F.col("p")).withColumn("p", both / (1 + both)).drop("from_a", "from_b")
        # a pair rests once its marginal would stand still without damping too
        nxt = cut(nxt.withColumn("moves", F.abs(F.col("p") - F.col("was")) > tolerance * (1 - damping)))
        state = nxt.drop("was", "moves")
        if not nxt.where("moves").limit(1).count():
            return done.unionByName(state.select("left_id", "right_id", F.col("p").alias("probability"), F.lit(True).alias("converged")))
    if rounds:
        state = nxt.select("left_id", "right_id", "p", (~F.col("moves")).alias("converged"))
    else:
        state = state.select("left_id", "right_id", "p", F.lit(False).alias("converged"))
    return done.unionByName(state.withColumnRenamed("p", "probability"))


def match_drafts(seasons: DataFrame, drafts: DataFrame, priors: dict[str, float] | None = None) -> DataFrame:
    """(left_id, ord, relation, level, odds, confidence, converged) of every candidate pair."""
    c = cut(candidates(seasons, drafts, priors))
    picks = c.groupBy("left_id", F.col("year").alias("left_slot"), F.col("pick_id").alias("right_id")).agg(F.max("odds").alias("odds"))
    m = marginals(picks)
    return c.join(m, (c["left_id"] == m["left_id"]) & (c["pick_id"] == m["right_id"])).select(
        c["left_id"], "ord", "relation", "level", "odds", F.col("probability").alias("confidence"), "converged")
