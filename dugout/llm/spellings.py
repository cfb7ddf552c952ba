"""Variant spellings of names typed by people.

*Institutions*: each distinct spelling is rewritten to every canonical form that its rules allow
(:func:`dugout.llm.school_names.rewritings`); the forms are exploded and met by an equi-join with
the best-supported names of each form (hubs), a few at first, and the next ones only for names that none of them
takes. A hub is scored by the typing errors of the rewriting and by its rarity: the fewer names share the rarest form that both
have, the less likely they share it by chance. Following hubs to the end gives the institution.

*Persons*: a name is rewritten to first name and surname through nicknames, initials, token order
and typing errors. Draft rows meet on a rewriting together with evidence beside the name (same pick;
same institution within five years; school before college by the usual distance). A link counts if
the evidence is likelier for one person than for namesakes, whose number follows from how rare the
shared rewriting is in all rows.

Defined results: null, blank and placeholder values link to nothing; repeated rows and equal
spellings are linked once; ties between hubs go to the smaller key; empty tables give empty
results; only the named columns are read, so further columns of any name are harmless.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dugout.llm import evidence
from dugout.llm import person_names as P
from dugout.llm import school_names as S
from dugout.operators import pointers
from dugout.session import cut, spread, stage, unsent


#: Hubs of a form that are judged first; what twice as many names under the rarest shared form weigh, in typing errors.
HUBS, RARITY = 4, 0.1


def spell_support(values: DataFrame) -> DataFrame:
    """(spelling, n) of a one-column frame ``spelling``; nulls out, combined before the shuffle."""
    return values.where(F.col("spelling").isNotNull()).groupBy("spelling").agg(F.count(F.lit(1)).alias("n"))


def _reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for s, n, listed in zip(pdf["spelling"], pdf["n"], pdf["listed"], strict=True):
            p = S.parse(s)
            if p is not None and p.places:
                rows.append((s, int(n), bool(listed), p.key))
        yield pd.DataFrame(rows, columns=["spelling", "n", "listed", "key"])


def _judge(morph: S.Morphology):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                k, h = S.parse(r.sample), S.parse(r.hub_sample)
                cost = S.agree(k, h, morph) if k and h else None
                if cost is not None:
                    rows.append((r.key, r.hub, cost + RARITY * math.log2(r.names), r.hub_listed, r.hub_spellings))
            yield pd.DataFrame(rows, columns=["key", "hub", "score", "hub_listed", "hub_spellings"])

    return run


def institutions(spellings: DataFrame, listed: DataFrame, acronyms: DataFrame) -> DataFrame:
    """(spelling, institution, entered) for every spelling that names an institution; ``entered`` is false for names of
    the list that are no spelling themselves.

    ``spellings``: (spelling, n); ``listed``: names (spelling) known to be right; ``acronyms``: (acronym, spelling)."""
    known = listed.select("spelling").where(F.col("spelling").isNotNull()).distinct()
    morph = S.Morphology.of(known.withColumnRenamed("spelling", "name"))
    both = spellings.select("spelling", "n", F.lit(False).alias("listed")).unionByName(
        known.select("spelling", F.lit(1).cast("long").alias("n"), F.lit(True).alias("listed")))
    short = acronyms.select(F.lower(F.trim("acronym")).alias("acr"), F.col("spelling").alias("full")).groupBy("acr").agg(F.min("full").alias("full"))
    both = (
        both.join(short, F.lower(F.trim("spelling")) == F.col("acr"), "left")
        .select("spelling", "n", "listed", F.coalesce("full", "spelling").alias("read"))
    )
    read = cut(
        both.withColumnRenamed("spelling", "entered").withColumnRenamed("read", "spelling")
        .groupBy("spelling").agg(F.sum("n").alias("n"), F.max("listed").alias("listed"))
        .mapInPandas(_reading, "spelling string, n bigint, listed boolean, key string")
    )
    keys = read.groupBy("key").agg(
        F.sum("n").alias("n"), F.max("listed").alias("listed"), F.count(F.lit(1)).alias("spellings"), F.min("spelling").alias("sample"))
    # rewriting is CPU-bound and its input small: a count of partitions that AQE leaves alone
    forms = cut(keys.repartition(keys.sparkSession.sparkContext.defaultParallelism).mapInPandas(
        _rewrite_of_keys(morph),
        "key string, form string, own boolean, sample string, listed boolean, sound boolean, spellings bigint, n bigint"))
    rank = F.struct("listed", "sound", "spellings", "n", "key")
    own = forms.where("own").select("form", rank.alias("r"), F.col("sample").alias("hub_sample"))
    # how many names a form may stand for, and their order; a form is a few letters off a few names
    order = Window.partitionBy("form")
    hubs = cut(own.withColumn("k", F.row_number().over(order.orderBy(F.desc("r")))).withColumn("names", F.count(F.lit(1)).over(order)))
    seek = forms.where(~F.col("listed")).select("key", "sample", "form", rank.alias("mine"))
    settled, lo = None, 0
    while True:  # the best hubs of each form first; keys that none of them takes go on to the next ones, until there are no more
        hi = lo + HUBS if lo == 0 else 2 * lo
        cand = (
            seek.join(unsent(hubs.where(f"k > {lo} and k <= {hi}")), "form").where(F.col("r") > F.col("mine"))
            .groupBy("key", "sample", F.col("r.key").alias("hub"), "hub_sample", F.col("r.listed").alias("hub_listed"), F.col("r.spellings").alias("hub_spellings"))
            .agg(F.min("names").alias("names"))
        )
        judged = cand.mapInPandas(_judge(morph), "key string, hub string, score double, hub_listed boolean, hub_spellings bigint")
        best = cut(
            judged.groupBy("key").agg(F.min(F.struct("score", (~F.col("hub_listed")).alias("u"), (-F.col("hub_spellings")).alias("s"), "hub")).alias("b"))
            .select("key", F.col("b.hub").alias("up"))
        )
        settled = best if settled is None else settled.unionByName(best)
        if not hubs.where(f"k > {hi}").limit(1).count():
            break
        seek, lo = cut(seek.join(unsent(best), "key", "left_anti")), hi
    # hubs always rank higher than who follows them, so there is no cycle
    roots = keys.select("key").join(pointers.roots(settled), "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    full = read.join(roots, "key").select(F.col("spelling").alias("read"), F.col("root").alias("institution"))
    return both.join(full, "read").groupBy("spelling", "institution").agg((~F.every("listed")).alias("entered"))


def _rewrite_of_keys(morph: S.Morphology):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                p = S.parse(r.sample)
                sound = p.form not in ("bare", "initial") and all(morph.well_formed(x) for x in p.places)
                for form, cost in S.rewritings(r.sample):
                    own = p.form != "bare" and not p.initial and cost < 1.0  # forms under which others may find this name
                    rows.append((r.key, form, own, r.sample, r.listed, sound, r.spellings, r.n))
            yield pd.DataFrame(rows, columns=["key", "form", "own", "sample", "listed", "sound", "spellings", "n"])

    return run


# ---------------------------------------------------------------------------------------------- persons

#: Years between two drafts of one person, at most; pairs of up to ``CONTROL`` years are met too and tell what chance alone gives.
REACH, CONTROL = 5, 9
#: Where learning starts: shares of drafts that the same person follows up, by what else agrees and the years between
#: (1, 2, ... REACH). They weigh as much as ``evidence.PRIOR_ROWS`` rows.
PRIORS = {
    "same": (0.05, 0.005, 0.003, 0.001, 0.0005), "school": (0.005, 0.005, 0.1, 0.005, 0.002),
    "unknown": (0.05, 0.005, 0.01, 0.001, 0.0005), "other": (0.002, 0.0002, 0.0002, 0.0001, 0.00005),
}
#: By the strongest level on which two names agree (see ``person_names.rewritings``): its rank, the share of true pairs that
#: agree on it (where learning starts), and namesakes per pair that independent first names and surnames would give (measured by
#: matching against shifted years: full names hardly ever coincide, alike ones do).
LEVELS = {"E": (4, 0.75, 0.01), "T": (3, 0.15, 0.2), "I": (2, 0.1, 0.2), "K": (1, 0.02, 0.2)}
#: No prior times share of a level is taken to be larger than this; from it follows how many rows a rewriting may have before
#: chance explains every pair of them.
LARGEST = {"E": 0.5, "T": 0.3, "I": 0.2, "K": 0.05}
#: Share of namesakes whose middle initials agree; of those with one initial whose first names are within two typing errors.
MIDDLE, NEAR = 0.08, 0.15
#: Legal forms of schools that come before college.
SCHOOL_FORMS = ("high", "prep", "catholic")

_FIELDS = ("first", "mid", "last", "suffix", "names", "letters")
_NAME = "array<struct<first:string,mid:string,last:string,suffix:string,names:array<string>,letters:int>>"


def _rewritten(names: pd.Series) -> pd.Series:
    known: dict = {}
    out = []
    for n in names:
        n = n if isinstance(n, str) else None
        if n not in known:
            known[n] = [dict(zip(_FIELDS, x, strict=True)) for x in P.rewritings(n)]
        out.append(known[n])
    return pd.Series(out)


def rewritten(name: str) -> Column:
    """A name's readings (see ``person_names.rewritings``); empty for null."""
    return F.pandas_udf(_rewritten, _NAME)(F.col(name))


def initials(r: Column) -> Column:
    """``person_names.initials`` of a reading."""
    return F.when(F.size(r["names"]) > 0, F.array_distinct(F.transform(r["names"], lambda x: F.substring(x, 1, 1)))).otherwise(
        F.array(F.when(F.length(r["first"]) > 0, F.substring(r["first"], 1, 1)).otherwise("?")))


def tails(r: Column, k: Column) -> Column:
    """``person_names.tails`` of a reading, the k-th of its name."""
    last = r["last"]
    less = F.transform(F.sequence(F.lit(1), F.length(last)), lambda i: F.concat(F.substring(last, F.lit(1), i - 1), F.substring(last, i + 1, F.length(last))))
    return F.when((k == 0) & (F.length(last) >= 5), F.array_distinct(F.array_append(less, last))).otherwise(F.array(last))


def _hashed(mark: str, c: Column) -> Column:
    return F.transform(c, lambda x: F.xxhash64(F.lit(mark), x))


def rarity(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many rows of ``names`` (n: ``rewritten``) have each head and each tail: (head, n_head), (tail, n_tail), as hashes. Heads
    are formal names (E) and initials (I), tails surnames (E) and surnames less a letter (T)."""
    def count(c: str, of) -> DataFrame:
        flat = F.array_distinct(F.flatten(F.transform("n", of)))
        return names.select(F.explode(flat).alias(c)).groupBy(c).agg(F.count(F.lit(1)).alias(f"n_{c}"))

    return (count("head", lambda r, k: F.concat(_hashed("E", r["names"]), _hashed("I", initials(r)))),
            count("tail", lambda r, k: F.concat(_hashed("E", F.array(r["last"])), _hashed("T", tails(r, k)))))


def most_rows(level: str, n: float, years: float, share: Column | float = 1.0) -> Column:
    """Rows of a rewriting from which on chance explains every pair that meets on it: its head and its tail have as many
    rows at least, so ``expected`` exceeds the largest prior."""
    return F.sqrt(F.lit(LARGEST[level] / (LEVELS[level][2] * least_chance(level)) * n * years) / share)


def least_chance(level: str) -> float:
    """The factor by which other agreement lowers what is expected by chance, at most."""
    return MIDDLE * (NEAR if level in "IK" else 1.0)


def finer_keys(r: str, k: str) -> Column:
    """The rewritings of a reading that are finer than initial and deletion, as structs (level, h)."""
    c = F.col(r)
    key = lambda level, a, b: F.struct(F.lit(level).alias("level"), F.xxhash64(F.lit(level), a, b).alias("h"))
    return F.array_distinct(F.concat(
        F.transform(c["names"], lambda x: key("E", x, c["last"])), F.transform(initials(c), lambda x: key("I", x, c["last"])),
        F.flatten(F.transform(c["names"], lambda x: F.transform(tails(c, F.col(k)), lambda t: key("T", x, t))))))


def coarse_keys(r: str, k: str) -> Column:
    """Hashes of every initial with every deletion of a reading."""
    c = F.col(r)
    return F.array_distinct(F.flatten(F.transform(initials(c), lambda x: F.transform(tails(c, F.col(k)), lambda t: F.xxhash64(F.lit("K"), x, t)))))


def letters_agree(a: Column, b: Column) -> Column:
    """Whether the letters of two first names leave it open that they agree."""
    return (a == 0) | (b == 0) | (F.bit_count(a.bitwiseXOR(b)) <= 4)


def telling(r: Column) -> Column:
    """The first name of a reading where it says something about others (see ``person_names.letters``), else nothing. Rows that meet carry it, so that
    pairs that :func:`names_agree` would turn down are not written out first."""
    return F.when(r["letters"] != 0, r["first"]).otherwise("")


def firsts_agree(a: Column, b: Column) -> Column:
    """Whether two telling first names are equal or within the typing errors of :func:`names_agree`, or leave it open."""
    slack = F.when(F.least(F.length(a), F.length(b)) >= 5, 2).otherwise(1)
    return (a == b) | (a == "") | (b == "") | F.levenshtein(a, b, 2).between(0, slack)


def agreeing(met: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, level, chance and hashes of the heads ``hs`` and tails ``ts`` that pairs with readings ``l`` and ``r`` (the ``kl``-th and ``kr``-th of their names)
    share on their finest level; pairs that share none or cannot be one person are left out."""
    l, r = F.col("l"), F.col("r")
    names, same = F.array_intersect(l["names"], r["names"]), l["last"] == r["last"]
    full = F.size(names) > 0
    level = F.when(full & same, "E").when(full, "T").when(same, "I").otherwise("K")
    # what else agrees is rarer still by chance: the middle initial, or most letters of the first names
    middle = F.when((l["mid"] != "") & (l["mid"] == r["mid"]), MIDDLE).otherwise(1.0)
    near = F.when(F.col("level").isin("I", "K") & (F.length(l["first"]) > 1) & (F.length(r["first"]) > 1), NEAR).otherwise(1.0)
    chance = level_maps()[2][F.col("level")] * middle * near
    common = lambda f: F.array_intersect(f(l, F.col("kl")), f(r, F.col("kr")))
    return met.withColumn("level", level).where(names_agree("l", "r")).select(
        *keep, "level", chance.alias("chance"),
        F.when(full, _hashed("E", names)).otherwise(_hashed("I", common(lambda x, k: initials(x)))).alias("hs"),
        F.when(same, _hashed("E", F.array(l["last"]))).otherwise(_hashed("T", common(tails))).alias("ts")).where((F.size("hs") > 0) & (F.size("ts") > 0))


def chances(pairs: DataFrame, heads: DataFrame, tail_counts: DataFrame) -> DataFrame:
    """``agreeing`` pairs with n_head and n_tail of every head and tail that they share (see ``rarity``)."""
    return pairs.withColumn("head", F.explode("hs")).withColumn("tail", F.explode("ts")).drop("hs", "ts").join(unsent(heads), "head").join(unsent(tail_counts), "tail").drop("head", "tail")


def level_maps() -> list[Column]:
    """Rank, share and chance of a level as map columns."""
    return [F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (k, v[i])]) for i in range(3)]


def names_agree(a: str, b: str) -> Column:
    """Whether two readings of ``level`` can be one person: no conflict of middle initial or suffix, and first
    names that are equal, related through the form, an initial, or within two typing errors."""
    c = lambda s, k: F.col(f"{s}.{k}")
    clash = lambda k: (c(a, k) != "") & (c(b, k) != "") & (c(a, k) != c(b, k))
    initial = (F.length(c(a, "first")) == 1) | (F.length(c(b, "first")) == 1)
    slack = F.when(F.least(F.length(c(a, "first")), F.length(c(b, "first"))) >= 5, 2).otherwise(1)
    first = ~F.col("level").isin("I", "K") | initial | (F.levenshtein(c(a, "first"), c(b, "first")) <= slack)
    return ~clash("mid") & ~clash("suffix") & first & (F.levenshtein(c(a, "last"), c(b, "last")) <= 2)


#: Draft rows whose hashed rewritings are met at a time, about; runs at most, however odd some years are.
AT_A_TIME, RUNS = 100_000, 8


def slices(rows: DataFrame, width: int, n: float) -> list[tuple[int, int]]:
    """(first, last) of runs of stretches of ``width`` years that cover the years of ``rows``, each of about ``AT_A_TIME`` of the ``n`` rows or one
    stretch. Rows of different runs never meet, so runs can be met one after another."""
    least, most = rows.agg(F.min("year"), F.max("year")).first()
    if least is None:
        return [(0, 0)]
    first, last = least // width, most // width
    span = last - first + 1
    step = max(1, int(span * AT_A_TIME / max(n, 1.0)), -(-span // RUNS))
    return [(s, min(s + step - 1, last)) for s in range(first, last + 1, step)]


def _near(keys: DataFrame, lo: int, hi: int) -> DataFrame:
    """(a, ka, b, kb, gap) of rows (h, ord, k, year, letters, first) that share a key and may agree in their first names, ``a`` one to CONTROL years
    before ``b``, whose stretch is one of ``lo`` to ``hi``; they meet within stretches of REACH years, of which REACH years touch two, so gaps beyond are met in part only.
    What a row carries beside its number is packed into one: 32 bits of letters, 16 of the year, 8 of the reading."""
    stretch = F.floor(F.col("year") / REACH)
    packed = F.shiftleft(F.col("letters").cast("bigint"), 24) + F.shiftleft(F.col("year").cast("bigint"), 8) + F.col("k")
    part = lambda c, at, bits: F.shiftright(F.col(c), at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    keys = keys.where("year between 0 and 65535").select("h", "ord", packed.alias("p"), "first", stretch.alias("s"))
    x = keys.withColumn("s", F.explode(F.array(F.col("s"), F.col("s") + 1))).where(F.col("s").between(lo, hi)).select(F.xxhash64("h", "s").alias("at"), F.col("ord").alias("a"), F.col("p").alias("pa"), F.col("first").alias("fa"))
    y = keys.where(F.col("s").between(lo, hi)).select(F.xxhash64("h", "s").alias("at"), F.col("ord").alias("b"), F.col("p").alias("pb"), F.col("first").alias("fb"))
    gap = part("pb", 8, 16) - part("pa", 8, 16)
    met = x.join(unsent(y), "at").where(gap.between(1, CONTROL) & letters_agree(part("pa", 24, 32), part("pb", 24, 32)) & firsts_agree(F.col("fa"), F.col("fb")))
    return met.select("a", part("pa", 0, 8).alias("ka"), "b", part("pb", 0, 8).alias("kb"), gap.alias("gap"))


def meetings(rows: DataFrame, n: float, years: float) -> DataFrame:
    """(a, ka, b, kb, gap): rows (ord, k, year, institution, reading) that share a rewriting.

    Rows meet on the hash of initial and deletion, which every other rewriting implies, and carry numbers only. A rewriting of so many rows that
    chance explains every pair on its level is taken apart: its rows meet on each finer rewriting, and on each with the
    institution, that has not too many rows in its turn. So no rewriting brings more pairs than its bound allows, and no
    pair that could be linked is lost. They meet one run of stretches after another (see ``slices``), so that no more than a
    run's share of the hashed rows is on disk at a time."""
    rows = rows.withColumn("letters", F.col("reading.letters")).withColumn("first", telling(F.col("reading")))
    cols = ["ord", "k", "year", "letters", "first"]
    keys_of = lambda t: t.select(*cols, F.explode(coarse_keys("reading", "k")).alias("h"))
    hot = cut(keys_of(rows).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most_rows("K", n, years)).select("h"))
    crowded = hot.limit(1).count() > 0
    if crowded:
        share = cut(rows.where("institution is not null").groupBy("institution").agg((F.countDistinct("ord") / n).alias("share")))

        def finer(t: DataFrame) -> DataFrame:
            keys = keys_of(t).join(hot, "h", "left_semi")
            fine = t.join(unsent(keys.select("ord", "k").distinct()), ["ord", "k"]).select(*cols, "institution", F.explode(finer_keys("reading", "k")).alias("f")).select(*cols, "institution", "f.level", "f.h")
            coarse = keys.join(unsent(t.select("ord", "k", "institution")), ["ord", "k"]).select(*cols, "institution", F.lit("K").alias("level"), "h")
            at = fine.unionByName(coarse).where("institution is not null").withColumn("h", F.xxhash64("h", "institution"))
            return fine.withColumn("share", F.lit(1.0)).unionByName(at.join(share, "institution"))

        limit = F.coalesce(*[F.when(F.col("level") == x, most_rows(x, n, years, F.col("share"))) for x in LEVELS])
        size = cut(finer(rows).groupBy("h", "level").agg(F.count(F.lit(1)).alias("c"), F.max("share").alias("share")).where(F.col("c") <= limit).select("h"))
    out = None
    for lo, hi in slices(rows, REACH, n):
        part = rows.where(F.floor(F.col("year") / REACH).between(lo - 1, hi))
        keys = keys_of(part)
        if crowded:
            keys = keys.join(hot, "h", "left_anti").unionByName(finer(part).join(unsent(size), "h", "left_semi").select(*cols, "h"))
        met = stage(_near(keys, lo, hi).distinct())
        out = met if out is None else out.unionByName(met)
    return out


def draft_evidence(drafts: DataFrame) -> DataFrame:
    """Candidate links (a, b, relation, gap, level, expected, confidence) between rows (ord, name, year, institution), at most
    REACH years apart; readings are fetched for the pairs that met."""
    base = stage(spread(drafts).select("ord", "year", "institution", F.split("institution", r"\|")[0].isin(list(SCHOOL_FORMS)).alias("school"), rewritten("name").alias("n")))
    total = base.agg(F.count(F.lit(1)), F.countDistinct("year"), F.count_if("school"), F.count("institution")).first()
    n, years = float(max(total[0], 1)), float(max(total[1], 1))
    heads, tails = rarity(base)
    share = base.where(F.col("institution").isNotNull()).groupBy("institution").agg((F.count(F.lit(1)) / n).alias("share"))
    rank_of = level_maps()[0]
    rows = base.where("year is not null").select("ord", "year", "institution", F.posexplode("n").alias("k", "reading"))
    met = meetings(rows, n, years)
    side = lambda x, y: base.select(F.col("ord").alias(x), F.posexplode("n").alias(f"k{x}", y), F.col("institution").alias(f"i{x}"), F.col("school").alias(f"s{x}"))
    both = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    relation = F.when(~both, "unknown").when(F.col("ia") == F.col("ib"), "same").when(F.col("sa") & ~F.col("sb"), "school").otherwise("other")
    known = met.join(unsent(side("a", "l")), ["a", "ka"]).join(unsent(side("b", "r")), ["b", "kb"]).withColumn("relation", relation).withColumnsRenamed({"ka": "kl", "kb": "kr"})
    scored = (
        chances(stage(agreeing(known, ["a", "b", "gap", "relation", "ib"])), heads, tails).join(share.withColumnRenamed("institution", "ib"), "ib", "left")
        .withColumn("expected", F.col("chance") * F.col("n_head") * F.col("n_tail") / F.lit(n * years)
                    * F.when(F.col("relation") == "same", F.col("share")).otherwise(F.lit(1.0)))
        .groupBy("a", "b", "gap", "relation")
        .agg(F.max_by(F.struct("level", "expected"), F.struct(rank_of[F.col("level")], -F.col("expected"))).alias("e"))
        .select("a", "b", "gap", "relation", "e.level", "e.expected")
    )
    cell = F.concat("relation", F.when(F.col("gap") <= REACH, F.col("gap").cast("string")).otherwise("-"))
    scored = cut(scored.withColumn("cell", cell))
    # of the gaps beyond REACH one in two is met on the whole; nobody is drafted again then
    start = {f"{r}{g + 1}": p for r, ps in PRIORS.items() for g, p in enumerate(ps)} | {f"{r}-": 0.0 for r in PRIORS}
    known = total[3] / n
    size = {"same": total[3], "school": total[2], "unknown": n * (1 - known * known), "other": total[3]}
    beyond = sum(1 - (g - REACH) / REACH for g in range(REACH + 1, CONTROL + 1))
    prior, level = evidence.learn(
        scored, start, {k: v[1] for k, v in LEVELS.items()},
        lambda c: size[c[:-1]] * (beyond if c[-1] == "-" else 1.0), lambda c: c[:-1] + "-")
    odds = F.least(evidence.as_map(prior)[F.col("cell")] * evidence.as_map(level)[F.col("level")], evidence.as_map(LARGEST)[F.col("level")]) / F.col("expected")
    return scored.where(F.col("gap") <= REACH).withColumn("confidence", odds / (1 + odds)).drop("cell").select(
        "a", "b", "relation", "gap", "level", "expected", "confidence")


def same_pick(drafts: DataFrame) -> DataFrame:
    """Links of rows with the same year, round and pick to the first of them; a null in any of the three links nothing."""
    keys = ["year", "round", "pick"]
    rows = drafts.select("ord", *keys).where(" and ".join(f"{k} is not null" for k in keys))
    first = rows.groupBy(*keys).agg(F.min("ord").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(unsent(first), keys).where("a <> ord").select("a", F.col("ord").alias("b"))
