"""Shares of true pairs found, and of found ones that are true, on invented people."""

import random

from dugout.llm import matching, spellings
from dugout.llm.person_names import NICKNAMES


def invented(seed, n):
    """(name, year, institution, person) rows: some people twice, a year on at their college or three years after school."""
    rng = random.Random(seed)
    firsts = sorted(NICKNAMES)
    part = lambda: rng.choice("bcdfghklmnprstvz") + rng.choice(["a", "e", "i", "o", "u", "au", "ei"]) + rng.choice(["l", "n", "r", "st", "ck", ""])

    def variant(first, last):
        kind = rng.random()
        if kind < 0.2:
            return f"{rng.choice(NICKNAMES[first].split()).title()} {last}"
        if kind < 0.35:
            return f"{first[0].upper()}. {last}"
        if kind < 0.5:
            return f"{last}, {first.title()}"
        if kind < 0.7:
            i = rng.randrange(1, len(last) - 1)
            return f"{first.title()} {last[:i] + last[i + 1] + last[i] + last[i + 2:] if rng.random() < 0.5 else last[:i] + last[i + 1:]}"
        return f"{first.title()} {last}"

    rows = []
    for person in range(n):
        first, last = rng.choice(firsts), (part() + part() + part()).title()
        year, inst = rng.randrange(2002, 2020), f"university|p{rng.randrange(60)}"
        kind = rng.random()
        if kind < 0.2:
            rows.append((f"{first.title()} {last}", year, inst, person))
            rows.append((variant(first, last), year + 1, inst, person))
        elif kind < 0.35:
            rows.append((f"{first.title()} {last}", year, f"high|h{rng.randrange(200)}", person))
            rows.append((variant(first, last), year + 3, inst, person))
        else:
            rows.append((variant(first, last), year, inst, person))
    rng.shuffle(rows)
    return rows


def test_links_of_draft_rows(spark):
    rows = invented(5, 3000)
    df = spark.createDataFrame([(i, n, y, s) for i, (n, y, s, _) in enumerate(rows)], "ord long, name string, year int, institution string")
    found = {(r["a"], r["b"]) for r in spellings.draft_evidence(df).where("confidence >= 0.5").collect()}
    where = {}
    for i, r in enumerate(rows):
        where.setdefault(r[3], []).append((r[1], i))
    true = {tuple(i for _, i in sorted(v)) for v in where.values() if len(v) == 2}
    both = len(found & true)
    assert both >= 0.95 * len(true) and both >= 0.97 * len(found), (len(true), len(found), both)


def test_matches_of_seasons_and_drafts(spark):
    rows = invented(9, 3000)
    rng = random.Random(1)
    seasons, drafts, true = [], [], set()
    for i, (name, year, inst, person) in enumerate(rows):
        if person % 2 and inst.startswith("university"):
            seasons += [(f"p{i}", name, y, inst) for y in range(year - rng.randrange(3), year + 1)]
            if rng.random() < 0.4:
                drafts.append((i, f"v{i}", name if rng.random() < 0.5 else name[:-2] + name[-1], year, inst if rng.random() < 0.9 else None))
                true.add((f"p{i}", i))
        else:
            drafts.append((i, f"v{i}", name, year, inst))
    s = spark.createDataFrame(seasons, "left_id string, name string, year int, institution string")
    d = spark.createDataFrame(drafts, "ord long, pick_id string, name string, year int, institution string")
    got = matching.match_drafts(s, d)
    found = {(r["left_id"], r["ord"]) for r in got.where("confidence > 0.5").collect()}
    both = len(found & true)
    assert both >= 0.95 * len(true) and both >= 0.95 * len(found), (len(true), len(found), both)
    assert got.where("not converged").count() == 0
