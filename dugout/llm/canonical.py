"""Mapping free-entered values to a canonical list.

Each reference entry contributes alias paths (word orders, short forms, acronym) to a trie; an
entered value walks the trie with a Levenshtein automaton (adjacent swaps included) and returns
every entry within a distance that depends on its length. What the automaton returns is then
checked for the same legal form and place, and the cheapest entry left is the mapping.

The reference list is the bounded side. Up to ``CHUNK`` entries make one trie, which every task
builds once; a longer list is dealt out to as many tries as it needs, and the entered values, each
distinct one once, are searched in every one of them.

Defined results: null values are no entry; a value equal to a reference entry maps to itself with
distance 0; placeholders and blank values are unmatched; repeated values are mapped once; of equally
near entries the one of the smaller name wins and the value is flagged as ambiguous; an empty reference list leaves every value unmatched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.llm import school_names as S

#: Reference entries in one trie.
CHUNK = 20_000

#: Legal-form words as they are written out along alias paths.
_SPELLED = {"am": "am", "hs": "high school", "cc": "community college", "jc": "junior college", "ma": "military academy"}


def normal(s: str) -> str:
    """Tokens of a value with the words of the legal form written out and fillers dropped; typing errors in places stay."""
    out: list[str] = []
    toks = [t.strip(".'") for t in S.tokens_of(S.fold(s))]
    for i, t in enumerate(toks):
        if t in ("of", "the", "at", "in", "and") or not t:
            continue
        if t == "st":
            first = not out and (i == 0 or i + 1 < len(toks))
            out.append("saint" if first or (out and out[-1] in ("university", "college") and i + 1 < len(toks)) else "state")
        else:
            w = S.legal_word(t)
            out.append(_SPELLED.get(w, w) if w else t)
    return " ".join(out)


def alias_paths(name: str) -> set[str]:
    """Every way to write a reference entry that is not a typing error."""
    p = S.parse(name)
    out = {normal(name)}
    if p is None or not p.places:
        return out
    x = " ".join(p.places)
    if p.form == "campus" and len(p.places) == 2:
        a, b = p.places
        out |= {f"university {a} {b}", f"{a} {b}", f"{a} {b} campus", f"{b} university {a}", f"university {a} {b} campus", f"u{a[0]} {b}", f"{a} {b} university"}
    elif p.form in S.DIRECTIONS:
        d = p.form
        out |= {f"university {d} {x}", f"{d} {x} university", f"{d} {x}", f"{x} {d}"}
    elif p.form == "tech":
        out |= {f"{x} institute technology", f"institute technology {x}", f"{x} technology", f"{x} technology institute", f"{x} institute"}
    elif p.form == "am":
        out |= {f"{x} am university", f"{x} am", f"am {x}", f"university {x} am", f"{x} agricultural mechanical", f"{x} agricultural mechanical university"}
    elif p.form == "state":
        out |= {f"{x} state university", f"{x} state", f"state university {x}", f"university {x} state"}
    elif p.form == "saint":
        y = x + "s"
        out |= {f"saint {x} university", f"saint {x} college", f"saint {x}", f"saint {y} college", f"saint {y}", f"university saint {x}", f"college saint {x}"}
    elif p.form == "christian":
        out |= {f"{x} christian university", f"{x} christian", f"christian university {x}"}
    elif p.form == "military":
        out |= {f"{x} military academy", f"{x} military", f"military academy {x}"}
    elif p.form == "college":
        out |= {f"{x} college", f"college {x}", x, f"c {x}"}
    elif p.form == "university":
        out |= {f"university {x}", f"{x} university", x}
    return out


def most_errors(n: int) -> int:
    """Distance allowed for a value of ``n`` characters."""
    return 0 if n <= 4 else 1 if n <= 5 else 2 if n <= 12 else 3


class Trie:
    """Alias paths of reference entries, searched with a Levenshtein automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, path: str, entry: str) -> None:
        at = self.root
        for c in path:
            at = at.setdefault(c, {})
        at.setdefault("", []).append(entry)

    def search(self, word: str, most: int) -> list[tuple[str, int]]:
        """(entry, distance) of all entries with a path within ``most`` edits of ``word``. The automaton's state is
        the row of the edit matrix; a branch whose row exceeds ``most`` everywhere is left."""
        found: dict[str, int] = {}
        n = len(word)
        stack: list = [(self.root, list(range(n + 1)), None, "")]
        while stack:
            node, row, above, last = stack.pop()
            for c, nxt in node.items():
                if c == "":
                    if row[n] <= most:
                        for e in nxt:
                            if row[n] < found.get(e, most + 1):
                                found[e] = row[n]
                    continue
                depth = row[0] + 1
                lo, hi = max(1, depth - most), min(n, depth + most)
                new = [most + 1] * (n + 1)
                new[0] = depth
                best = depth
                for j in range(lo, hi + 1):
                    v = row[j - 1] + (word[j - 1] != c)
                    if row[j] + 1 < v:
                        v = row[j] + 1
                    if new[j - 1] + 1 < v:
                        v = new[j - 1] + 1
                    if above is not None and j > 1 and word[j - 2] == c and word[j - 1] == last and above[j - 2] + 1 < v:
                        v = above[j - 2] + 1
                    new[j] = v
                    if v < best:
                        best = v
                if best <= most:
                    stack.append((nxt, new, row, c))
        return list(found.items())


def _searcher(entries: list[tuple[str, list[str]]], morph: S.Morphology):
    """Worker function over distinct values, with one trie of ``entries`` (full name, acronyms)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, codes, names, short = Trie(), {}, {}, {}
        for name, acronyms in entries:
            for a in alias_paths(name):
                trie.add(a, name)
            for a in acronyms:
                codes.setdefault(S.fold(a), name)
            p = names[name] = S.parse(name)
            for x in p.places if p else ():  # alias paths of places cut short with a dot
                for n in range(S.SHORTEST, len(x)):
                    short.setdefault((p.form, x[:n]), []).append(name)
        for pdf in batches:
            rows = []
            for value in pdf["value"]:
                if value in names:
                    rows.append((value, value, 0.0))
                    continue
                if S.is_placeholder(value):
                    continue
                code = codes.get(S.fold(value))
                if code is not None and len(value.strip()) <= 6:
                    rows.append((value, code, 0.1))
                    continue
                k = S.parse(value)
                if k is None:
                    continue
                for x in k.short:
                    rows += [(value, name, 1.3) for name in short.get((k.form, x), ()) if S.begins(k, names[name])]
                text = normal(value)
                words = text.split(" ")
                # a remark of one word may follow the name, and state codes may stand in it
                tries = {text, " ".join(w for w in words if len(w) > 2 or w == "am")} | ({" ".join(words[:-1])} if len(words) > 2 else set())
                for q in sorted(tries):
                    for name, dist in trie.search(q, most_errors(len(q))):
                        cost = S.agree(k, names[name], morph) if names[name] else None
                        if cost is not None:
                            rows.append((value, name, 1.0 + cost + dist / 100))
            yield pd.DataFrame(rows, columns=["value", "entry", "cost"])

    return run


def near_entries(values: DataFrame, reference: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(value, entry, cost): for each distinct non-null ``value`` every entry of ``reference`` (name, acronym) that is near
    enough, the cheapest way to it."""
    distinct = values.where(F.col("value").isNotNull()).select("value").distinct()
    ref = reference.where(F.col("name").isNotNull()).groupBy("name").agg(F.sort_array(F.collect_set("acronym")).alias("acronyms"))
    n = ref.count()
    morph = S.Morphology.of(ref)
    chunks = max(1, -(-n // chunk))
    hits = None
    # the search is CPU-bound and its input small: a count of partitions that AQE leaves alone
    spread = distinct.repartition(distinct.sparkSession.sparkContext.defaultParallelism)
    for i in range(chunks):  # one trie of at most about ``chunk`` entries at a time is on the driver and in a task
        part = ref if chunks == 1 else ref.where(F.pmod(F.xxhash64("name"), F.lit(chunks)) == i)
        entries = [(r["name"], list(r["acronyms"])) for r in part.toLocalIterator()]
        found = spread.mapInPandas(_searcher(entries, morph), "value string, entry string, cost double")
        hits = found if hits is None else hits.unionByName(found)
    return hits.groupBy("value", "entry").agg(F.min("cost").alias("cost"))


def map_values(values: DataFrame, reference: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(value, entry, cost, n_near, ambiguous) for each distinct non-null ``value``: the nearest entry, null where none is near enough;
    how many are; and whether another one is as near as the nearest."""
    distinct = values.where(F.col("value").isNotNull()).select("value").distinct()
    best = near_entries(values, reference, chunk).groupBy("value").agg(
        F.min(F.struct("cost", "entry")).alias("b"), F.count(F.lit(1)).alias("n_near"), F.collect_list("cost").alias("costs"))
    best = best.select("value", "b.entry", "b.cost", "n_near", (F.size(F.filter("costs", lambda c: c <= F.col("b.cost"))) > 1).alias("ambiguous"))
    return distinct.join(best, "value", "left").na.fill({"n_near": 0, "ambiguous": False})
