"""Canonical rewritings of institution names.

A name is read as *legal form* (university, state university, college, junior college, high school,
...) and *places*; abbreviations, word order, state codes, articles and typing errors in the words of
the legal form disappear. What is left, the key ``form|places``, is what two spellings of one
institution share, up to typing errors in the places.

Null, blank and placeholder values (``TBD``, ``see notes``) have no rewriting.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Entries that name no institution.
PLACEHOLDERS = frozenset(
    """tbd|tba|n/a|na|none|no school|unknown|see notes|did not attend|-|--|?|not listed|undecided|pending|null|nan|no college|
    unattached|free agent|not available|not applicable|unk|x|xx|international|other|various|school unknown|no affiliation|to be determined|
    to be announced|none listed|not reported|withheld|home school|home schooled|homeschool""".replace("\n", "").replace("    ", "").split("|")
)

#: Words of the legal form, by what they stand for.
WORDS = {
    "university": ["university", "univ", "u", "uni", "univer", "universities"],
    "college": ["college", "coll", "col", "colleges"],
    "institute": ["institute", "inst", "institution"],
    "technology": ["technology", "tech", "technical", "technological", "polytechnic"],
    "state": ["state"],
    "saint": ["saint", "ste"],
    "community": ["community", "comm", "cmty"],
    "junior": ["junior", "jr"],
    "high": ["high"],
    "school": ["school", "sch", "schools"],
    "senior": ["senior"],
    "prep": ["preparatory", "prep"],
    "catholic": ["catholic", "cath"],
    "christian": ["christian", "christ", "chr"],
    "military": ["military", "mil"],
    "academy": ["academy", "acad"],
    "campus": ["campus"],
    "agricultural": ["agricultural"],
    "mechanical": ["mechanical"],
    "northern": ["northern", "north", "no", "n"],
    "southern": ["southern", "south", "so", "s"],
    "eastern": ["eastern", "east", "e"],
    "western": ["western", "west", "w"],
    "hs": ["hs"],
    "cc": ["cc"],
    "jc": ["jc"],
    "am": ["am"],
    "ma": ["ma"],
}
_FILLER = {"of", "the", "at", "in", "and"}
_EXACT = {v: k for k, vs in WORDS.items() for v in vs}
_LONG = [(v, k) for k, vs in WORDS.items() for v in vs if len(v) >= 4]
DIRECTIONS = ("northern", "southern", "eastern", "western")


def fold(s: str) -> str:
    """Lower case, accents off, white space single."""
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", s.replace("’", "'").lower()).strip()


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with adjacent swaps, cut off above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


@lru_cache(maxsize=100_000)
def legal_word(t: str) -> str | None:
    """The legal-form word that a token spells, typing errors included, or None."""
    if t in _EXACT:
        return _EXACT[t]
    if len(t) < 3:
        return None
    best, least = None, 99
    for v, k in _LONG:
        most = 1 if len(v) < 7 and (t[0] != v[0] or len(t) < (5 if v != "univ" else 4)) else 2
        if len(v) < 6 and len(t) < 4 and not (len(v) == 4 and t[0] == v[0]):
            continue
        d = osa(t, v, most)
        if d <= most and d < least:
            best, least = k, d
    return best


def tokens_of(s: str) -> list[str]:
    """Tokens of a folded name, dotted initials joined, remarks in brackets off."""
    s = re.sub(r"\([^)]*\)?", " ", s)
    s = re.sub(r"\ba\s*(?:&|and)\s*m\b|\ba\.\s*(?:&|and)\s*m\b\.?", " am ", s)
    s = s.replace("&", " and ")
    s = re.sub(r"\b(h\.\s?s|j\.\s?c|c\.\s?c|m\.\s?a)\b\.?", lambda m: " " + re.sub(r"[.\s]", "", m.group(1)) + " ", s)
    s = re.sub(r"'s\b", "", s)
    s = re.sub(r"(?<=[a-z])\.(?=[a-z])(?!of\b)", "", s)
    return [t for t in re.split(r"[^a-z0-9.'+]+", s) if t.strip(".'")]


class Parsed:
    """Reading of one spelling: ``form``, ``places`` in order, the direction if any, places cut short with a dot."""

    __slots__ = ("form", "places", "direction", "initial", "short", "separated")

    def __init__(self, form: str, places: tuple[str, ...], direction: str, initial: str, short: frozenset[str], separated: bool):
        self.form, self.places, self.direction = form, places, direction
        self.initial, self.short, self.separated = initial, short, separated

    @property
    def key(self) -> str:
        if self.initial:
            return f"initial|{self.initial} {' '.join(self.places)}"
        return f"{self.form}|{' '.join(sorted(self.places))}"


def is_placeholder(s: str | None) -> bool:
    return s is None or fold(s).strip(" .") in PLACEHOLDERS or not re.search(r"\w", s)


@lru_cache(maxsize=200_000)
def parse(s: str | None) -> Parsed | None:
    """The reading of a spelling, or None for a placeholder."""
    if is_placeholder(s):
        return None
    f = fold(re.sub(r"(?<=[a-z]{2})(?=[A-Z][a-z]{2})", " ", s))  # type: ignore[arg-type]
    separated = bool(re.search(r"[-–—,]|\bat\b|\bcampus\b", re.sub(r"\([^)]*\)?", "", f)))
    raw = tokens_of(f)
    seen: set[str] = set()
    places: list[str] = []
    direction, initial, short = "", "", set()
    bare = [t.strip(".'") for t in raw]
    for i, t in enumerate(bare):
        if t in _FILLER or not t:
            continue
        if t == "st":  # saint before a place, state after one
            first = not places and (i == 0 or bare[i - 1] in _FILLER or legal_word(bare[i - 1]) in ("university", "college"))
            seen.add("saint" if first and i + 1 < len(bare) else "state")
            continue
        if i == 0 and len(t) == 2 and t[0] == "u" and len(bare) == 2 and legal_word(bare[1]) is None:
            initial = t[1]
            seen.add("university")
            continue
        w = legal_word(t)
        if w in DIRECTIONS:
            if len(t) > 2 or (i + 1 < len(bare)) or raw[i].endswith("."):
                direction = w
                continue
        if w is not None and not (len(t) == 1 and t != "u"):
            seen.add(w)
            continue
        if t == "c" and i + 1 < len(bare) and bare[i + 1] == "of":
            seen.add("college")
            continue
        if len(t) <= 2:  # a state's code or a stray letter
            continue
        if raw[i].endswith("."):
            short.add(t)
        places.append(t)
    if "saint" in seen:
        places = [p[:-1] if p.endswith("s") and len(p) > 4 else p for p in places]
    if "hs" in seen or "high" in seen or "senior" in seen or "school" in seen or "prep" in seen or "catholic" in seen:
        form = "catholic" if "catholic" in seen else "prep" if "prep" in seen else "high"
    elif "ma" in seen or "military" in seen or "academy" in seen:
        form = "military"
    elif "cc" in seen or "community" in seen:
        form = "community"
    elif "jc" in seen or "junior" in seen:
        form = "junior"
    elif "christian" in seen:
        form = "christian"
    elif "am" in seen or ("agricultural" in seen or "mechanical" in seen):
        form = "am"
    elif "institute" in seen or "technology" in seen:
        form = "tech"
    elif "saint" in seen:
        form = "saint"
    elif direction:
        form = direction
    elif "state" in seen:
        form = "state"
    elif initial:
        form = "campus"
    elif len(places) >= 2 and "college" not in seen:
        form = "campus"
    elif "university" in seen:
        form = "university"
    elif "college" in seen:
        form = "college"
    else:
        form = "bare"
    return Parsed(form, tuple(places), direction, initial, frozenset(short), separated)


def deletions(s: str, most: int) -> set[str]:
    """``s`` and everything that up to ``most`` deleted letters leave of it."""
    out = {s}
    for _ in range(most):
        out |= {x[:i] + x[i + 1:] for x in out for i in range(len(x))}
    return out


def place_slack(n: int) -> int:
    """Typing errors allowed in a place of ``n`` letters."""
    return 0 if n < 4 else 1 if n < 6 else 2


#: Letters that a place cut short keeps at least.
SHORTEST = 3


def begins(k: Parsed, h: Parsed) -> bool:
    """Whether ``k`` is ``h`` with places cut short."""
    if not k.short or k.form != h.form or len(k.places) != len(h.places):
        return False
    left = list(h.places)
    for x in sorted(k.places, key=len, reverse=True):
        hit = next((y for y in left if (len(x) >= SHORTEST and y.startswith(x)) if x in k.short or x == y), None)
        if hit is None:
            return False
        left.remove(hit)
    return True


#: What a bare place can stand for, likeliest first.
BARE_FORMS = ("university", "college", "saint", "military", "christian")


def rewritings(s: str | None) -> list[tuple[str, float]]:
    """Every canonical rewriting of a spelling with its cost: the key itself, readings of a bare place, initials of a
    campus, places without a trailing nickname, truncated places, and typing errors as deletions."""
    p = parse(s)
    if p is None or (not p.places):
        return []
    out: dict[str, float] = {}

    def add(k: str, c: float) -> None:
        if c < out.get(k, 99.0):
            out[k] = c

    def spread(form: str, places: tuple[str, ...], c: float) -> None:
        """The exact key, and the key with letters deleted from one place or from two."""
        ps = sorted(places)
        add(f"{form}|{' '.join(ps)}", c)
        for i, x in enumerate(places):
            rest = sorted(places[:i] + places[i + 1:])
            for d in deletions(x, place_slack(len(x))):
                add(f"{form}~{d}~{' '.join(rest)}", c + (0.0 if d == x else 0.5))

    if p.initial:
        add(f"initial|{p.initial} {p.places[0]}", 0.2)
        for d in deletions(p.places[0], 1):
            add(f"initial~{p.initial} {d}", 0.7)
        return sorted(out.items())
    spread(p.form, p.places, 0.0)
    if p.form == "campus" and len(p.places) == 2:
        a, b = p.places
        for x, y in ((a, b), (b, a)):
            add(f"initial|{x[0]} {y}", 0.2)
            for d in deletions(y, 1):
                add(f"initial~{x[0]} {d}", 0.7)
    if len(p.places) >= 2 and not p.separated:
        spread("university" if p.form == "campus" else p.form, p.places[:1], 1.5)
    for i, x in enumerate(p.places):  # a place cut short with a dot meets every place that begins so
        rest = " ".join(sorted(p.places[:i] + p.places[i + 1:]))
        for n in [len(x)] if x in p.short else range(SHORTEST, len(x)):
            add(f"{p.form}^{x[:n]}^{rest}", 0.3 if x in p.short else 0.31)
    if p.form == "bare":
        for k, f in enumerate(BARE_FORMS):
            spread(f, p.places, 0.3 + 0.01 * k)
    return sorted(out.items())


def same_places(a: Iterable[str], b: Iterable[str]) -> int:
    """Least number of typing errors between two sets of places; 99 if they cannot be the same."""
    x, y = sorted(a), sorted(b)
    if len(x) != len(y):
        return 99
    orders = [y] if len(y) != 2 else [y, y[::-1]]
    best = 99
    for o in orders:
        total = 0
        for p, q in zip(x, o, strict=True):
            most = place_slack(max(len(p), len(q)))
            d = osa(p, q, most)
            if d > most:
                total = 99
                break
            total += d
        best = min(best, total)
    return best


class Morphology:
    """Recurrent stems and endings of a reference list's place names. A place that is itself a stem and an ending is a
    place of its own, not another one mistyped."""

    def __init__(self, places: Iterable[str], endings_of: int = 6, stems_of: int = 2):
        known = {p for p in places if len(p) >= 6}
        heads: dict[str, set[str]] = {}
        tails: dict[str, set[str]] = {}
        for p in known:
            for i in range(3, len(p) - 2):
                tails.setdefault(p[i:], set()).add(p[:i])
        many = {t: len(hs) for t, hs in tails.items() if len(hs) >= endings_of}
        # a tail that mostly comes from one longer tail is no ending of its own (-rest of -crest)
        self.endings = {t for t, n in many.items() if not any(len(u) > len(t) and u.endswith(t) and m >= 0.6 * n for u, m in many.items())}
        for t in self.endings:
            for h in tails[t]:
                heads.setdefault(h, set()).add(t)
        self.stems = {h for h, ts in heads.items() if len(ts) >= stems_of}
        self.known = known

    @classmethod
    def fit(cls, names: Iterable[str]) -> "Morphology":
        return cls([x for s in names for x in getattr(parse(s), "places", ())])

    @classmethod
    def of(cls, names: DataFrame) -> "Morphology":
        """Learned from every one of ``names`` (a column of that name), which are read on the executors; the driver sees each place once."""
        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"place": sorted({x for s in pdf["name"] for x in getattr(parse(s), "places", ())})}, dtype="object")

        return cls(r["place"] for r in names.where("name is not null").select("name").mapInPandas(read, "place string").distinct().toLocalIterator())

    def well_formed(self, place: str) -> bool:
        return place in self.known or any(place[:i] in self.stems and place[i:] in self.endings for i in range(3, len(place) - 2))


def agree(k: Parsed, h: Parsed, m: Morphology | None = None) -> float | None:
    """Cost of reading spelling ``k`` as institution ``h``; None if it cannot be that institution."""
    if not k.places or not h.places:
        return None

    def near(a: tuple[str, ...], b: tuple[str, ...]) -> float | None:
        d = same_places(a, b)
        if d > 3:
            return None
        if d and m is not None:
            odd = set(a) - set(b)
            if any(m.well_formed(x) for x in odd):
                return None
        return d + (0.25 if {x[0] for x in a} != {x[0] for x in b} else 0.0)  # a first letter is seldom mistyped

    if k.initial:
        if h.form != "campus" or len(h.places) != 2:
            return None
        for x, y in (h.places, h.places[::-1]):
            d = near(k.places, (y,))
            if x[0] == k.initial and d is not None:
                return 0.2 + d
        return None
    if h.initial:
        return None
    if k.form == h.form:
        d = near(k.places, h.places)
        if d is not None:
            return float(d)
        if begins(k, h):
            return 0.3
    if k.form == "bare" and h.form in BARE_FORMS:
        d = near(k.places, h.places)
        if d is not None:
            return 0.3 + d + 0.01 * BARE_FORMS.index(h.form)
    if len(k.places) == len(h.places) + 1 and not k.separated and len(h.places) == 1:
        if k.form == h.form or (k.form == "campus" and h.form == "university"):
            d = near(k.places[:1], h.places)
            if d is not None:
                return 1.5 + d
    return None
