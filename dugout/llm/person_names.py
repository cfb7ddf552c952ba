"""Canonical rewritings of persons' names: nicknames, initials, token order, suffixes and typing errors."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from dugout.llm.school_names import osa

#: Short forms of given names, by the formal name.
NICKNAMES: dict[str, str] = {
    "alejandro": "ale jandro alex", "alexander": "alex xander al sandy lex", "andrew": "andy drew", "anthony": "tony ant",
    "augustus": "gus august", "bartholomew": "bart", "benjamin": "ben benny benji", "bradley": "brad", "cameron": "cam",
    "charles": "charlie chuck chas charley", "christopher": "chris topher kit", "cornelius": "neil corny con", "daniel": "dan danny",
    "dominic": "dom nic", "donovan": "don donnie", "douglas": "doug", "eduardo": "lalo eddie ed edu", "edward": "ed eddie ned ted teddy",
    "ezekiel": "zeke", "francisco": "paco frank pancho cisco", "frederick": "fred freddy freddie rick", "gabriel": "gabe",
    "gerald": "gerry jerry", "gregory": "greg", "guillermo": "memo", "harrison": "harry", "ignacio": "nacho iggy", "isaiah": "ike zay",
    "jackson": "jack", "jacob": "jake", "james": "jim jimmy jamie", "jeffrey": "jeff", "jeremiah": "jerem jerry jeremy", "jonathan": "jon jonny nathan",
    "jose": "pepe", "joseph": "joe joey", "joshua": "josh", "kenneth": "ken kenny", "lawrence": "larry lars laurie", "leonard": "len lenny leo",
    "manuel": "manny manolo", "matthew": "matt matty", "maxwell": "max", "michael": "mike mikey mick", "mitchell": "mitch",
    "nathaniel": "nat nate nathan", "nicholas": "nick nicky", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rafael": "rafa",
    "raymond": "ray", "richard": "rick dick richie rich", "robert": "bob bobby rob robbie bert", "roberto": "beto rob", "ronald": "ron ronnie",
    "russell": "russ", "salvador": "chava sal", "samuel": "sam sammy", "sebastian": "seb bash", "solomon": "sol", "stephen": "steve stevie steph",
    "terrence": "terry", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim timmy", "tobias": "toby", "vincent": "vince vinny vin",
    "walter": "walt wally", "wesley": "wes", "william": "will bill billy liam willy", "zachary": "zach zack", "jason": "jay", "ronaldo": "ron",
}
_FORMAL: dict[str, list[str]] = {}
for _k, _v in NICKNAMES.items():
    for _n in _v.split():
        _FORMAL.setdefault(_n, []).append(_k)

_SUFFIX = re.compile(r"[,\s]+(jr|sr|ii|iii|iv)\.?$")


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s)
    return re.sub(r"\s+", " ", "".join(c for c in s if not unicodedata.combining(c)).replace("’", "'")).strip()


@lru_cache(maxsize=200_000)
def parse(name: str | None) -> tuple[str, str, str, str, bool] | None:
    """(first, middle initial, surname, suffix, order is sure) of a name as typed, or None. First may be an initial."""
    if name is None:
        return None
    s = fold(name)
    s = re.sub(r"\s*[\(\"'“”][^)\"'“”]*[\)\"'“”](?=\s|$)", "", s)
    low = s.lower()
    m = _SUFFIX.search(low)
    suffix = ""
    if m:
        suffix, s = m.group(1), s[: m.start()]
    sure = True
    if "," in s:
        last, _, first = s.partition(",")
        m = _SUFFIX.search(" " + first.lower().strip())
        if m:
            suffix, first = m.group(1), first[: max(0, len(first.rstrip()) - len(m.group(0)) + 1)]
        toks, tail = re.split(r"[\s.]+", first.strip()), re.split(r"\s+", last.strip())
        toks = [t for t in toks if t]
        surname = tail[-1] if tail else ""
    else:
        parts = [t for t in re.split(r"\s+", s) if t.strip(".")]
        if not parts:
            return None
        surname = parts[-1].strip(".")
        toks = [t for p in parts[:-1] for t in (re.split(r"\.", p) if "." in p else [p]) if t]
        if len(toks) == 1 and len(toks[0]) == 2 and toks[0].isupper() and not name.isupper():
            toks = [toks[0][0], toks[0][1]]
        sure = len(parts) != 2
    if not toks:
        return ("", "", surname.lower(), suffix, True)
    first = toks[0].lower().strip("'")
    mid = next((t[0].lower() for t in toks[1:] if t), "")
    return (first, mid, surname.lower(), suffix, sure)


@lru_cache(maxsize=100_000)
def formals(first: str) -> tuple[str, ...]:
    """Formal names that a typed first name may stand for, itself included; a mistyped formal name stands for it too
    (but for its first letter, which is seldom mistyped: Mason is not Jason)."""
    known = _FORMAL.get(first, [])
    if first in NICKNAMES or known or len(first) < 5:
        return (first, *known)
    near = [k for k in NICKNAMES if len(k) >= 5 and k[0] == first[0] and abs(len(k) - len(first)) <= 1 and osa(first, k, 1) <= 1]
    return (first, *near)


def readings(name: str | None) -> list[tuple[str, str, str, str, float]]:
    """(first, middle, surname, suffix, cost) of every reading; without a comma both orders of two words are possible."""
    p = parse(name)
    if p is None or not p[2]:
        return []
    first, mid, last, suffix, sure = p
    out = [(first, mid, last, suffix, 0.0)]
    if not sure and len(first) > 2 and len(last) > 2:
        out.append((last, mid, first, suffix, 1.0))
    return out


def letters(first: str, names: tuple[str, ...]) -> int:
    """The letters of a first name as bits; 0 where it says little about others: for initials and short forms. First names within two
    typing errors differ in at most four bits."""
    if len(first) < 2 or names != (first,):
        return 0
    return sum(1 << (ord(c) - 97) for c in set(first) if "a" <= c <= "z")


def rewritings(name: str | None) -> list[tuple[str, str, str, str, list[str], int]]:
    """Every reading of a name with what its canonical rewritings are made of: (first, middle, surname, suffix, formal first
    names, letters of the first name). The reading as typed is the first one.

    A rewriting is one of the formal names or of their initials with the surname or with what one deleted letter leaves of it, which all
    single typing errors share. The pair of initial and deletion is the coarsest: two names that share any rewriting share one of
    those. By the finest that they share two names agree on level E (formal name and surname), T (formal name and a deletion), I
    (initial and surname) or K."""
    out = []
    for first, mid, last, suffix, _ in readings(name):
        names = formals(first) if len(first) > 1 else ()
        out.append((first, mid, last, suffix, sorted(names), letters(first, names)))
    return out


def initials(first: str, names: list[str]) -> list[str]:
    """Initials that a reading may be abbreviated to."""
    return sorted({f[0] for f in names or (first or "?",)})


def tails(last: str, typed: bool) -> list[str]:
    """The surname and, for a reading as typed of five letters or more, what one deleted letter leaves of it."""
    return sorted({last, *(last[:i] + last[i + 1:] for i in range(len(last)))}) if typed and len(last) >= 5 else [last]
