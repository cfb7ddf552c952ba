"""Evaluation texts leaking into training text, found by winnowing.

Texts become words (case, punctuation, markup, line breaks and hyphens at line ends do not count), words become 64-bit
hashes. Of the hashes of all ``K``-word grams the least of every ``WINDOW`` neighbours is kept, so any ``K + WINDOW - 1``
shared words in a row share a fingerprint. Training and test fingerprints are joined; each pair of texts that meets is
extended: runs of equal words are chained along both texts, across at most ``GAP`` changed words, and once across other
text that stands between the two halves. A pair counts from ``WORDS`` words of the test text, of which one in six may be
changed. Such a passage always has four unchanged words in a row, hence a fingerprint. Word pairs that stand in many
test texts are their common form ("season archive lists") and alone make no case: so many other pairs must agree, unless the
stretch is long or the whole text. Equal texts and near copies count once there, so a repeated text is never its own common form.

The corpus is streamed: it is read, tokenised and looked up in one pass, in whole batches of Arrow rows, and is neither
shuffled nor ever the built side of a join. The test side's fingerprints are a broadcast of arrays while the test texts
have at most ``BROADCAST_WORDS`` words, which is counted first (about 40 bytes a word). Beyond that both sides' fingerprints meet in a shuffle
join, and documents and test texts are brought to the pairs by sort-merge joins.

Extension looks up each run's predecessors by where they end and pairs halves by where they lie in the test text, so its
time grows with the words that both texts share, not with their square.

Defined results: null and empty texts hold nothing; texts shorter than ``WORDS`` words leak nothing; equal
documents are reported each; a pair is reported once however often it occurs; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.session import cut, long_rows, slices, spread

#: Words of a gram, grams of a window, words that make a case, changed words that a passage may hold between two runs.
K, WINDOW, WORDS, GAP = 3, 2, 12, 2
#: Of WORDS words at least so many are unchanged; share of unchanged words in a stretch.
MATCHED, DENSITY = 10, 0.79
#: A word pair in this share of the test texts (and in FORM_LEAST of them) is common form; pairs beyond it that a case needs.
FORM_SHARE, FORM_LEAST, OWN_PAIRS = 0.02, 3, 5
#: Words from which a stretch counts whatever its pairs are; share of a text's fingerprints in one other from which it is a near copy.
LONG, NEAR = 30, 0.3
#: Least unchanged words of each half where other text stands between two halves.
HALF = 4
#: Words of all test texts up to which their fingerprints are broadcast (about 40 MB of arrays).
BROADCAST_WORDS = 1_000_000
#: Characters that are tokenised at a time.
SLICE = 1 << 20

_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_MARKUP = re.compile(r"<[^<>]{0,300}>|&[A-Za-z]{2,8};|&#[0-9]{1,6};")
_LINE_END = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>*]*(?=[^\W\d_])")
_BREAK = re.compile(r"\s")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def words(text: str) -> list[str]:
    """The words of a text; each Chinese or Japanese character is one."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    if "-" in text:
        text = _LINE_END.sub("", text)
    text = text.casefold()
    find = _ASCII_WORD.findall
    if not text.isascii():
        text, find = unicodedata.normalize("NFC", text.translate(_INVISIBLE)), _WORD.findall
    if len(text) <= SLICE:
        return find(text)
    out: list[str] = []
    at = 0
    while at < len(text):  # slices end at white space, or else after a million characters without any
        stop = _BREAK.search(text, at + SLICE)
        end = min(stop.start() if stop else len(text), at + 2 * SLICE)
        out += find(text[at:end])
        at = end
    return out


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts one after the other, where each text begins and the last one ends)."""
    ws = [words(t) for t in texts]
    at = np.r_[0, np.cumsum([len(w) for w in ws])].astype(np.int64)
    flat = np.array([x for w in ws for x in w], dtype=object)
    return (pd.util.hash_array(flat) if len(flat) else np.zeros(0, np.uint64)), at


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word grams of consecutive words."""
    m = max(0, len(w) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = _mix(h + w[k:k + m])
    return h


def winnowed(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram hash, its first word's place) of the least gram of every window of each text; a text of fewer than WINDOW
    grams keeps its least one."""
    h = grams(w, K)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    valid = owner[: len(h)] == owner[K - 1: K - 1 + len(h)]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    g = np.where(valid, h, top)
    keep = np.zeros(len(g), bool)
    full = len(g) - WINDOW + 1
    if full > 0:
        least = g[:full].copy()
        for k in range(1, WINDOW):
            np.minimum(least, g[k:k + full], out=least)
        # a window lies in one text; at a text's end the shorter ones only add grams that other windows have
        for k in range(WINDOW):
            keep[k:k + full] |= g[k:k + full] == least
    elif len(g):
        keep |= g == g.min()
    keep &= valid
    place = np.flatnonzero(keep)
    return h[place], place


class Index:
    """Fingerprints, words and word pairs of test texts as sorted arrays."""

    def __init__(self, ids: np.ndarray, w: np.ndarray, at: np.ndarray, form: np.ndarray):
        self.ids, self.w, self.at = ids, w, at
        h, place = winnowed(w, at)
        item = np.searchsorted(at, place, side="right") - 1
        key = np.unique(np.stack([h, item.astype(np.uint64)], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
        self.prints, first = np.unique(key[:, 0], return_index=True)
        self.first = np.r_[first, len(key)].astype(np.int64)
        self.of = key[:, 1].astype(np.int64)
        self.pairs = np.unique(grams(w, 2)) if len(w) > 1 else np.zeros(0, np.uint64)
        self.form = form
        self._items: dict[int, tuple] = {}
        self.seen = self._bits(self.prints)
        self.seen_pairs = self._bits(self.pairs)

    @staticmethod
    def _bits(h: np.ndarray, size: int = 1 << 22) -> np.ndarray:
        b = np.zeros(size, bool)
        b[(h & np.uint64(size - 1)).astype(np.int64)] = True
        return b

    def __getstate__(self):
        return {**self.__dict__, "_items": {}, "seen": None, "seen_pairs": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.seen, self.seen_pairs = self._bits(self.prints), self._bits(self.pairs)

    @staticmethod
    def _find(h: np.ndarray, bits: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``h``, index into ``known``) of the hashes that are known."""
        maybe = np.flatnonzero(bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)])
        if not len(maybe) or not len(known):
            return maybe[:0], maybe[:0]
        k = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
        ok = known[k] == h[maybe]
        return maybe[ok], k[ok]

    def item(self, i: int) -> tuple[dict[int, list[int]], list[int], int]:
        """(places of each word pair, running count of word pairs of its own, words) of a test text."""
        got = self._items.get(i)
        if got is None:
            if len(self._items) > 5_000:
                self._items.clear()
            w = self.w[self.at[i]:self.at[i + 1]]
            p = grams(w, 2)
            k = np.searchsorted(self.pairs, p)
            places: dict[int, list[int]] = {}
            for x, y in enumerate(k.tolist()):
                places.setdefault(y, []).append(x)
            own = np.r_[0, np.cumsum(~np.isin(p, self.form))]
            got = self._items[i] = (places, own.tolist(), len(w))
        return got

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, words) of every passage of an item in one of the texts."""
        w, at = hashed(texts)
        h, place = winnowed(w, at)
        a, k = self._find(h, self.seen, self.prints)
        if not len(a):
            return []
        n = np.diff(self.first)[k]
        owner = np.repeat(np.searchsorted(at, place[a], side="right") - 1, n)
        item = self.of[np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        met = np.unique(owner * len(self.ids) + item)
        p, pk = self._find(grams(w, 2), self.seen_pairs, self.pairs)
        out, now, known = [], -1, []
        for x in met.tolist():
            d, i = divmod(x, len(self.ids))
            if d != now:
                lo, hi = np.searchsorted(p, [at[d], max(at[d], at[d + 1] - 1)])
                now, known = d, list(zip((p[lo:hi] - at[d]).tolist(), pk[lo:hi].tolist(), strict=True))
            places, own, size = self.item(i)
            passage = longest_passage(places, own, size, known)
            if passage:
                out.append((d, i, passage))
        return out


def longest_passage(places: dict[int, list[int]], own_pairs: list[int], size: int, known: list[tuple[int, int]]) -> int:
    """Words of a test text of ``size`` words (``places`` of its word pairs, running count of its own ones) that stand in a text
    as a passage, changed ones within it included; 0 if below the bar. ``known``: (place, word pair) of the text in order."""
    runs: list[list[int]] = []  # [i, j, words]
    live: dict[int, list[int]] = {}
    last = -2
    for j, pair in known:
        at = places.get(pair)
        if not at:
            continue
        if j != last + 1:
            live = {}
        now: dict[int, list[int]] = {}
        for i in at:
            r = live.get(i - 1)
            if r is None:
                r = [i, j, 1]
                runs.append(r)
            r[2] += 1
            now[i] = r
        live, last = now, j
    if not runs or sum(r[2] for r in runs) < MATCHED:
        return 0
    runs.sort()

    def good(span: int, matched: int, own: int) -> bool:
        return span >= WORDS and matched >= MATCHED and (own >= OWN_PAIRS or span >= min(LONG, size)) and matched >= DENSITY * span

    ends: dict[tuple[int, int], list[tuple[int, int, int, int, int, int]]] = {}
    chains: list[tuple[int, int, int, int, int, int]] = []  # first i, first j, end i, end j, unchanged words, own pairs
    best = 0
    for i, j, n in runs:
        here = own_pairs[i + n - 1] - own_pairs[i]
        alone = top = (i, j, i + n, j + n, n, here)
        for gi in range(GAP + 1):
            for gj in range(GAP + 1):
                for c in ends.get((i - gi, j - gj), ()) if gi + gj else ():
                    m = c[4] + n
                    if m >= DENSITY * (i + n - c[0]) and m > top[4]:
                        top = (c[0], c[1], i + n, j + n, m, c[5] + here)
        more = [alone] if top is alone else [alone, top]
        ends.setdefault((i + n, j + n), []).extend(more)
        chains += more
        if good(top[2] - top[0], top[4], top[5]):
            best = max(best, top[2] - top[0])
    if best:
        return best
    # of halves with the same words of the test text the earliest end and the latest begin in the text can pair with most
    first: dict[tuple[int, int, int, int], int] = {}
    second: dict[int, dict[tuple[int, int, int], int]] = {}
    for i0, j0, i1, j1, n, own in chains:
        if n >= HALF and own > 0:
            k = (i0, i1, n, own)
            first[k] = min(first.get(k, j1), j1)
            s = second.setdefault(i0, {})
            s[(i1, n, own)] = max(s.get((i1, n, own), j0), j0)
    for (i0, i1, n, own), j1 in first.items():
        for gap in range(GAP + 1):
            for (e, m, o), j0 in second.get(i1 + gap, {}).items():
                if j0 >= j1 and good(i1 - i0 + e - i1 - gap, n + m, own + o):
                    best = max(best, e - i0 - gap)
    return best


def _index(ids: list[int], arrays: list[np.ndarray], form: np.ndarray) -> Index:
    at = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int64)
    flat = np.concatenate(arrays).astype(np.int64).view(np.uint64) if arrays else np.zeros(0, np.uint64)
    return Index(np.array(ids, dtype=np.int64), flat, at, form)


def shared_passage(item: list[str], doc: list[str], form: set[tuple[str, str]] = frozenset()) -> int:
    """Words of ``item`` that stand in ``doc`` as a passage, 0 if below the bar (both as words)."""
    num = {x: k for k, x in enumerate(sorted({*item, *doc}))}
    pair = lambda a, b: num[a] * len(num) + num[b]
    places: dict[int, list[int]] = {}
    own = [0]
    for i, (a, b) in enumerate(zip(item, item[1:], strict=False)):
        places.setdefault(pair(a, b), []).append(i)
        own.append(own[-1] + ((a, b) not in form))
    return longest_passage(places, own, len(item), [(j, pair(a, b)) for j, (a, b) in enumerate(zip(doc, doc[1:], strict=False))])


def tokenised(df: DataFrame, key: str) -> DataFrame:
    """(key, w): the word hashes of (key, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf["text"])
            for k, end in slices(texts):
                w, at = hashed(texts[k:end])
                w = w.view(np.int64)
                yield pd.DataFrame({key: pdf[key].iloc[k:end].to_numpy(), "w": [w[at[i]:at[i + 1]] for i in range(end - k)]})

    return df.select(key, "text").where(F.col("text").isNotNull()).mapInPandas(run, f"{key} bigint, w array<bigint>")


def fingerprints(df: DataFrame, key: str) -> DataFrame:
    """(key, h): the winnowed grams of (key, w), each once a text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ws = [np.asarray(x, np.int64).view(np.uint64) for x in pdf["w"]]
            at = np.r_[0, np.cumsum([len(x) for x in ws])].astype(np.int64)
            h, place = winnowed(np.concatenate(ws) if ws else np.zeros(0, np.uint64), at)
            out = pd.DataFrame({key: pdf[key].to_numpy()[np.searchsorted(at, place, side="right") - 1], "h": h.view(np.int64)})
            yield out.drop_duplicates()

    return df.select(key, "w").mapInPandas(run, f"{key} bigint, h bigint")


def originals(items: DataFrame) -> DataFrame:
    """The texts of (item_id, w), equal ones and near copies once: each fingerprint stands for the first text that has
    it, and a text that shares NEAR of its fingerprints with one such text is its copy. A fingerprint makes one link a
    text, never a pair of texts."""
    once = items.groupBy("w").agg(F.min("item_id").alias("item_id"))
    prints = cut(fingerprints(once, "item_id"))
    first = prints.groupBy("h").agg(F.min("item_id").alias("first"))
    size = prints.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    shared = prints.join(first, "h").where("first < item_id").groupBy("item_id", "first").agg(F.count(F.lit(1)).alias("n"))
    copies = shared.join(size, "item_id").where(F.col("n") >= NEAR * F.col("size")).select("item_id").distinct()
    return once.join(copies, "item_id", "left_anti")


def form_pairs(items: DataFrame) -> np.ndarray:
    """Hashes of the word pairs of common form of (item_id, w). A pair counts once a text and its copies, so there are at most
    pairs-a-text / FORM_SHARE of them."""
    items = cut(originals(items))
    n = items.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = [np.unique(grams(np.asarray(x, np.int64).view(np.uint64), 2)) for x in pdf["w"]]
            yield pd.DataFrame({"p": (np.concatenate(each) if each else np.zeros(0, np.uint64)).view(np.int64)})

    pairs = items.select("w").mapInPandas(run, "p bigint")
    common = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(FORM_LEAST, FORM_SHARE * n))
    return np.array([r["p"] for r in common.toLocalIterator()], dtype=np.int64).view(np.uint64)


_FOUND = "doc_id bigint, item_id bigint, n_words int"


def _streamed(docs: DataFrame, items: DataFrame, form: np.ndarray) -> DataFrame:
    """Leaks of few test texts: the corpus passes by their broadcast index."""
    rows = items.select("item_id", "w").toPandas()  # of checked size
    sent = docs.sparkSession.sparkContext.broadcast(_index(rows["item_id"].tolist(), [np.asarray(x, np.int64) for x in rows["w"]], form))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = sent.value
        for pdf in batches:
            ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
            for k, end in slices(texts):
                found = index.leaks(texts[k:end])
                yield pd.DataFrame([(ids[k + d], index.ids[i], n) for d, i, n in found], columns=["doc_id", "item_id", "n_words"])

    return docs.mapInPandas(run, _FOUND)


def _shuffled(docs: DataFrame, items: DataFrame, form: np.ndarray) -> DataFrame:
    """Leaks of many test texts: fingerprints meet in a shuffle join, each pair is given both texts by a sort-merge join."""
    d = tokenised(docs, "doc_id").where(F.size("w") >= MATCHED)
    pairs = fingerprints(d, "doc_id").hint("merge").join(fingerprints(items, "item_id"), "h").select("doc_id", "item_id").distinct()
    both = d.hint("merge").join(pairs, "doc_id").join(items.select("item_id", F.col("w").alias("iw")).hint("merge"), "item_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, item, w, iw in zip(pdf["doc_id"], pdf["item_id"], pdf["w"], pdf["iw"], strict=True):
                index = _index([item], [np.asarray(iw, np.int64)], form)
                p, k = index._find(grams(np.asarray(w, np.int64).view(np.uint64), 2), index.seen_pairs, index.pairs)
                n = longest_passage(*index.item(0), list(zip(p.tolist(), k.tolist(), strict=True)))
                if n:
                    rows.append((doc, item, n))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words"])

    return both.mapInPandas(run, _FOUND)


def leaks(docs: DataFrame, items: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words) of documents (doc_id, text) that hold a passage of items (item_id, text)."""
    long_rows(docs.sparkSession)
    d = spread(docs.select("doc_id", "text").where(F.col("text").isNotNull()))
    t = cut(tokenised(items, "item_id").where(F.size("w") >= WORDS))
    size = t.agg(F.sum(F.size("w"))).first()[0] or 0
    form = form_pairs(t)
    return (_streamed if size <= broadcast_words else _shuffled)(d, t, form)
