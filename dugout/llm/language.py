"""Missing or wrong document language labels: error-correcting output codes over character n-grams.

Each language has a codeword; one binary linear classifier on hashed character n-grams predicts each
bit. A piece of text gets the language whose codeword loses least against the predicted margins
(logistic loss), with a softmax of the losses as confidence; a confidence under ``AMBIGUOUS`` marks
ambiguity. Documents are cut into sentences, sentences are decoded one by one, pieces too short or
ambiguous to tell take their neighbours' language, and runs of one language are the segments.

The classifiers are fitted on the corpus's own labels, on a bounded sample of labelled documents
(``TRAIN_DOCS`` a language, chosen by hash); sentences whose label a first, counted fit contradicts are left out
of the second, as labels may be wrong. Everything else covers all documents.

Defined results: null and blank texts, and texts without a word (score lines only), have no
segments; repeated documents are judged each; an absent or unknown label names no language; a
text shorter than a sentence is one segment; a corpus without labelled documents gives no model and no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dugout.session import long_rows, slices, spread

LANGUAGES = ["en", "es", "fr", "de", "pt", "it", "ja"]

#: Ways to write a language's label, lower case, region and script cut off.
LABELS = {
    "en": "en eng english inglés anglais englisch", "es": "es spa spanish español espanol castellano castilian esp",
    "fr": "fr fra fre french français francais", "de": "de deu ger german deutsch", "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano", "ja": "ja jpn japanese 日本語 jp nihongo", "nl": "nl nld dut dutch nederlands",
    "zh": "zh zho chi chinese 中文", "ko": "ko kor korean 한국어", "ru": "ru rus russian русский", "ca": "ca cat catalan català",
    "sv": "sv swe swedish svenska", "pl": "pl pol polish polski", "da": "da dan danish", "no": "no nor nb nn norwegian", "fi": "fi fin finnish",
}
_LABEL = {v: k for k, vs in LABELS.items() for v in vs.split()}

#: Labelled documents a language in the training sample, and characters of a document that may be in it.
TRAIN_DOCS, TRAIN_CHARS = 100, 20_000
#: Bits of the codewords, hash buckets (a power of two), n-gram orders, rounds of gradient descent.
CODE_BITS, BUCKETS, ORDERS, ROUNDS = 15, 1 << 16, (1, 2, 3, 4), 30
#: Words below which a piece is no segment; confidence below which a piece is ambiguous, and below which a single piece
#: beside or among sentences of one other language is (names and cut-off sentences reach 0.8).
LEAST_WORDS, AMBIGUOUS, AMBIGUOUS_WITHIN = 5, 0.75, 0.85
SLICE = 200_000

_PIECE = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|(?<=[。！？])|[\r\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_SCORE = re.compile(r"^\W*[A-Z]{2,5}(\s+[\d\-xX]+)+\W*$")


def canonical_label(label: str | None) -> str | None:
    """The language that a label names, or None."""
    if label is None:
        return None
    s = label.strip().lower()
    return _LABEL.get(s) or _LABEL.get(re.split(r"[-_\s(]", s)[0]) if s else None


def codewords(n: int, bits: int = CODE_BITS, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: of many random balanced codes the one with the largest least distance."""
    rng = np.random.default_rng(seed)
    best, least = None, (-1, -1.0)
    for _ in range(400):
        m = np.ones((n, bits), dtype=np.int8)
        for b in range(bits):
            m[rng.permutation(n)[: n // 2 if rng.random() < 0.5 else n - n // 2], b] = -1
        d = np.array([(m[i] != m[j]).sum() for i in range(n) for j in range(i)])
        score = (int(d.min()), float(d.mean()))
        if score > least:
            best, least = m, score
    return best


def pieces(text: str) -> list[str]:
    """Sentences of a text in order."""
    return [p for p in (x.strip() for x in _PIECE.split(text) if x) if p]


def n_words(piece: str) -> int:
    """Words that tell a language; two Chinese or Japanese characters count as one, a score line has none."""
    if _SCORE.match(piece):
        return 0
    cjk = 0 if piece.isascii() else len(_CJK.findall(piece))
    return cjk // 2 + 1 if cjk else len(_WORD.findall(piece))


def gram_sums(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of ``weights`` rows over the hashed n-grams of each text, and the number of n-grams; vectorised over slices."""
    out = np.zeros((len(texts), weights.shape[1]), dtype=np.float64)
    count = np.zeros(len(texts), dtype=np.int64)
    for first, codes, owner in _coded(texts):
        for h, own in _grams(codes, owner):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[first + own[starts]] += np.add.reduceat(np.take(weights, h, axis=0), starts, axis=0)
            count[first + own[starts]] += np.diff(np.r_[starts, len(own)])
    return out, count


def _coded(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, code points, owner) in slices; a text longer than a slice spreads over several."""
    pad = "\x00" * (max(ORDERS) - 1)
    buf: list[str] = []
    owners: list[int] = []
    first, size = 0, 0

    def pack():
        s = "".join(buf)
        codes = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)
        return first, codes, np.repeat(np.array(owners, dtype=np.int64) - first, [len(b) for b in buf])

    for i, t in enumerate(texts):
        t = " " + re.sub(r"\d+", "0", t.lower()) + " "
        for k in range(0, len(t), SLICE):
            part = t[k:k + SLICE]
            if size and size + len(part) > SLICE:
                yield pack()
                buf, owners, size, first = [], [], 0, i
            if not buf:
                first = i
            buf.append(part + pad)
            owners.append(i)
            size += len(part)
    if buf:
        yield pack()


def _grams(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, owner) of the n-grams that begin in a text, an order at a time; each order's hashes go on from those of the one before."""
    c = codes.astype(np.uint64)
    inside = c != 0
    h, whole = np.zeros(len(c), dtype=np.uint64), np.ones(len(c), dtype=bool)
    for n in range(1, min(max(ORDERS), len(c)) + 1):
        m = len(c) - n + 1
        h = (h[:m] ^ c[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        whole = whole[:m] & inside[n - 1:]
        if n in ORDERS:
            own = owner[:m][whole]
            if len(own):
                yield ((h[whole] >> np.uint64(5)) + np.uint64(n * 0x9E3779B1) & np.uint64(BUCKETS - 1)).astype(np.int64), own


class Model:
    """Weights of one linear classifier a bit, and the codewords."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, code: np.ndarray, languages: list[str]):
        self.weights, self.bias, self.code, self.languages = weights, bias, code, languages

    def decode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(language index, confidence) of each text."""
        if not texts:
            return np.zeros(0, dtype=int), np.zeros(0)
        s, n = gram_sums(texts, self.weights)
        margin = s / np.maximum(n, 1)[:, None] + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :]).sum(axis=2)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def fit(texts: list[str], labels: list[str], rounds: int = ROUNDS) -> Model | None:
    """One logistic classifier a bit by full-batch gradient descent on mean n-gram counts, without the texts that a first fit
    reads as another language. The first one takes each bit's weights from counts alone (log odds of the n-grams of either side), so it costs one pass."""
    languages = [x for x in LANGUAGES if x in set(labels)]
    if not languages:
        return None
    code = codewords(len(languages)) if len(languages) > 1 else np.ones((1, CODE_BITS), dtype=np.int8)
    y = np.array([languages.index(x) for x in labels])
    hs, os_ = [], []
    for first, c, o in _coded(texts):
        for h, own in _grams(c, o):
            hs.append(h)
            os_.append(own + first)
    h, own = np.concatenate(hs), np.concatenate(os_)
    flat, cnt = np.unique(own * BUCKETS + h, return_counts=True)
    own, h = flat // BUCKETS, flat % BUCKETS
    x = (cnt / np.maximum(np.bincount(own, cnt, minlength=len(texts)), 1)[own]).astype(np.float32)
    target = code[y].astype(np.float32)
    # first fit: what share of its n-grams each language has in a bucket
    share = np.bincount(y[own] * BUCKETS + h, x, minlength=len(languages) * BUCKETS).reshape(len(languages), BUCKETS)
    share = (share + 1e-6) / (share.sum(axis=1, keepdims=True) + 1e-6 * BUCKETS)
    plus = (code == 1).T.astype(float)
    odds = np.log((plus / np.maximum(plus.sum(axis=1, keepdims=True), 1)) @ share + 1e-12) - np.log(((1 - plus) / np.maximum((1 - plus).sum(axis=1, keepdims=True), 1)) @ share + 1e-12)
    counted = np.zeros((len(texts), CODE_BITS), dtype=np.float32)
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    counted[own[starts]] = np.add.reduceat(x[:, None] * np.take(odds.T.astype(np.float32), h, axis=0), starts, axis=0)
    keep = np.logaddexp(0, -counted[:, None, :] * code[None, :, :]).sum(axis=2).argmin(axis=1) == y
    if not keep.any():
        keep[:] = True
    use = keep[own]
    h, own, x = h[use], own[use], x[use]
    # classes of unlike size weigh alike
    size = np.bincount(y[keep], minlength=len(languages))
    wt = np.where(keep, 1.0 / np.maximum(size, 1)[y], 0.0).astype(np.float32)[:, None]
    scale = (np.sqrt(np.bincount(h, x * x * wt[own, 0], minlength=BUCKETS)) + 1e-6).astype(np.float32)[:, None]
    # entries come by text; ordered by bucket once, both sums are sums over runs, for all bits together
    text_at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    by_bucket = np.argsort(h, kind="stable")
    hb, ob, xb = h[by_bucket], own[by_bucket], x[by_bucket, None]
    bucket_at = np.flatnonzero(np.r_[True, hb[1:] != hb[:-1]])
    x = x[:, None]
    w, w0 = np.zeros((BUCKETS, CODE_BITS), dtype=np.float32), np.zeros(CODE_BITS, dtype=np.float32)
    for _ in range(rounds):
        m = np.zeros((len(texts), CODE_BITS), dtype=np.float32)
        m[own[text_at]] = np.add.reduceat(x * np.take(w, h, axis=0), text_at, axis=0)
        g = -target * wt / (1 + np.exp(np.clip(target * (m + w0), -30, 30)))
        w[hb[bucket_at]] -= 0.9 * np.add.reduceat(xb * np.take(g, ob, axis=0), bucket_at, axis=0) / scale[hb[bucket_at]]
        w0 -= 0.05 * g.sum(axis=0)
    return Model(w, w0.astype(np.float64), code, languages)


def train(docs: DataFrame, per_language: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Model | None:
    """A model from a bounded sample of labelled documents (doc_id, lang, text): about ``per_language`` documents a
    language, chosen by hash, each of at most ``max_chars`` characters."""
    names = F.create_map(*[F.lit(x) for kv in sorted(_LABEL.items()) for x in kv])
    low = F.lower(F.trim("lang"))
    d = docs.withColumn("l", F.coalesce(names[low], names[F.split(low, r"[-_\s(]")[0]])).where(
        F.col("l").isin(LANGUAGES) & F.col("text").isNotNull() & F.length("text").between(40, max_chars))
    share = d.groupBy("l").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")))
    u = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    rows = d.join(F.broadcast(share), "l").where(u < F.col("p")).select("doc_id", "l", "text").limit(2 * per_language * len(LANGUAGES)).collect()
    texts, labels = [], []
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"])):
        for p in pieces(r["text"]):
            if n_words(p) >= LEAST_WORDS:
                texts.append(p)
                labels.append(r["l"])
    return fit(texts, labels) if texts else None


def segments(texts: list[str], model: Model) -> list[list[tuple[str, float, str]]]:
    """(language, confidence, text) of each text's segments."""
    cut_up = [pieces(t) for t in texts]
    long = [[n_words(p) >= LEAST_WORDS for p in ps] for ps in cut_up]
    for k, (ps, ok) in enumerate(zip(cut_up, long, strict=True)):
        if ps and not any(ok) and any(n_words(p) for p in ps):  # shorter than a sentence: the whole is one piece
            cut_up[k], long[k] = [" ".join(p for p in ps if n_words(p))], [True]
    flat = [p for ps, ok in zip(cut_up, long, strict=True) for p, o in zip(ps, ok, strict=True) if o]
    lang, conf = model.decode(flat)
    out, at = [], 0
    for ps, ok in zip(cut_up, long, strict=True):
        tags: list[tuple[int, float] | None] = []
        for o in ok:
            if o:
                # an ambiguous piece is told by its neighbours, if it has any that are not
                tags.append((int(lang[at]), float(conf[at])) if conf[at] >= AMBIGUOUS else (-1 - int(lang[at]), float(conf[at])))
                at += 1
            else:
                tags.append(None)
        if not any(t for t in tags):
            out.append([])
            continue
        sure = [k for k, t in enumerate(tags) if t and t[0] >= 0]
        told_by = [None, *sure, None]
        for a, k, b in zip(told_by, sure, told_by[2:], strict=False):
            near = {tags[x][0] for x in (a, b) if x is not None}
            if len(near) == 1 and tags[k][0] not in near and tags[k][1] < AMBIGUOUS_WITHIN and len(sure) > 2:
                tags[k] = (-1 - tags[k][0], tags[k][1])
        if not sure:
            tags = [(-1 - t[0], t[1]) if t else None for t in tags]
        told: list[list] = []
        head = ""
        for p, t in zip(ps, tags, strict=True):
            if t is None or t[0] < 0:
                if told:
                    told[-1][3] += "\n" + p
                else:
                    head += p + "\n"
            elif told and told[-1][0] == t[0]:
                told[-1][1] += t[1]
                told[-1][2] += 1
                told[-1][3] += "\n" + p
            else:
                told.append([t[0], t[1], 1, head + p])
                head = ""
        out.append([(model.languages[a], c / n, s) for a, c, n, s in told])
    return out


def label_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, label, segment_no, language, confidence, ambiguous, n_chars) of every segment of documents (doc_id, lang, text)."""
    schema = "doc_id bigint, label string, segment_no int, n_segments int, language string, confidence double, ambiguous boolean, n_chars int"
    spark = docs.sparkSession
    if model is None:
        return spark.createDataFrame([], schema)
    long_rows(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS x CODE_BITS numbers, whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in batches:
            for k, end in slices(list(pdf["text"])):
                part = pdf.iloc[k:end]
                rows = []
                for doc, label, segs in zip(part["doc_id"], part["lang"], segments(list(part["text"]), m), strict=True):
                    name = canonical_label(label if isinstance(label, str) else None)
                    rows += [(doc, name, i, len(segs), lang, c, c < AMBIGUOUS, len(s)) for i, (lang, c, s) in enumerate(segs)]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return spread(docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull())).mapInPandas(run, schema)


def mislabelled(labelled: DataFrame) -> DataFrame:
    """The segments of documents whose label is absent or not the text's one language."""
    return labelled.where((F.col("n_segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("language")))
