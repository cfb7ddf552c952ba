import random
import time

import numpy as np

from dugout.llm import leakage as L

RNG = random.Random(4)
VOCAB = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("lon", "mer", "tis", "vud", "zar")]
ITEM = RNG.sample(VOCAB, 60)


def doc(middle, n=80):
    other = [w + "q" for w in VOCAB]
    return RNG.sample(other, n // 2) + middle + RNG.sample(other, n // 2)


def changed(ws, every):
    return [w + "x" if i % every == every - 1 else w for i, w in enumerate(ws)]


def test_passage_rules():
    assert L.shared_passage(ITEM, doc(ITEM[10:22])) >= 12
    assert L.shared_passage(ITEM, doc(ITEM[10:20])) == 0  # ten words
    assert L.shared_passage(ITEM, doc(changed(ITEM[5:35], 6))) >= 20
    assert L.shared_passage(ITEM, doc(ITEM[5:13] + ["other"] * 30 + ITEM[13:21])) >= 12
    assert L.shared_passage(ITEM, doc(ITEM[13:21] + ["other"] * 30 + ITEM[5:13])) == 0  # halves in the wrong order
    assert L.shared_passage(ITEM, doc(RNG.sample(ITEM, 60))) == 0
    assert L.shared_passage([], []) == 0


def brute_runs(a, b, n):
    return any(a[i:i + n] == b[j:j + n] for i in range(len(a) - n + 1) for j in range(len(b) - n + 1))


def index_of(texts, form=()):
    w, at = L.hashed(texts)
    return L.Index(np.arange(len(texts)), w, at, np.array(form, dtype=np.uint64))


def test_every_shared_run_has_a_fingerprint():
    item = " ".join(ITEM)
    prints = set(index_of([item]).prints.tolist())
    for _ in range(200):
        text = doc(ITEM[RNG.randrange(50):][: RNG.randrange(0, 9)], RNG.choice([2, 4, 30]))
        w, at = L.hashed([" ".join(text), ""])
        met = bool(prints & set(L.winnowed(w, at)[0].tolist()))
        if brute_runs(text, ITEM, L.K + L.WINDOW - 1):
            assert met
        if not brute_runs(text, ITEM, L.K):
            assert not met


def test_a_passage_with_one_word_in_six_changed_has_a_fingerprint():
    prints = set(index_of([" ".join(ITEM)]).prints.tolist())
    for a in range(L.WORDS):
        for b in range(a, L.WORDS):  # every way to change two of twelve words
            part = ITEM[20:20 + L.WORDS]
            part[a], part[b] = "changed", "altered"
            w, at = L.hashed(["x y " + " ".join(part) + " z"])
            assert prints & set(L.winnowed(w, at)[0].tolist())


def test_texts_of_a_batch_are_told_apart():
    texts = [" ".join(doc(ITEM[10:30])), "", " ".join(ITEM[:2]), " ".join(doc([])), " ".join(ITEM)]
    got = {(d, i) for d, i, _ in index_of([" ".join(ITEM), " ".join(doc([]))]).leaks(texts)}
    assert got == {(0, 0), (4, 0)}
    assert index_of([]).leaks(texts) == [] and index_of(texts).leaks([]) == []


def test_words():
    assert L.words("Don\u2019t <b>STOP</b> the in-\nning &amp; caf\u00e9 cafe\u0301 \u65e5\u672c 12-3") == [
        "don", "t", "stop", "the", "inning", "caf\u00e9", "caf\u00e9", "\u65e5", "\u672c", "12", "3"]
    long = "ab cd " * 500_000
    assert len(L.words(long)) == 1_000_000 and L.words("") == []


def test_a_long_document_of_repeated_runs_is_quick():
    text = " ".join(ITEM[:6] + ["other"] * 3 + ITEM[20:24] + ["more"]) + " "
    began = time.time()
    assert index_of([" ".join(ITEM)]).leaks([text * 20_000]) == []
    assert time.time() - began < 20


def test_the_corpus_is_neither_shuffled_nor_broadcast(spark):
    d = spark.createDataFrame([(1, " ".join(doc(ITEM)))], "doc_id long, text string").repartition(4)
    t = spark.createDataFrame([(9, " ".join(ITEM))], "item_id long, text string")
    # one exchange is the repartition above; nothing is joined
    plan = L.leaks(d, t)._jdf.queryExecution().toString()
    assert "Join" not in plan
    big = L.leaks(d, t, 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in big and "BroadcastExchange" not in big


def test_leaks(spark):
    text = " ".join(ITEM)
    layout = "<p>" + text.upper().replace(" ", ",\n**").replace(ITEM[3].upper(), ITEM[3][:3].upper() + "-\n" + ITEM[3][3:].upper()) + "</p>"
    docs = [(1, "x y z " + text + " w"), (2, layout), (3, None), (4, ""), (5, " ".join(ITEM[:10])), (6, "word " * 200_000 + text), (7, "x y z " + text + " w")]
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    t = spark.createDataFrame([(9, text), (10, None), (11, "short one")], "item_id long, text string")
    for limit in (L.BROADCAST_WORDS, 0):  # broadcast test texts, and by shuffle
        assert sorted((r["doc_id"], r["item_id"]) for r in L.leaks(d, t, limit).collect()) == [(1, 9), (2, 9), (6, 9), (7, 9)]
    assert L.leaks(d.limit(0), t).count() == 0 and L.leaks(d, t.limit(0)).count() == 0


def test_copies_of_an_item_are_no_common_form(spark):
    text, near = " ".join(ITEM), [" ".join(w + "y" * k if i % 9 == k else w for i, w in enumerate(ITEM)) for k in range(1, 5)]
    other = [" ".join(RNG.sample([w + "z" for w in VOCAB], 40)) for _ in range(10)]
    part = " ".join(doc(ITEM[10:26]))
    for texts in ([text] * 5, [text, *near]):
        items = spark.createDataFrame(list(enumerate(texts + other)), "item_id long, text string")
        docs = spark.createDataFrame([(1, "x y z " + text + " w"), (2, part), (3, " ".join(doc([])))], "doc_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in L.leaks(docs, items).collect()}
        assert {(1, i) for i in range(5)} <= got and (2, 0) in got and not any(d == 3 for d, _ in got)


def test_long_stretch_counts_whatever_its_pairs():
    form = set(zip(ITEM, ITEM[1:]))
    assert L.shared_passage(ITEM, doc(ITEM[5:45]), form) == 40
    assert L.shared_passage(ITEM[:15], doc(ITEM[:15]), form) == 15  # the whole text
    assert L.shared_passage(ITEM, doc(ITEM[5:25]), form) == 0
