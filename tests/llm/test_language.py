import random

import numpy as np
import pytest

from dugout.llm import language as L

TEXTS = {
    "en": ["the coach of the home team pulled the starter after five innings and nobody was surprised", "late in the game the visitors scored twice before the crowd went home",
           "with the bases loaded he struck out on three pitches and walked back slowly"],
    "es": ["el entrenador del equipo local sacó al abridor después de cinco entradas y nadie se sorprendió", "al final del partido los visitantes anotaron dos veces antes de que se fuera el público",
           "con las bases llenas se ponchó con tres lanzamientos y regresó despacio"],
    "de": ["der trainer der heimmannschaft nahm den werfer nach fünf durchgängen vom feld und niemand war überrascht", "spät im spiel erzielten die gäste zwei punkte bevor das publikum nach hause ging",
           "mit geladenen bases schlug er dreimal daneben und ging langsam zurück"],
    "ja": ["監督は五回で先発投手を交代させたが、誰も驚かなかったという", "試合の終盤にビジターが二点を取り、観客は静かになった", "満塁の場面で彼は三振に倒れ、ゆっくりと戻っていった"],
}


@pytest.fixture(scope="module")
def model():
    rng, texts, labels = random.Random(0), [], []
    for lang, ss in TEXTS.items():
        for _ in range(60):
            s = rng.choice(ss)
            if lang != "ja":
                ws = s.split()
                k = rng.randrange(0, len(ws) - 6)
                s = " ".join(ws[k:k + rng.randrange(6, 12)])
            texts.append(s)
            labels.append(lang if rng.random() > 0.05 else "en")  # some labels are wrong
    return L.fit(texts, labels)


def test_codewords_are_apart():
    m = L.codewords(7)
    assert min((m[i] != m[j]).sum() for i in range(7) for j in range(i)) >= 6
    assert (L.codewords(7) == m).all()


def test_gram_sums_against_one_by_one():
    w = np.random.default_rng(0).normal(size=(L.BUCKETS, 3))
    texts = ["abc def", "", "日本語です", "x" * (2 * L.SLICE + 17), "abc def"]
    s, n = L.gram_sums(texts, w)
    for i, t in enumerate(texts[:3]):
        one, k = L.gram_sums([t], w)
        assert np.allclose(s[i], one[0]) and n[i] == k[0]
    assert np.allclose(s[0], s[4]) and n[3] > 2 * L.SLICE


def test_decoding(model):
    flat = [(lang, s) for lang, ss in TEXTS.items() for s in ss]
    got, conf = model.decode([s for _, s in flat])
    assert [model.languages[i] for i in got] == [x for x, _ in flat] and conf.min() > 0.5


def test_segments(model):
    en, es, de = (". ".join(x.capitalize() for x in TEXTS[k]) + "." for k in ("en", "es", "de"))
    out = L.segments([en, f"{en}\n{es} {de}", f"{en} ¡Vamos! {en}", "SOU 0 2 0 2 - 11 1 1", "", f"{en}\nSOU 0 1 0 0 - 1 2 0\n{es}", "Hola amigos."], model)
    langs = [[x[0] for x in s] for s in out]
    assert langs[:6] == [["en"], ["en", "es", "de"], ["en"], [], [], ["en", "es"]]
    assert len(langs[6]) == 1


@pytest.mark.parametrize("label, want", [("EN", "en"), ("en-US", "en"), ("pt_BR", "pt"), ("Español", "es"), (" ", None), ("und", None), ("unknown", None), (None, None), ("nl", "nl"), ("日本語", "ja")])
def test_labels(label, want):
    assert L.canonical_label(label) == want


def test_documents(spark):
    en, es = (". ".join(x.capitalize() for x in TEXTS[k]) + "." for k in ("en", "es"))
    rows = [(i, lang, t) for i, (lang, t) in enumerate([("en", en), ("EN", en), ("es", es)] * 20)]
    rows += [(100, None, en), (101, "es", en), (102, "en", en + "\n" + es), (103, "en", None), (104, "en", ""), (105, "und", es), (106, "en", en * 300)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, lang string, text string, language string")
    got = sorted((r["doc_id"], r["segment_no"], r["language"]) for r in L.mislabelled(L.label_documents(d, L.train(d))).collect())
    assert got == [(100, 0, "en"), (101, 0, "en"), (102, 0, "en"), (102, 1, "es"), (105, 0, "es")]
    assert L.train(d.limit(0)) is None and L.label_documents(d, None).count() == 0
