import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasmill.llm import language_id as L
from atlasmill.llm.registry import op11_language_id

from llm_rows import TEXTS

EN, FR = "the house is near the river and the old bridge was built with stone", "la maison est près de la rivière et le vieux pont fut bâti en pierre"
EL, RU = "το σπίτι είναι κοντά στο ποτάμι και η παλιά γέφυρα", "дом стоит у реки и старый мост построен из камня"


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(3)
    rows = [(lang, " ".join(rng.choices(text.split(), k=30))) for lang, text in (("en", EN), ("fr", FR), ("el", EL), ("ru", RU)) for _ in range(40)]
    return L.train(spark.createDataFrame([(t, k) for k, t in rows], "text string, lang string"))


def brute_viterbi(scores, penalty):
    """The best total over all label sequences, by trying each next label."""
    best = [(s, [k]) for k, s in enumerate(scores[0])]
    for row in scores[1:]:
        best = [max(((v + row[k] - penalty * (p[-1] != k), [*p, k]) for v, p in best), key=lambda x: x[0]) for k in range(len(row))]
    return max(best, key=lambda x: x[0])


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(5)
    counts = np.array([0, 1, 7, 3, 12, 0, 5])
    scores, word = np.log(rng.dirichlet(np.ones(3), 40)), rng.integers(0, 40, counts.sum())
    got = L.viterbi(scores, word, counts, 1.5)
    at = 0
    for n in counts:
        w, label = word[at : at + n], got[at : at + n]
        at += n
        if n:
            total = scores[w, label].sum() - 1.5 * (np.diff(label) != 0).sum()
            assert np.isclose(total, brute_viterbi(scores[w], 1.5)[0])


def test_every_script_has_its_candidates(model):
    assert model.languages == ["el", "en", "fr", "ru"]
    s = model.scores(["ποτάμι", "мост", "bridge", "rivière", "שלום"])
    assert [model.languages[k] for k in s.argmax(1)][:4] == ["el", "ru", "en", "fr"]
    assert (s[0] > L.FLOOR).sum() == 1 and (s[4] > L.FLOOR).all()  # a script that nobody uses leaves all


def test_spans_of_mixed_texts(spark, model):
    text = f"{EN}. {FR}! {RU} 123"
    got = L.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model=model, with_spans=True).first()
    spans = [(int(a), int(b), k) for a, b, k in (x.split(":") for x in got.spans.split(","))]
    assert [k for *_, k in spans] == ["en", "fr", "ru"] and got.n_spans == 3
    assert [text[a:b] for a, b, _ in spans] == [EN, FR, RU]
    letters = {k: sum(c.isalpha() for c in text[a:b]) for a, b, k in spans}
    assert got.lang_pred == max(letters, key=letters.get) and np.isclose(got.score, max(letters.values()) / sum(letters.values()))


def test_odd_rows(odd, none, model):
    got = L.identify(odd, model=model).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((d is None, d) for d, *_ in TEXTS)
    by = {r.doc_id: r for r in got}
    assert all((by[k].lang_pred, by[k].score, by[k].n_spans) == ("und", 0.0, 0) for k in (3, 4, 5))
    assert all(0 <= r.score <= 1 for r in got) and by[7].lang_pred in model.languages
    assert L.identify(none, model=model).collect() == [] and L.identify(none).collect() == []


def test_without_labels_all_is_unknown(spark):
    docs = spark.createDataFrame([(1, EN, None)], "doc_id long, text string, lang string")
    assert L.identify(docs).first().lang_pred == "und"


def test_held_out_accuracy_and_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = op11_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.97 * len(out)
    assert spark.range(1).select(L.fold(F.lit(None))).first()[0] == 0
