import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codestrata.llm import langid

WORDS = {"aa": "ka lo mi tuna sereko palu".split(), "bb": "der und schön straße größe ich".split(), "cc": "où été ça mère garçon les".split()}


def text(lang, seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang], n))


def corpus(spark, n=40):
    rows = [(i, text(lang, i), lang, "s") for i, lang in enumerate(list(WORDS) * n)]
    return spark.createDataFrame(rows + [(9000, None, "aa", None), (9001, "", "bb", None), (9002, "123 ... \n", None, None), (9003, rows[0][1], None, None), (9004, "ka lo " * 20000, "aa", "x")], "doc_id long, text string, lang string, score string")


def test_gram_sets_equal_brute_force(monkeypatch):
    reader, t = langid.Grams(), "Ab, ß日 x\U00020000y--z"
    c = [0, *reader.codes(t).tolist(), 0]
    want = set(c) | {64 + c[i] * 64 + c[i + 1] for i in range(len(c) - 1)} | {64 + 4096 + (c[i] * 64 + c[i + 1]) * 64 + c[i + 2] for i in range(len(c) - 2)}
    assert set(reader.ids(t).tolist()) == want
    assert not reader.flag.any()
    long = "".join(chr(97 + i * i % 23) for i in range(500))
    whole = set(reader.ids(long).tolist())
    monkeypatch.setattr(langid, "PIECE", 64)
    assert whole <= set(reader.ids(long).tolist())


def test_held_out_accuracy_and_odd_rows(spark):
    df = corpus(spark)
    model = langid.train(df.filter(F.col("doc_id") % 5 != 0))
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    held = [r for i, r in got.items() if i % 5 == 0 and i < 9000]
    assert np.mean([r["lang_id"]["lang_pred"] == r["lang"] for r in held]) >= 0.98
    assert all(got[i]["lang_id"] == (langid.UNKNOWN, 0.0) for i in (9000, 9001, 9002))
    assert got[9003]["lang_id"] == got[0]["lang_id"] and got[9004]["lang_id"]["lang_pred"] == "aa"
    assert all(0 <= r["lang_id"]["score"] <= 1 for r in got.values()) and got[0]["score"] == "s"


def test_prediction_is_a_batch_of_kernel_products():
    reader = langid.Grams()
    sets = [(lang, reader.ids(text(lang, s))) for lang in WORDS for s in range(9)]
    model = langid.LanguageModel.fit(sets, landmarks=3)
    t = text("bb", 77)
    mine = reader.ids(t)
    marks = [x for lang in sorted(WORDS) for x in [s for name, s in sets if name == lang][:3]]
    k = np.array([len(np.intersect1d(mine, m)) / np.sqrt(len(mine) * len(m)) for m in marks])
    value = k @ model.weights[:-1] + model.weights[-1]
    names, scores = model.predict(pa.array([t]))
    assert names[0] == model.languages[value.argmax()]
    assert np.isclose(scores[0], (np.exp(4 * value) / np.exp(4 * value).sum()).max())


def test_no_labels(spark):
    df = corpus(spark, 1)
    model = langid.train(df.filter("lang is null"))
    assert {r["lang_id"]["lang_pred"] for r in langid.identify(df, model).collect()} == {langid.UNKNOWN}
    assert langid.identify(df.limit(0), model).count() == 0
