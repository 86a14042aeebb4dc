"""Folding, matching against brute force, learning, and the registered query on planted labels."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codestrata.llm import toxicity as X

LEXICON = X.Lexicon.of({"idiot": 3.0, "scum": 2.0, "lowei*": 2.5, "trash": 1.0}, ["trash can", "idiot proof"], (-3.0, 3.0))


@pytest.mark.parametrize("text", ["idiot", "IDIOT!", "1d10t", "!diot", "іdіоt", "ｉｄｉｏｔ", "ïdïöt", "i.d.i.o.t", "i d i o t", "id​iot", "idiooooot", "|diot", "an idiot$$$"])
def test_disguises(text):
    assert X.judged([text], LEXICON)[0][3] == ["idiot"]


@pytest.mark.parametrize("text", [None, "", "   ", "1234 5678", "idiotic", "videotape", "!!! $$$", "a trash can", "Idiot-proof it is"])
def test_harmless(text):
    score, weight, _, terms = X.judged([text], LEXICON)[0]
    assert weight == 0 and terms == [] and score == pytest.approx(1 / (1 + np.exp(3)))


def brute_hits(words, lexicon):
    out = []
    covered = set()
    for e in lexicon.exceptions:
        p = e.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                covered |= set(range(i, i + len(p)))
    for i, w in enumerate(words):
        out += [t for t in lexicon.weights if i not in covered and (w == t or t.endswith("*") and w.startswith(t[:-1]))]
    return sorted(out)


def test_matching_equals_brute_force():
    r = random.Random(4)
    vocabulary = ["idiot", "scum", "trash", "can", "proof", "loweiig", "lowei", "of", "the", "trashcan", "idiots"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["trash can " * 5000 + "scum"]
    for text, (score, weight, n, terms) in zip(texts, X.judged(texts, LEXICON)):
        words = X.folded(text)
        want = brute_hits(words, LEXICON)
        assert sorted(terms) == want and n == len(words)
        assert weight == pytest.approx(sum(LEXICON.weights[t] for t in want))
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(-3 + 3 * np.log1p(100 * weight / (n + 20)), -40, 40))))


def corpus(seed=0):
    """Toxic texts in two languages, harmless ones with an exception phrase, copies of both, labels of some."""
    r = random.Random(seed)
    syllables = "an en ti on re st ou la de mi".split()
    vocabulary = sorted({"".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(400)})
    docs, labels = [], []
    for i in range(1500):
        words = [r.choice(vocabulary) for _ in range(r.randint(5, 150))]
        toxic = i % 9 == 0
        for _ in range(1 + len(words) // 40 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["Idiot", "scуm".replace("у", "u"), "1diot", "drokel" + r.choice(syllables), "trash"]))
        if not toxic and i % 4 == 0:
            words.insert(3, "trash can")
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(toxic)))
    docs += [(2000 + i, docs[18][1] + (" copy" if i % 2 else ""), "x") for i in range(300)]  # copies of a toxic text
    labels += [(2000 + i, 1, 1) for i in range(150)]
    docs += [(5000, None, "x"), (5001, "", "x"), (5002, "1 2 3", None), (None, "an idiot", "x"), (7, docs[7][1], "x"), (5003, "onti " * 30000 + "idiot " * 900, "x")]
    labels += [(5001, 0, None), (None, 0, 1), (9999, 0, 1), (9, 0, 1)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tox"))
    docs, labels = corpus()
    spark.createDataFrame([(*x, "s", 1, 1, 0.5) for x in docs], "doc_id long, text string, lang string, source string, n_chars long, toxic int, score double").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs, labels


def test_query(spark, tables):
    d, docs, labels = tables
    rows = __spark_entry__.queries()["op13_toxicity"](spark, d).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i, *_ in docs)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["predicted"] == 1 and by[5003]["predicted"] == 1
    assert [by[i]["predicted"] for i in (5000, 5001, 5002)] == [0, 0, 0]
    truth = {i: t for i, _, t in labels if t is not None and i is not None and i in by and i < 3000}
    wrong = [i for i, t in truth.items() if by[i]["predicted"] != t]
    assert len(wrong) <= 0.01 * len(truth), [(i, docs[i][1][:80], by[i]["terms"]) for i in wrong[:5]]


def test_learned_lexicon(spark, tables):
    d, _, _ = tables
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    lexicon = X.train(docs, labels)
    assert {"idiot*", "scum*"} <= set(lexicon.weights) and any(t.startswith("droke") for t in lexicon.weights)
    assert X.Lexicon.from_json(lexicon.to_json()) == lexicon
    assert "trash can" in lexicon.exceptions or not any(t.startswith("tras") for t in lexicon.weights)
    again = X.train(docs.repartition(7), labels.repartition(3))
    assert again == lexicon
    given = docs.limit(1).select(X.toxicity(F.lit("a scum bag"), X.train(docs, labels, exceptions=["scum bag"])).alias("t")).select("t.terms").first()
    assert "scum*" not in given["terms"]


def test_nothing_to_learn_from(spark, tables):
    d, docs, _ = tables
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    for some, share in ((labels.limit(0), 0.0), (labels.filter("toxic = 0"), None)):
        lexicon = X.train(table, some)
        assert lexicon.weights == {}
        got = {r["t"]["score"] for r in table.limit(20).select(X.toxicity(F.col("text"), lexicon).alias("t")).collect()}
        assert len(got) == 1 and (share is None or got.pop() == pytest.approx(share, abs=1e-12))
    assert table.limit(0).select(X.toxicity(F.col("text"), lexicon).alias("t")).collect() == []
