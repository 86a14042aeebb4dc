import random
import string

import corpus_pipeline as pipeline

WORDS = {"aa": "ka lo mi tuna sereko palu", "bb": "der und schön straße größe ich", "cc": "où été ça mère garçon les", "dd": "the with which from thought by"}


def rows():
    r = random.Random(2)
    clean = [(i, " ".join(r.choices(WORDS[lang].split(), k=40)), lang, "s", 1) for i, lang in enumerate(list(WORDS) * 40)]
    junk = [(1000 + i, "".join(r.choices(string.ascii_lowercase, k=60)), None, "s", 60) for i in range(20)]
    return clean + junk + [(2000, "1 2 3", None, "s", 5), (2001, None, None, "s", 0)]


def test_score_rejects_junk_and_keeps_clean_texts(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in pipeline.identify_language(spark, df, "").collect()}
    assert got >= set(range(160)) and len(got - set(range(160))) <= 4 and not got & {2000, 2001}


def test_documents_without_labels_stay(spark):
    df = spark.createDataFrame([(i, t, None, s, n) for i, t, _, s, n in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in pipeline.identify_language(spark, df, "").collect()} == {*range(160), *range(1000, 1020)}
