import random
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline as pipeline
from codestrata.llm import langid, mixing, piece, secret_scan, simhash
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import brute_components, brute_fingerprint

WORDS = {"aa": "ka lo mi tuna sereko palu dima".split(), "bb": "der und schön straße größe ich aber".split()}


def rows(seed=0):
    r = random.Random(seed)
    out = []
    for i in range(120):
        lang = r.choice(list(WORDS))
        t = " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(20, 120)))
        if i % 9 == 0:
            t += " password=" + "".join(r.choice("0123456789abcdef") for _ in range(18))
        out.append((i, t, lang if i % 3 else None, f"src{i % 4}" if i % 11 else None, len(t)))
    out += [(200 + i, out[5][1], None, "src0", 1) for i in range(6)]  # copies
    out += [(300, None, "aa", "src1", None), (301, "", None, "src1", 0), (302, "12 34 !!", "aa", None, 8), (303, out[7][1], "aa", "src2", 5), (303, out[7][1], "aa", "src2", 5)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_against_plain_versions(spark, docs):
    held = docs
    table = rows()
    for name, stage in pipeline.STAGES:
        before = held.collect()
        held = spark.createDataFrame(stage(spark, held, "").collect(), stage(spark, held, "").schema)
        after = held.collect()
        if name != "sentencepiece":
            assert held.columns == docs.columns
        if name == "language_id":
            assert sorted(map(tuple, after), key=str) == sorted((r for r in table if r[1] and any(c.isalpha() for c in r[1])), key=str)
        if name == "simhash_near_dedup":
            component = brute_components([r["doc_id"] for r in before], [brute_fingerprint(r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted(set(component))
        if name == "secret_scan":
            forest = secret_scan.default_model()
            want = {r["doc_id"]: secret_scan.redacted(r["text"], secret_scan.scan([r["text"]], forest)[0]) for r in before}
            assert {r["doc_id"]: r["text"] for r in after} == want and len(after) == len(before)
            assert not any("password=0" in t or "password=a" in t for t in want.values()) and any(secret_scan.MASK in t for t in want.values())
            assert all(r["n_chars"] == len(r["text"]) for r in after if secret_scan.MASK in r["text"])
        if name == "entropy_mixing":
            size = Counter()
            for r in before:
                size[r["source"]] += len(r["text"].split())
            goal, got = brute_targets(size), Counter()
            for r in after:
                got[r["source"]] += len(r["text"].split())
            assert all(abs(got[s] - goal[s]) <= 0.05 * goal[s] + 60 for s in goal)
            assert max(Counter(r["doc_id"] for r in after).values()) <= 2
        if name == "sentencepiece":
            library = sentencepiece.SentencePieceProcessor(model_file=piece.MODEL)
            assert sorted((r["doc_id"], r["ids"]) for r in after) == sorted((r["doc_id"], library.encode(r["text"])) for r in before)


def test_mixed_rows_match_their_copies(spark, docs):
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    got = Counter(r["doc_id"] for r in mixing.mixed_rows(docs).collect())
    assert got == Counter({k: n for k, n in copies.items() if n})


def test_empty_and_clashing(spark, docs):
    none = docs.limit(0)
    assert simhash.deduplicate(none).count() == 0 and mixing.mixed_rows(none).count() == 0
    odd = docs.withColumnsRenamed({"lang": "fp", "n_chars": "h"})
    assert simhash.deduplicate(odd).columns == odd.columns and mixing.mixed_rows(odd).columns == odd.columns
    assert pipeline.STAGES[0][1](spark, none, "").count() == 0
    assert langid.UNKNOWN not in {r["lang"] for r in pipeline.identify_language(spark, docs, "").collect()}
