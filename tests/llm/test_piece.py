import random
import time

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from codestrata.llm import piece

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=piece.MODEL)
VOCABULARY = piece.Vocabulary.load()
ODD = ["", "a", " a", "a ", "  a  b   ", "▁x", " ", "    ", "\n", "a\nb", "a\x00b", "日本語 テスト", "🙂 hi", "ß" * 50, "the" * 2000, "x" * 3000, " " * 37, "\t\ttab", "A▁▁B", "def f(x):\n    return x\n"]


def made(parts, n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 120))) for _ in range(n)]


TEXTS = ODD + made("abcdefghij klmnop ABÉé日\n.,-_=019  ", 300, 1) + made(["the", "ing", "er", "tion", "re", "▁", "ight", " ", "on"], 300, 2)


@pytest.fixture(scope="module")
def coder():
    return piece.Encoder(VOCABULARY)


def test_equal_to_the_library(coder):
    for _ in range(2):  # new units, then known ones
        got = coder.encode(pa.array(TEXTS))
        assert got.to_pylist() == LIBRARY.encode(TEXTS)
    assert coder.decode(got) == LIBRARY.decode(got.to_pylist())
    assert coder.decode(got) == [t.replace(piece.SPACE, " ") for t in TEXTS]


def test_memory_is_bounded(coder, monkeypatch):
    monkeypatch.setattr(piece, "HELD_UNITS", 10)
    for t in TEXTS[:60]:
        assert coder.encode(pa.array([t])).to_pylist() == [LIBRARY.encode(t)]


def test_decode_of_broken_bytes(coder):
    ids = [[coder.byte[0xE6], coder.byte[0x97]], [1, coder.unk, 2], []]
    assert coder.decode(pa.array(ids, pa.list_(pa.int32()))) == LIBRARY.decode(ids)


def test_longest_matches_equal_brute_force(coder):
    data = b"\0".join(("▁" + w).encode() for w in "internationalization thethe ight 日本 x".split()) + b"\0"
    got = coder.longest(data)
    for i in range(len(data)):
        fits = [j for j in coder.usable if data.startswith(VOCABULARY.pieces[j].encode(), i)]
        assert got[i] == max(fits, key=lambda j: coder.length[j], default=-1)


def test_unigram_takes_the_best_path():
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab"]
    scores = [0.0, -3.0, -2.5, -2.0, -2.2, -3.1, -3.0, -6.0, -4.0, -6.2]
    coder = piece.Encoder(piece.Vocabulary(tuple(pieces), tuple(scores), (2, *[1] * 9), False))

    def best(t):
        table = {0: (0.0, [])}
        for j in range(1, len(t) + 1):
            ways = [(table[i][0] + scores[pieces.index(t[i:j])], table[i][1] + [pieces.index(t[i:j])]) for i in range(j) if i in table and t[i:j] in pieces[1:]]
            if ways:
                table[j] = max(ways)
        return table[len(t)][0]

    r = random.Random(3)
    for _ in range(50):
        t = " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(3))
        ids = coder.encode(pa.array([t])).to_pylist()[0]
        assert "".join(pieces[i] for i in ids) == piece.SPACE + t.replace(" ", piece.SPACE)
        assert sum(scores[i] for i in ids) == pytest.approx(best(piece.SPACE + t.replace(" ", piece.SPACE)))
    assert coder.encode(pa.array(["axb", "a  b"])).to_pylist() == [[8, 0, 3], [8, 1, 1, 3]]


def test_columns(spark):
    texts = [*ODD, None, ODD[5], "wörd " * 30000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in df.withColumn("e", piece.encode(F.col("text"), VOCABULARY)).withColumn("c", piece.encode_checked(F.col("text"), VOCABULARY)).withColumn("d", piece.decode(F.col("e"), VOCABULARY)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["e"] == LIBRARY.encode(t or "") and got[i]["d"] == (t or "").replace(piece.SPACE, " ") and got[i]["ids"] == "s" and tuple(got[i]["c"]) == (got[i]["e"], True)


def test_long_runs_take_no_quadratic_time(coder):
    """Runs of spaces and texts with NUL are merged from a heap."""
    texts = [" " * 200_000, "a" + " " * 50_001 + "b", "ab\0cd e" * 5_000, " x" * 20_000 + "  " * 3_000]
    began = time.monotonic()
    got = coder.encode(pa.array(texts)).to_pylist()
    assert time.monotonic() - began < 20
    assert got == LIBRARY.encode(texts) and coder.decode(pa.array(got)) == texts


def test_unigram_takes_pieces_of_any_length_beside_spaces():
    pieces = ["<unk>", "▁", "a", "▁▁" + "a" * 90]
    coder = piece.Encoder(piece.Vocabulary(tuple(pieces), (0.0, -3.0, -2.0, -5.0), (2, 1, 1, 1), False))
    assert coder.encode(pa.array([" " + "a" * 90])).to_pylist() == [[3]]


def test_memory_follows_slices_not_the_batch(monkeypatch):
    """What is indexed at once is bounded, whatever the batch holds; slices give what the texts give one by one."""
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("abcdefgh", k=9)) for _ in range(4000)) for _ in range(12)] + [None, "", "  a  b"]
    coder, seen = piece.Encoder(VOCABULARY), []
    indexed = piece.Encoder.longest
    monkeypatch.setattr(piece.Encoder, "longest", lambda self, data: seen.append(len(data)) or indexed(self, data))
    found = coder.encode(pa.array(texts))
    assert sum(seen) > 400_000 and max(seen) < 400_000
    assert found.to_pylist() == [LIBRARY.encode(t or "") for t in texts]
