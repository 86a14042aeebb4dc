import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import lm
from codestrata.llm.eliasfano import ABSENT, EliasFano, Trie


@pytest.mark.parametrize("block", [8, 64, 1 << 15])
def test_elias_fano_round_trip(monkeypatch, block):
    monkeypatch.setattr("codestrata.llm.eliasfano.BLOCK", block)
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1, 2**62), (500, 3), (777, 10**6), (1000, 2**62)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = EliasFano.encode(values)
        assert (e.decode() == values).all()
        spots = np.sort(rng.integers(0, max(n, 1), 40))[: 40 * (n > 0)]
        assert (e.at(spots) == values[spots]).all()
        wanted = np.unique(np.r_[values[::3], rng.integers(0, top, 50, dtype=np.uint64)])
        at = e.find(wanted) if len(np.unique(values)) == len(values) else None
        if at is not None:
            assert [i >= 0 for i in at] == [w in set(values.tolist()) for w in wanted.tolist()]
            assert (values[at[at >= 0]] == wanted[at >= 0]).all()


def test_elias_fano_is_compact():
    values = np.sort(np.random.default_rng(1).integers(0, 2**40, 100_000, dtype=np.uint64))
    e = EliasFano.encode(values)
    assert 8 * (e.low.nbytes + e.high.nbytes) / len(values) <= 2 + math.log2(2**40 / len(values)) + 0.6


def test_trie_equals_a_dictionary():
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 50, 900) * 7919, rng.integers(0, 2**40, 900))})
    contexts = sorted({a for a, _ in pairs})
    per = Counter(a for a, _ in pairs)
    codes = rng.integers(0, 60000, len(pairs))
    trie = Trie(np.array(contexts, np.uint64), np.cumsum([0, *(per[c] for c in contexts)]), np.array([b for _, b in pairs], np.uint64), codes)
    held = dict(zip(pairs, codes))
    asked = sorted({*pairs[::2], *((a + 1, b) for a, b in pairs[:40]), *((a, b ^ 1) for a, b in pairs[:40])})
    n = Counter(a for a, _ in asked)
    got = trie.find(np.array(sorted(n), np.uint64), np.array([n[c] for c in sorted(n)]), np.array([b for _, b in asked], np.uint64))
    assert got.tolist() == [held.get(p, ABSENT) for p in asked]
    trie.close()


def test_pairs_of_a_busy_context_are_never_taken_for_one_another():
    """Successors are whole ids, however many a context has."""
    w = np.arange(2_000_000, dtype=np.int64) * 3
    trie = Trie(np.array([5, 9]), np.array([0, len(w) - 1, len(w)]), np.r_[w[:-1], 2], np.r_[np.zeros(len(w) - 1, np.int64), 7])
    got = trie.find(np.array([4, 5, 9]), np.array([1, 4, 3]), np.array([0, 0, 1, 3, 3 * len(w), 1, 2, 3]))
    assert got.tolist() == [ABSENT, 0, ABSENT, 0, ABSENT, ABSENT, 7, ABSENT]
    trie.close()


def test_blocks_of_pairs():
    rng = np.random.default_rng(3)

    def made(n):
        pairs = np.unique(rng.integers(0, 40, (n, 2)) * [1, 10**11], axis=0)
        return lm.Pairs(pairs[:, 0], pairs[:, 1], rng.integers(0, 9, len(pairs)), pairs[:, 1] // 10**11, pairs[:, 0] * 3)

    parts = [made(n) for n in (1, 50, 300)]
    for p in parts:
        q = lm.Pairs.unpack(p.pack())
        assert all((getattr(p, k) == getattr(q, k)).all() for k in ("v", "w", "count", "level", "total"))
    whole, place = lm.Pairs.merge(parts)
    want = Counter()
    for p in parts:
        want.update(dict(zip(zip(p.v.tolist(), p.w.tolist()), p.count.tolist())) | {})
    assert list(zip(whole.v.tolist(), whole.w.tolist())) == sorted({k for p in parts for k in zip(p.v.tolist(), p.w.tolist())})
    assert all(want[k] == c for k, c in zip(zip(whole.v.tolist(), whole.w.tolist()), whole.count.tolist()))
    every = np.concatenate([np.stack([p.v, p.w], 1) for p in parts])
    assert (np.stack([whole.v, whole.w], 1)[place] == every).all()


@pytest.mark.parametrize("batches", [1, 5, 100, 10_000])
def test_blocks_grow_less_than_with_the_square(batches):
    c = lm.Corpus(10**9, 10**6, 10, 1, batches, lm.MU)
    groups = -(-c.pair_shards // c.width)
    assert batches * groups + c.bundles * c.pair_shards <= 2 * batches**1.5 + 2 * batches + 4


@pytest.mark.parametrize("batches", [1, 5, 128, 7_500, 250_000])
def test_token_blocks_grow_less_than_with_the_square(batches):
    """By bundles: 7,500 batches (30 GB) write 313,168 blocks, not 7 million."""
    ways = lm.Tokens(1 + batches // 8, batches)
    groups = -(-ways.shards // ways.width)
    assert batches * groups + ways.bundles * ways.shards <= batches**1.5 + 2 * batches + 4


def test_token_totals_by_bundles():
    """Totals and ids reach each batch as if all counts had been in one table."""
    rng, ways, batches = np.random.default_rng(5), lm.Tokens(7, 9), []
    for b in range(9):
        keys = rng.permutation(np.unique(rng.integers(0, 60, 25).astype(np.uint64) * np.uint64(10**15 + 7)))
        tokens = rng.integers(0, len(keys), 80).astype(np.int32)
        flags = np.array([1, 0], np.uint8)
        batches.append({"batch": b, "train": lm._put(flags), "lengths": lm._put(np.array([50, 30])), "tokens": lm._put(tokens), "keys": lm._put(keys)})
    asked = [r for b in ways.ask([lm.pa.RecordBatch.from_pylist(batches)]) for r in b.to_pylist()]

    def each(rows, key, what):
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[k] for k in key), []).append(r)
        return [x for g in groups.values() for x in what(lm.pa.Table.from_pylist(g)).to_pylist()]

    totals = each(each(asked, ("bundle", "place"), ways.gather), ("place",), ways.total)
    dealt = []
    for way in {(r["bundle"], r["place"]) for r in asked}:
        mine = [r for r in asked if (r["bundle"], r["place"]) == way]
        dealt += ways.give_back(lm.pa.Table.from_pylist(mine), lm.pa.Table.from_pylist([r for r in totals if (r["bundle"], r["group"]) == way])).to_pylist()
    want = Counter()
    for b in batches:
        keys = lm._get(b["keys"], np.uint64)
        want.update(keys[lm._get(b["tokens"], np.int32)[:50]].tolist())
    assert sum(r["tokens"] for r in totals) == 9 * 50 and sum(r["distinct"] for r in totals) == len(want) and sum(r["once"] for r in totals) == sum(c == 1 for c in want.values())
    corpus, ids = lm.Corpus(450, len(want), 0, 7, 9, lm.MU), {}
    for b in batches:
        keys = lm._get(b["keys"], np.uint64)
        total, found = corpus.known(keys, [r for r in dealt if r["batch"] == b["batch"]])
        assert total.tolist() == [want[k] for k in keys.tolist()]
        assert all(ids.setdefault(k, i) == i for k, i in zip(keys.tolist(), found.tolist()))
    assert len(set(ids.values())) == len(ids)


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]


def brute(rows, mu):
    ones, twos = Counter(), Counter()
    for _, text, train in rows:
        if train:
            t = tokens(text)
            ones.update(t)
            twos.update(zip(["\n", *t], t))
    n, v, e = sum(ones.values()), len(ones), (sum(c == 1 for c in ones.values()) + 1) / (sum(ones.values()) + 2)
    p = lambda w: (1 - e) * ones[w] / n if ones[w] else e
    out = []
    for i, text, train in rows:
        t = tokens(text)
        s = sum(math.log10((twos[a, b] + mu * p(b)) / (ones[a] + mu)) for a, b in zip(["\n", *t], t))
        out.append((i, not train, len(t), sum(ones[w] > 0 for w in t), n, sum(math.log10((ones[w] + 1) / (n + v + 1)) for w in t), s))
    return out


@pytest.mark.parametrize("batch_bytes", [2000, 8 << 20])
def test_scores_equal_brute_force(spark, monkeypatch, batch_bytes):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)] + ["The", "the", "ß", "İx"]
    p = 1 / np.arange(1, len(words) + 1)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 80), p=p / p.sum())), bool(i % 7 != 2)) for i in range(120)]
    rows += [(500, None, True), (501, "", False), (502, "  \n\t", True), (None, "the the the", True), (503, "hot pair " * 3000, True), (503, "hot pair " * 3000, True), (504, "never seen before", False)]
    monkeypatch.setattr(lm, "BATCH_BYTES", batch_bytes)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, train boolean, batch int").repartition(3)
    got = sorted((tuple(r) for r in lm.score(df, F.col("train")).collect()), key=str)
    want = sorted(brute(rows, lm.MU), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-9)
    assert all(abs(g[6] - w[6]) <= 2e-3 * g[2] for g, w in zip(got, want))  # what the rounding allows a token


def test_the_model_is_a_distribution(spark):
    rows = [(i, " ".join("abcdefgh"[(i * j) % 7] for j in range(20)), True) for i in range(30)]
    vocabulary = sorted({w for _, t, _ in rows for w in tokens(t)} - {"\n"})
    asked = [(1000 + i, w, False) for i, w in enumerate([*vocabulary, "unknown"])] + [(2000, "", False)]
    df = spark.createDataFrame(rows + asked, "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r["score"] for r in lm.score(df, F.col("train")).filter("doc_id >= 1000").collect()}
    first = {w: 0.0 for w in vocabulary}
    ones, twos = Counter(), Counter()
    for _, t, _ in rows:
        ones.update(tokens(t))
        twos.update(zip(["\n", *tokens(t)], tokens(t)))
    n, e = sum(ones.values()), (sum(c == 1 for c in ones.values()) + 1) / (sum(ones.values()) + 2)
    for i, w in enumerate([*vocabulary, "unknown"]):  # take the end token's share off again
        end = (twos[w, "\n"] + lm.MU * (1 - e) * ones["\n"] / n) / (ones[w] + lm.MU)
        first[w] = 10 ** got[1000 + i] / end
    assert sum(first.values()) + 10 ** got[2000] == pytest.approx(1, abs=0.01)


def test_no_training_text_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", False), (2, None, False)], "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r for r in lm.score(df, F.col("train")).collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0 and got[1]["base_score"] == 0.0 and got[2]["n_tokens"] == 1
    assert lm.score(df.limit(0), F.col("train")).count() == 0
