import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from codestrata.llm import simhash
from codestrata.llm.components import connected_components
from codestrata.session import Scratch


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, fps, radius=4):
    label = dict(zip(range(len(ids)), range(len(ids))))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least.get(root(i)) for i in range(len(ids))]


TEXTS = ["", None, "one", "One  TWO\tthree", "a b c d e f", "A B\x0bc\x0cd e f", "İ É ß ß ß", " lead trail ", "\x1c \x85 x y", "w " * 5000, "a b c d e g"]


def test_fingerprints_equal_brute_force():
    got = simhash.fingerprints(pa.array(TEXTS))
    assert [int(x) for x in got] == [brute_fingerprint(t) for t in TEXTS]
    assert len(simhash.fingerprints(pa.array([], pa.string()))) == 0


def test_chunks_of_shingles_add_up(monkeypatch):
    whole = simhash.fingerprints(pa.array(TEXTS))
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    assert (simhash.fingerprints(pa.array(TEXTS)) == whole).all()


@pytest.mark.parametrize("chunk", [3, 2048])
def test_components_equal_brute_force_on_dense_groups(spark, chunk):
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = [int(c) for c in rng.integers(0, 2**64, 60, dtype=np.uint64)]
    for c in centers:
        for _ in range(25):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.append(x)
    fps += fps[:20]  # copies
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    ids = [int(i) for i in rng.permutation(len(fps))]
    df = spark.createDataFrame(list(zip(ids, signed)), "doc_id long, fp long")
    scratch = Scratch(spark, "t")
    edges = simhash.links(df.select("fp").distinct(), scratch, chunk=chunk)
    label = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    want = brute_components(ids, fps)
    least = {}
    for i, s in zip(ids, signed):
        least[label.get(s, s)] = min(i, least.get(label.get(s, s), i))
    assert [least[label.get(s, s)] for s in signed] == want


def test_query_rows_equal_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today ".split() * 8
    rows = [(i, t, "s", 1) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(base[:100] + [f"w{i % 3}"]), None, 2) for i in range(9)] + [(3, "One  TWO\tthree", "s", 1), (None, "one", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")  # clashing names
    got = sorted(((r[0], r[1], r[2]) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components([r[0] for r in rows], fps)
    assert got == sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comp)), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (501, 501)], "u long, v long")
    got = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 500: 500, 501: 500}
