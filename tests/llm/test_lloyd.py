"""Exact clustering and vector codes against plain Python, with odd rows."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from codestrata.llm import delta_lloyd, lattice, weighted_lloyd


def vectors(dim, n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(dim)], i % 3 if i % 5 else None) for i in range(n)]
    hot = rows[7][1]
    rows += [(1000 + i, hot, 1) for i in range(150)]  # a third of all rows
    rows += [(2000, rows[3][1], 2), (2000, rows[3][1], 2), (2001, [0.0] * dim, None), (None, rows[9][1], 0)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.1] * (dim - 1), 1), (3003, [float("nan")] + [0.1] * (dim - 1), 0), (3004, [float("inf")] + [0.1] * (dim - 1), 0), (3005, [None] + [0.1] * (dim - 1), 0)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, q string, n int, id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)


def kept(rows, scale, dim):
    return [(i, [math.floor(scale * x) for x in v], g) for i, v, g in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]


def dist(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def lloyd(points, centres, rounds):
    """Each round: assign, then floored means."""
    near = lambda p: min(range(len(centres)), key=lambda k: (dist(p, centres[k]), k))
    for _ in range(rounds):
        at = [near(p) for p in points]
        means = []
        for k, c in enumerate(centres):
            mine = [p for p, a in zip(points, at) if a == k]
            means.append([sum(x) // len(mine) for x in zip(*mine)] if mine else c)
        centres = means
    return centres, [(k := near(p), dist(p, centres[k])) for p in points]


@pytest.mark.parametrize("k", [5, 700])
def test_clustering(spark, k):
    rows = vectors(6)
    points = kept(rows, 64, 6)
    marks = sorted(points, key=lambda p: (p[0] is None, hashlib.sha256(f"1:{p[0]}".encode()).hexdigest(), p[1]))
    centres, at = lloyd([p[1] for p in points], [p[1] for p in marks[:k]], 2)
    inertia = {}
    for c, d in at:
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    want = [(p[0], c, d, inertia[c], sum(inertia.values()), sha[c]) for p, (c, d) in zip(points, at)]
    got = weighted_lloyd.cluster(table(spark, rows), k=k, rounds=2, dim=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("entries", [3, 256])
def test_codes(spark, entries):
    rows = vectors(8)
    points = kept(rows, 256, 8)
    first = sorted(points, key=lambda p: (p[0] is None, p[0], p[1]))[:entries]
    code, error, books = [""] * len(points), [0] * len(points), []
    for p in range(0, 8, 2):
        centres, at = lloyd([x[1][p : p + 2] for x in points], [x[1][p : p + 2] for x in first], 2)
        code = [c + f"{k:02x}" for c, (k, _) in zip(code, at)]
        error = [e + d for e, (_, d) in zip(error, at)]
        books += [str(v) for c in centres for v in c]
    per = {}
    for x, e in zip(points, error):
        per[x[2]] = per.get(x[2], 0) + e
    sha = hashlib.sha256(",".join(books).encode()).hexdigest()
    want = [(x[0], c, e, per[x[2]], sha) for x, c, e in zip(points, code, error)]
    got = delta_lloyd.compress(table(spark, rows), parts=4, entries=entries)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_only_changes_contribute(spark):
    """A second round with the same codebooks moves nothing and so shuffles nothing."""
    rows = table(spark, vectors(8)).select("vec_id", F.col("label"), lattice.quantised(F.col("embedding"), 256).alias("q")).filter("size(q) = 8").select(F.col("vec_id").alias("id"), "label", "q")
    start = [r["q"] for r in rows.orderBy("id").limit(4).collect()]
    entries = delta_lloyd.np.array(start).reshape(4, 4, 2).transpose(1, 0, 2)
    once = delta_lloyd.encoded(rows, entries)
    assert sum(r["n"] for r in delta_lloyd.deltas(once, entries.shape).collect()) == 4 * rows.count()
    assert delta_lloyd.deltas(delta_lloyd.encoded(once, entries), entries.shape).count() == 0
    other = entries + 7
    books = delta_lloyd.Codebooks(entries)
    for state in (once, delta_lloyd.encoded(once, other)):  # running sums equal those of all parts
        for r in delta_lloyd.deltas(state, entries.shape).collect():
            books.add(r["part"], r["entry"], r["n"], r["sums"])
    fresh = delta_lloyd.Codebooks(other)
    for r in delta_lloyd.deltas(delta_lloyd.encoded(rows, other), entries.shape).collect():
        fresh.add(r["part"], r["entry"], r["n"], r["sums"])
    assert (books.n == fresh.n).all() and (books.sums == fresh.sums).all()


def test_no_vectors(spark):
    empty = table(spark, vectors(8)).limit(0)
    assert weighted_lloyd.cluster(empty, dim=8).collect() == [] and delta_lloyd.compress(empty).collect() == []
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert weighted_lloyd.cluster(none).collect() == [] and delta_lloyd.compress(none).collect() == []


def test_large_components_stay_exact():
    x = delta_lloyd.np.array([[1 << 25, -(1 << 25)], [(1 << 25) - 1, 3]])
    at, d = lattice.nearest(x, x[::-1].copy())
    assert at.tolist() == [1, 0] and d.tolist() == [0, 0]
    assert lattice.nearest(x[:1], x[1:])[1][0] == 1 + ((1 << 25) + 3) ** 2
