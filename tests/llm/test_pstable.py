import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import pstable

ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [float("nan")]), (904, [1.0] * 7 + [float("inf")]), (905, [1.0] * 7 + [None]), (906, [1.0, 2.0])]


def table(spark, x, ids=None):
    ids = list(range(len(x))) if ids is None else ids
    return spark.createDataFrame([(i, [float(a) for a in v], 0, 1) for i, v in zip(ids, x)] + [(i, v, None, None) for i, v in ODD], "vec_id long, embedding array<float>, id int, keys int")


def vectors(n=300, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[50:120] = x[3] + 0.1 * rng.standard_normal((70, dim))  # a dense group
    x[120:140] = x[7]  # copies
    return np.float32(x).astype(float)


@pytest.mark.parametrize("chunk", [16, 512])
def test_near_duplicates_equal_brute_force(spark, chunk):
    x = vectors()
    got = {r["vec_id"]: r for r in pstable.near_duplicates(table(spark, x), chunk=chunk, tables=40).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.where(linked, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert [got[i]["n_links"] for i in range(len(x))] == (linked.sum(axis=1) - 1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _ in ODD)
    assert len(got) == len(x) + len(ODD)


@pytest.mark.parametrize("chunk", [8, 1024])
def test_search_with_all_probes_equals_brute_force(spark, chunk):
    x = vectors()
    got = pstable.search(table(spark, x), F.col("id") % 20 == 0, hashes=4, rounds=(1, 81), sure=2.0, width=4.0, chunk=chunk, query_chunk=5).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, len(x), 20):
        s = u @ u[q]
        want = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[1] for m in mine] == want
        assert np.allclose([m[2] for m in mine], s[want], atol=1e-12)


@pytest.mark.parametrize("hashes", [1, 3, 5])
def test_perturbations_are_all_sets_once(hashes):
    sets = pstable.perturbations(hashes, 10_000)
    assert len(sets) == 3**hashes == len(np.unique(sets, axis=0)) and not sets[0].any()
    assert (sets[:, :hashes] + sets[:, : hashes - 1 : -1] <= 1).all()


def test_probes_and_their_chance():
    """Probes are the neighbouring buckets' keys; the estimated chance is the share of points met."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = pstable.Tables(32, 3, 6, 2.0, 1)
    at = t.project(x)
    assert (t.probes(at, 0, 1)[..., 0] == t.keys(at)).all()
    assert (t.probes(at, 3, 20) == t.probes(at, 0, 20)[..., 3:]).all()
    moved = at.copy()
    step = np.where(at - np.floor(at) < 0.5, at - np.floor(at), 1 - (at - np.floor(at))).argmin(axis=-1)
    near = np.take_along_axis(at - np.floor(at), step[..., None], -1)
    np.put_along_axis(moved, step[..., None], np.take_along_axis(np.floor(at), step[..., None], -1) + np.where(near < 0.5, -0.5, 1.5), -1)
    assert (t.probes(at, 1, 2)[..., 0] == t.keys(moved)).all()
    noise = at + rng.standard_normal((2000, *at.shape)) * (0.7 / t.width)
    met = np.mean([(t.keys(y)[..., None] == t.probes(at, 0, 15)).any(axis=(1, 2)).mean() for y in noise])
    assert abs(met - t.success(at, 15, np.full(len(x), 0.7))[:, -1].mean()) < 0.02


def test_null_and_repeated_ids(spark):
    """A row without an id links others; ids repeated on unlike vectors are rows of their own."""
    a, b, c = [1.0, 0.0, 0.0], [0.999, 0.01, 0.0], [0.0, 1.0, 0.0]
    t = spark.createDataFrame([(None, a), (7, b), (None, c), (9, a), (9, c), (None, [0.0, 0.0, 1.0]), (None, None)], "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in pstable.near_duplicates(t).collect()), key=str)
    assert got == sorted([(None, 2, 7, False), (7, 2, 7, True), (9, 2, 7, False), (None, 1, 9, False), (9, 1, 9, True), (None, 0, None, False), (None, 0, None, False)], key=str)
    none = spark.createDataFrame([(None, a), (None, a), (None, b)], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in pstable.near_duplicates(none).collect()] == [(None, 2, None, False)] * 3
    found = pstable.search(t, F.col("id") == 9).collect()
    assert {(r["query_id"], r["vec_id"]) for r in found} == {(9, 7)}


def test_search_gives_all_candidates_of_a_spread_table(spark):
    """Opposite vectors share no bucket; the exact step finds them."""
    x = np.eye(8)[:4].tolist() + (-np.eye(8)[:4]).tolist()
    t = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = pstable.search(t, F.col("id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 5), (5, 6)]
    assert pstable.search(t.limit(3), F.col("id") == 0).count() == 2


def test_queries_with_near_neighbours_stop_early(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((2000, 64)), 8, axis=0) + 0.05 * rng.standard_normal((16000, 64))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen: dict = {}
    got = {(r["query_id"], r["vec_id"]) for r in pstable.search(t, F.col("id") % 200 == 0, report=seen).collect()}
    assert all(a // 8 == b // 8 for a, b in got) and len(got) == 5 * 80
    assert seen["visits"] < 0.1 * 80 * 16000


def test_recall_without_structure(spark):
    x = np.float32(np.random.default_rng(2).standard_normal((3000, 64))).astype(float)
    got = {(r["query_id"], r["vec_id"]) for r in pstable.search(table(spark, x), F.col("id") % 50 == 0).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::50] @ u.T
    s[np.arange(60), np.arange(60) * 50] = -2
    want = {(50 * i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:5]}
    assert len(got & want) >= 0.9 * len(want)


def test_small_tables(spark):
    one = table(spark, vectors()[:1])
    assert pstable.search(one, F.col("id") % 50 == 0).count() == 0
    two = table(spark, vectors()[[3, 3]], ids=[0, 0])  # a repeated row
    assert pstable.search(two, F.col("id") % 50 == 0).count() == 0
    assert [(r["n_links"], r["component_id"]) for r in pstable.near_duplicates(two).filter("vec_id = 0").collect()] == [(1, 0), (1, 0)]
    assert pstable.near_duplicates(one.limit(0)).count() == 0
    assert pstable.search(one.limit(0), F.col("id") % 50 == 0).count() == 0
