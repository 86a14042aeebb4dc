"""Chains, components, levels, cycles and reach on shapes that take many rounds if done step by step."""

import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import condense, decouple, graph
from codestrata.operators import reach as bitmaps
from codestrata.session import Scratch
from tests.test_graph import frames, reach, sccs


@pytest.fixture
def writes(monkeypatch):
    """Counts the tables that operators write, each a round."""
    seen, plain = [], Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df: (seen.append(self.base), plain(self, df))[1])
    return seen


def path(spark, n):
    mixed = list(range(n))
    random.Random(1).shuffle(mixed)
    place = {v: i for i, v in enumerate(mixed)}
    return spark.range(n), spark.createDataFrame([(mixed[i], mixed[i + 1]) for i in range(n - 1)], "src long, dst long"), place


def test_long_path_takes_few_rounds(spark, writes):
    n = 10_000
    nodes, edges, place = path(spark, n)
    assert graph.components(nodes, edges).filter("id = component").count() == n and len(writes) < 30
    writes.clear()
    assert {r["id"]: r["level"] for r in graph.topological_levels(nodes, edges).collect()} == place and len(writes) < 30
    writes.clear()
    assert not graph.has_cycle(nodes, edges) and len(writes) < 30
    assert {r["id"]: r["reach"] for r in graph.reach_counts(nodes, edges).collect()} == {v: n - 1 - i for v, i in place.items()}


def test_long_ring(spark, writes):
    n = 1000
    nodes, edges, place = path(spark, n)
    first, last = (next(v for v, i in place.items() if i == k) for k in (0, n - 1))
    ring = edges.unionByName(spark.createDataFrame([(last, first)], "src long, dst long"))
    assert graph.components(nodes, ring).filter("component = 0").count() == n and len(writes) < 30
    assert graph.has_cycle(nodes, ring)
    cycle = [r["id"] for r in graph.find_cycle(nodes, ring).orderBy("place").collect()]
    start = place[0]
    assert cycle == [v for v, i in sorted(place.items(), key=lambda x: (x[1] - start) % n)]
    assert graph.reach_counts(nodes, ring).filter(f"reach = {n - 1}").count() == n
    assert graph.topological_levels(nodes, ring).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_chains_between_rings(spark, seed):
    """Rings, loops, chains and random edges mixed, against plain Python."""
    r, edges, n = random.Random(seed), [], 0
    for _ in range(8):
        k = r.randint(1, 9)
        edges += [(n + i, n + i + 1) for i in range(k - 1)]
        if r.random() < 0.5 and k > 1:
            edges.append((n + k - 1, n + r.randrange(k - 1)))
        if n and r.random() < 0.8:
            edges.append((r.randrange(n), n))
        n += k
    edges += [(r.randrange(n), r.randrange(n)) for _ in range(4)]
    nodes, e = frames(spark, n, edges)
    loopless = [(u, v) for u, v in edges if u != v]
    want = sccs(n, loopless)
    assert {x["id"]: x["component"] for x in graph.components(nodes, e).collect()} == want
    assert {x["id"]: x["reach"] for x in graph.reach_counts(nodes, e).collect()} == {i: len(reach(n, edges, i) - {i}) for i in range(n)}
    cyclic = any(u == v for u, v in edges) or len(set(want.values())) < n
    assert graph.has_cycle(nodes, e) == cyclic
    cycle = [x["id"] for x in graph.find_cycle(nodes, e).orderBy("place").collect()]
    assert bool(cycle) == cyclic and all((a, b) in edges for a, b in zip(cycle, cycle[1:] + cycle[:1])) and len(set(cycle)) == len(cycle)


def test_chain_places_and_weights(spark):
    _, e = frames(spark, 7, [(5, 3), (3, 1), (1, 6), (6, 0), (6, 2)])
    weights = spark.createDataFrame([(i, 10 * i) for i in range(7)], "id long, w long")
    got = condense.chains(condense.simple_edges(e), Scratch(spark, "t"), 1, weights)
    assert sorted(map(tuple, got.collect())) == [(1, 5, 80), (3, 5, 50), (5, 5, 0), (6, 5, 90)]
    assert condense.chains(condense.simple_edges(e), Scratch(spark, "t"), 4) is None


def test_reach_writes_words_not_pairs(spark, monkeypatch):
    """A layered graph where almost all reach almost all: rows stay near pairs / 64."""
    layers, width = 12, 100
    r = random.Random(5)
    edges = [(a * width + i, (a + 1) * width + r.randrange(width)) for a in range(layers - 1) for i in range(width) for _ in range(3)]
    nodes, e = frames(spark, layers * width, edges)
    seen = []
    plain = bitmaps.Scratch.write
    monkeypatch.setattr(bitmaps.Scratch, "write", lambda self, df: seen.append(plain(self, df)) or seen[-1])
    got = {x["id"]: x["reach"] for x in graph.reach_counts(nodes, e).collect()}
    far = {i: reach(layers * width, edges, i) for i in range(0, layers * width, 37)}
    assert all(got[i] == len(f) for i, f in far.items())
    assert max(df.count() for df in seen) < sum(got.values()) / 8
    assert {c for df in seen for c in df.columns if c in ("dst",)} <= {"dst"} and graph.reach_counts(nodes, e.limit(0)).filter(F.col("reach") > 0).count() == 0


def test_names_as_ids_and_no_rows(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("d", None)], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdx"], "id string")
    assert {r["id"]: r["component"] for r in graph.components(nodes, e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "x": "x"}
    assert {r["id"]: r["reach"] for r in graph.reach_counts(nodes, e).collect()} == {"a": 3, "b": 3, "c": 3, "d": 0, "x": 0}
    assert [r["id"] for r in graph.find_cycle(nodes, e).collect()] == ["x"]
    assert [r["id"] for r in graph.find_cycle(nodes, e.filter("src <> 'x'")).orderBy("place").collect()] == ["a", "b", "c"]
    none = e.limit(0)
    assert graph.find_cycle(nodes, none).count() == 0 and not graph.has_cycle(nodes, none) and graph.topological_levels(nodes, none).filter("level = 0").count() == 5


def test_chain_between_dense_cycles_is_no_component(spark):
    """A contracted chain that is first by hash of all that reach it is reached back by nothing: its members stay apart."""
    nodes, pairs, want = [], [], {}
    for g in range(40):
        a, c, b = ([100 * g + 10 * k + i for i in range(n)] for k, n in enumerate((3, 4, 3)))
        for ring in (a, b):
            pairs += [(x, y) for x in ring for y in ring if x != y]
            want |= {x: min(ring) for x in ring}
        want |= {x: x for x in c}
        pairs += [(a[0], c[0]), *zip(c, c[1:]), (c[-1], b[0])]
        nodes += [(x,) for x in (*a, *c, *b)]
    found = graph.components(spark.createDataFrame(nodes, "id long"), spark.createDataFrame(pairs, "src long, dst long"))
    assert {r["id"]: r["component"] for r in found.collect()} == want


def test_what_rests_on_components_of_chains_between_dense_cycles(spark):
    """Reach, both scores, roots and cyclic components on the graph above, against plain Python."""
    nodes, pairs, want, rings = [], [], {}, {}
    for g in range(40):
        a, c, b = ([100 * g + 10 * k + i for i in range(n)] for k, n in enumerate((3, 4, 3)))
        for ring in (a, b):
            pairs += [(x, y) for x in ring for y in ring if x != y]
            rings[min(ring)] = 6
        pairs += [(a[0], c[0]), *zip(c, c[1:]), (c[-1], b[0])]
        nodes += [*a, *c, *b]
        want |= {x: (9, 2) for x in a} | {x: (6 - i, 3 + i) for i, x in enumerate(c)} | {x: (2, 9) for x in b}
    ids = spark.createDataFrame([(x,) for x in nodes], "id long")
    edges = spark.createDataFrame([(x, y, 1.0) for x, y in pairs], "src long, dst long, weight double")
    out, into = ({x: sum(p[k] == x for p in pairs) for x in nodes} for k in (0, 1))
    assert {r["id"]: r["reach"] for r in graph.reach_counts(ids, edges).collect()} == {x: n for x, (n, _) in want.items()}
    assert {r["id"]: round(r["score"], 6) for r in graph.oop_scores(ids, edges).collect()} == {x: round(out[x] + 0.5 * n - 0.8 * into[x], 6) for x, (n, _) in want.items()}
    assert {r["id"]: round(r["score"], 6) for r in graph.crtp_scores(ids, edges).collect()} == {x: round(into[x] + 0.5 * n - 0.8 * out[x], 6) for x, (_, n) in want.items()}
    comp = Scratch(spark, "rests").write(graph.components(ids, edges))
    roots = graph.roots_by_reach(comp.select(F.col("component").alias("id")).distinct(), graph.condensed_edges(comp, edges))
    assert [(r["id"], r["reach"]) for r in roots.orderBy("place").collect()] == [(100 * g, 5) for g in range(40)]
    cut = decouple.chosen_cuts(comp, edges.select("src", "dst", F.lit(1.0).alias("cost")))
    assert {r["component"]: r["n"] for r in cut.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()} == {k: n // 2 for k, n in rings.items()}


def test_few_edges_are_one_task(spark, writes, monkeypatch):
    """Components of a small graph take no rounds; colouring finds the same."""
    r = random.Random(11)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(75)] + [(70 + i, 70 + (i + 1) % 9) for i in range(9)]
    nodes, e = frames(spark, 80, edges)
    found = {x["id"]: x["component"] for x in graph.components(nodes, e).collect()}
    assert len(writes) <= 3 and len(set(found.values())) < 80
    assert found == {v: min(u for u in range(80) if u == v or (u in reach(80, edges, v) and v in reach(80, edges, u))) for v in range(80)}
    monkeypatch.setattr(condense, "REST", 0)
    assert {x["id"]: x["component"] for x in graph.components(nodes, e).collect()} == found
