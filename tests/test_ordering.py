"""Cuts of large components by order, against a greedy search and single moves in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from codestrata.operators import decouple, ordering
from codestrata.plans import graph_queries
from codestrata.session import BROADCAST, Scratch

GRAPHS = 8


def weighted(seed):
    """A digraph of a kind that varies with the seed: dense, sparse, layered with a few edges back, a long ring with chords."""
    r, n = random.Random(seed), 9 + 3 * seed
    kind = seed % 4
    if kind == 0:
        pairs = [(u, v) for u in range(n) for v in range(n) if u != v and r.random() < 0.6]
    elif kind == 1:
        pairs = [(u, v) for u in range(n) for v in range(n) if u != v and r.random() < 4 / n]
    elif kind == 2:
        pairs = [(u, v) for u in range(n) for v in range(u + 1, min(n, u + 4))] + [(r.randrange(n // 2, n), r.randrange(n // 2)) for _ in range(4)]
    else:
        pairs = [(u, (u + 1) % n) for u in range(n)] + [(r.randrange(n), r.randrange(n)) for _ in range(n // 2)]
    return [(u, v, r.randint(1, 18) / 2) for u, v in sorted({p for p in pairs if p[0] != p[1]})]


def greedy(edges):
    """Cut the cheapest edge of a found cycle until there is none."""
    cost, left, cut = {(u, v): c for u, v, c in edges}, {(u, v) for u, v, _ in edges}, set()
    while ring := decouple._find_cycle(list(left)):
        e = min(ring, key=lambda x: (cost[x], x))
        left.remove(e)
        cut.add(e)
    return cut


@pytest.fixture(scope="module")
def graphs(spark):
    all_edges = {g: weighted(g) for g in range(GRAPHS)}
    rows = [(f"{g:02d}-{u:03d}", f"{g:02d}-{v:03d}", c) for g, edges in all_edges.items() for u, v, c in edges]
    return all_edges, spark.createDataFrame(rows, "src string, dst string, cost double")


def node(name):
    return int(name[:2]), int(name[3:])


def test_all_graphs_at_once_are_acyclic_and_cheaper_than_greedy(spark, graphs):
    """Rings with few chords are found a little dearer than by greedy search, all others cheaper."""
    all_edges, edges = graphs
    place = ordering.places(edges)
    cut = {(node(r["src"]), node(r["dst"])) for r in ordering.against_order(edges, place).collect()}
    for g, mine in all_edges.items():
        cost = {(u, v): c for u, v, c in mine}
        gone = {(u[1], v[1]) for u, v in cut if u[0] == g}
        assert not decouple._find_cycle([e for e in cost if e not in gone])
        assert sum(cost[e] for e in gone) <= sum(cost[e] for e in greedy(mine)) * (1.15 if g % 4 == 3 else 1), g
        assert 2 * sum(cost[e] for e in gone) <= sum(cost.values())


def test_partitioning_changes_nothing(spark, graphs):
    edges = graphs[1].filter("src < '02'")
    assert sorted(map(tuple, ordering.places(edges).collect())) == sorted(map(tuple, ordering.places(edges.repartition(3)).collect()))


def against(order, edges):
    rank = {x: i for i, x in enumerate(order)}
    return sum(c for u, v, c in edges if rank[v] < rank[u])


@pytest.mark.parametrize("cells", [ordering.CELLS, 4])
def test_no_single_move_gains(spark, monkeypatch, cells):
    """With few cells the busy nodes look at ranges of places; the others still find their best slot."""
    monkeypatch.setattr(ordering, "CELLS", cells)
    edges = weighted(5)
    found = ordering.places(spark.createDataFrame(edges, "src long, dst long, cost double")).collect()
    order = [r["id"] for r in sorted(found, key=lambda r: (r["at"], r["id"]))]
    degree = {x: len({u + v - x for u, v, _ in edges if x in (u, v)}) for x in order}
    now = against(order, edges)
    for x in order:
        rest = [y for y in order if y != x]
        if degree[x] <= cells:
            assert all(against([*rest[:i], x, *rest[i:]], edges) >= now for i in range(len(order)))


def test_components_of_both_sizes_and_a_hub(spark):
    """A hub that most nodes use and a few are used by, small components beside it, edges between components and loops."""
    hub = [(f"u{i:03d}", "hub", 1.0) for i in range(60)] + [("hub", f"u{i:03d}", 0.5) for i in range(0, 60, 7)]
    small = [("a", "b", 2.0), ("b", "a", 1.0), ("b", "hub", 9.0), ("a", "a", 1.0)]
    edges = spark.createDataFrame(hub + small, "src string, dst string, cost double")
    comp = spark.createDataFrame([("hub", "hub")] + [(f"u{i:03d}", "hub" if i % 7 == 0 else f"u{i:03d}") for i in range(60)] + [("a", "a"), ("b", "a")], "id string, component string")
    cut = {tuple(r) for r in decouple.chosen_cuts(comp, edges).collect()}
    assert cut == {("a", "b", "a")} | {("hub", "hub", f"u{i:03d}") for i in range(0, 60, 7)}


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long, cost double")
    assert ordering.places(none).count() == 0
    assert decouple.chosen_cuts(spark.createDataFrame([(1, 1)], "id long, component long"), none).count() == 0


def test_class_cuts_send_nothing_through_the_driver(spark, monkeypatch, tmp_path):
    """No table is broadcast, however small its file, and the session keeps its setting."""
    parts = [(i, 1, "Brand#11", "T") for i in range(8)]
    # i -> i / 2 or i / 3 for each part, and 1 -> 2, 2 -> 1 among the rows back.
    lines = [(7, i, 1, 50.0, 0.1 if i in (2, 3) else 0.0) for i in range(8)] + [(9, i, 2, 10.0, 0.0) for i in range(8)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plans, plain, before = [], Scratch.write, spark.conf.get(BROADCAST)

    def seen(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(self, df)

    monkeypatch.setattr(Scratch, "write", seen)
    found = graph_queries.class_cuts(spark, str(tmp_path))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert [tuple(r) for r in found.collect()] == [(1, 3, 4, 5.0, 0, True)]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert spark.conf.get(BROADCAST) == before


def test_small_cuts_are_searched_in_many_tasks(spark):
    """Components of a few edges, however small their table, are dealt over the tasks and cut as one by one."""
    n = 300
    rows = [(3 * i, 3 * i + a, 3 * i + b, c) for i in range(n) for a, b, c in ((0, 1, 3.0), (1, 2, 1.0 + i % 3), (2, 0, 2.0))]
    found = decouple._searched(spark.createDataFrame(rows, "component long, src long, dst long, cost double").coalesce(1))
    want = {(3 * i, u, v) for i in range(n) for u, v in decouple.least_cuts([(x[1], x[2], x[3]) for x in rows[3 * i : 3 * i + 3]])}
    assert {tuple(r) for r in found.collect()} == want
    assert found.select(F.spark_partition_id()).distinct().count() >= 4
