"""Communities by modularity against sums made by hand."""

import random
from itertools import combinations

from codestrata.operators import communities as C
from codestrata.operators import modules


def frames(spark, ids, edges):
    return spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(edges, "src string, dst string")


def by_hand(edges, of):
    pairs = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    m, degree = len(pairs), {}
    for e in pairs:
        for x in e:
            degree[of[x]] = degree.get(of[x], 0) + 1
    return sum(of[a] == of[b] for a, b in pairs) / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def planted_groups():
    r = random.Random(3)
    ids = [f"n{i:03d}" for i in range(120)]
    edges = [(a, b) if r.random() < 0.5 else (b, a) for (i, a), (j, b) in combinations(enumerate(ids), 2) if r.random() < (0.4 if i % 6 == j % 6 else 0.01)]
    return ids, edges


def test_planted_groups_are_found_and_no_union_gains(spark):
    ids, edges = planted_groups()
    n, e = frames(spark, ids, edges + edges[:5] + [("n000", "n000"), ("n000", None), ("gone", "n001")])
    of = {r["id"]: r["community"] for r in C.communities(n.unionByName(n), e).collect()}
    assert of == {x: f"n{int(x[1:]) % 6:03d}" for x in ids}  # the smallest member names a community, repeated and open edges change nothing
    value = by_hand(edges, of)
    for a, b in combinations(set(of.values()), 2):
        assert by_hand(edges, {x: a if c == b else c for x, c in of.items()}) <= value
    got = C.modularity(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(list(of.items()), "id string, community string")).first()
    assert got["communities"] == 6 and got["edges"] == len(edges) and abs(got["modularity"] - value) < 1e-12


def test_no_worse_than_labels(spark):
    """Random edges, where groups are weak: modularity is at least that of label propagation, and no single node of the last level gains by a move."""
    r = random.Random(7)
    ids = [f"n{i:02d}" for i in range(40)]
    edges = sorted({tuple(sorted(r.sample(ids, 2))) for _ in range(90)})
    n, e = frames(spark, ids, edges)
    of = {x["id"]: x["community"] for x in C.communities(n, e).collect()}
    labels = {x["qualified_name"]: x["module"] for x in modules.by_community(n.withColumnRenamed("id", "qualified_name"), e).collect()}
    assert by_hand(edges, of) >= by_hand(edges, labels)
    assert by_hand(edges, of) > 0.3


def test_moves_made_together_gain(spark):
    """In each round the sum of what moves gain is at least the bound that let them pass, so modularity never falls."""
    ids, edges = planted_groups()
    n, e = frames(spark, ids, edges)
    both, of = C.undirected(e), {x: x for x in ids}
    twice = 2 * len(edges)
    heavy = both.join(both.groupBy("src").agg({"w": "sum"}).withColumnRenamed("sum(w)", "k"), "src").select("src", "k", "dst", "w").cache()
    degree = {r["src"]: r["k"] for r in heavy.select("src", "k").distinct().collect()}
    for turn in range(3):
        label = spark.createDataFrame([(x, degree[x], c) for x, c in of.items()], "id string, k long, label string")
        wish = C._wishes(heavy, label, twice).cache()
        for r in wish.collect():  # the gain stated is the gain made
            assert abs(by_hand(edges, of | {r["id"]: r["target"]}) - by_hand(edges, of) - 2 * float(r["gain"]) / twice**2) < 1e-12
        moves = {r["id"]: r["target"] for r in C._together(wish, turn, 0, twice).collect()}
        single = {r["id"]: r["target"] for r in C._singly(wish).collect()}
        assert single and by_hand(edges, of | single) > by_hand(edges, of)
        touched = [c for x, t in single.items() for c in (of[x], t)]
        assert len(touched) == len(set(touched))
        moves = moves or single
        assert by_hand(edges, of | moves) > by_hand(edges, of)
        of |= moves


def test_defined_results(spark):
    n, e = frames(spark, ["a", "b", "c"], [("a", "a"), (None, "a")])
    assert {tuple(r) for r in C.communities(n, e).collect()} == {(x, x) for x in "abc"}
    assert C.communities(n.limit(0), e).count() == 0
    none = C.modularity(e, n.selectExpr("id", "id AS community")).first()
    assert (none["communities"], none["edges"], none["modularity"]) == (3, 0, 0.0)
    star = [("hub", f"x{i}") for i in range(9)]
    names = spark.createDataFrame([("hub",), ("lone",), *[(f"x{i}",) for i in range(9)]], "qualified_name string")
    got = {r["qualified_name"]: r["module"] for r in modules.assign(names, spark.createDataFrame(star, "src string, dst string"), "community")[0].collect()}
    assert got["lone"] == "cluster:lone" and {m for x, m in got.items() if x != "lone"} == {"cluster:hub"}


def test_tables_of_a_row_a_node_are_not_broadcast(spark):
    """In a round, what has a row a node is joined by merging, however small, so it does not pass through the driver."""
    label = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "id long, k long, label long")
    both = spark.createDataFrame([(1, 1, 2, 1), (2, 1, 1, 1)], "src long, k long, dst long, w long")
    wish = C._wishes(both, label, 2)
    plan = wish._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan, plan
    assert len(wish.collect()) == 2
    assert "strategy=merge" in C._singly(wish)._jdf.queryExecution().optimizedPlan().toString()
