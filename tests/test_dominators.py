"""Dominator trees and the forest on acyclic graphs, against cutting each node off."""

import random

import pyarrow as pa
import pytest

from codestrata.operators import dominators
from codestrata.session import Scratch
from tests.test_graph import frames, reach


def brute(n, edges, starts):
    """{id: (parent, depth)} for what is reached from the starts together."""
    seen = set(starts).union(*(reach(n, edges, s) for s in starts))
    doms = {}
    for v in seen:
        cut = lambda x: set(starts) - {x} | set().union(*(reach(n, edges, s, without=x) for s in starts if s != x))
        doms[v] = [x for x in seen if x != v and v not in starts and v not in cut(x)]
    return {v: (max(d, key=lambda x: len(doms[x])) if d else None, len(d)) for v, d in doms.items()}


def dag(seed, n, p):
    r = random.Random(seed)
    mixed = list(range(n))
    r.shuffle(mixed)
    return [(mixed[i], mixed[j]) for i in range(n) for j in range(i + 1, n) if j - i < 9 and r.random() < p]


def test_one_tree_for_all_roots_and_the_forest(spark):
    n, edges = 60, dag(3, 60, 0.22)
    _, e = frames(spark, n, edges + edges[:5])
    ends = {v for _, v in edges}
    starts = sorted({u for u, _ in edges} - ends)
    assert len(starts) > 2
    assert {r["id"]: (r["parent"], r["depth"]) for r in dominators.dominator_tree(e).collect()} == brute(n, edges, starts)
    owner, want = {}, {}
    for s in starts:
        below = {s} | reach(n, edges, s)
        tree = brute(n, edges, [s])
        for v in below - set(owner):
            owner[v] = s
            want[v] = (s, *tree[v])
    assert {r["id"]: (r["root"], r["parent"], r["depth"]) for r in dominators.forest(e).collect()} == want
    some = starts[:2]
    reached = spark.createDataFrame([(s, v) for s in some for v in reach(n, edges, s)], "root long, id long")
    got = {(r["root"], r["id"]): (r["parent"], r["depth"]) for r in dominators.trees(e, reached).collect()}
    assert got == {(s, v): x for s in some for v, x in brute(n, edges, [s]).items() if v != s}


def test_names_nulls_and_nothing(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "c"), ("x", "x"), (None, "a"), ("d", None), ("d", "e")], "src string, dst string")
    got = {r["id"]: (r["parent"], r["depth"]) for r in dominators.dominator_tree(e).collect()}
    assert got == {"a": (None, 0), "x": (None, 0), "b": ("a", 1), "c": (None, 0), "d": (None, 0), "e": ("d", 1)}
    assert dominators.dominator_tree(e.limit(0)).count() == 0 and dominators.forest(e.limit(0)).count() == 0


def test_trees_write_each_pair_once(spark, monkeypatch):
    """However long the ways, a pair of a root and a node is written in one level only."""
    made, plain = [], Scratch.write

    def counting(self, df):
        out = plain(self, df)
        made.append(out.count())
        return out

    n, edges = 90, dag(5, 90, 0.4)
    _, e = frames(spark, n, edges)
    starts = sorted({u for u, _ in edges} - {v for _, v in edges})
    pairs = {(s, v): x for s in starts for v, x in brute(n, edges, [s]).items() if v != s}
    reached = spark.createDataFrame(list(pairs), "root long, id long")
    monkeypatch.setattr(Scratch, "write", counting)
    tree = dominators.trees(e, reached)
    monkeypatch.undo()
    assert {(r["root"], r["id"]): (r["parent"], r["depth"]) for r in tree.collect()} == pairs
    assert made[-1] < len(pairs)


def test_roots_are_taken_in_groups(spark, monkeypatch):
    """No pair of a root and a node is written; groups too large for one task give the same trees."""
    made, plain = [], Scratch.write

    def counting(self, df):
        out = plain(self, df)
        made.append(out.count())
        return out

    r = random.Random(7)
    layers = [list(range(100)), list(range(100, 112)), list(range(112, 120)), [120, 121]]
    edges = [(u, v) for a, b in zip(layers, layers[1:]) for u in a for v in r.sample(b, 2)] + [(3, 120), (101, 121)]
    _, e = frames(spark, 122, edges)
    starts = layers[0]
    want = {(s, v): x for s in starts for v, x in brute(122, edges, [s]).items() if v != s}
    monkeypatch.setattr(Scratch, "write", counting)
    tree = dominators.root_trees(e, spark.createDataFrame([(s,) for s in starts], "id long"))
    monkeypatch.undo()
    got = lambda t: {(x["root"], x["id"]): (x["parent"], x["depth"]) for x in t.collect()}
    assert got(tree) == want and max(made) < len(want)
    monkeypatch.setattr(dominators, "LARGE", 20)
    assert got(dominators.root_trees(e, spark.createDataFrame([(s,) for s in starts], "id long"))) == want


@pytest.mark.parametrize("seed", range(4))
def test_grown_side_by_side(seed):
    """Rows of several groups, as a task sees them, with names; a node with many predecessors."""
    n, r = 40, random.Random(seed)
    edges = [*{*dag(seed, n, 0.3), *((u, "last") for u in range(n))}]
    name = lambda v: f"n{v}"
    level = {}
    for _ in range(n + 1):
        for u, v in edges:
            level[v] = max(level.get(v, 0), level.get(u, 0) + 1)
    rows, want = [], {}
    for group in (5, 9):
        roots = r.sample(range(n), 3)
        seen = set(roots).union(*(reach(n, edges, s) for s in roots))
        rows += [(group, name(u), name(v), level[v]) for u, v in edges if u in seen] + [(group, name(s), name(s), -1) for s in roots]
        want |= {(group, name(s), name(v)): (name(p), k) for s in roots for v, (p, k) in brute(n, edges, [s]).items() if v != s}
    for group in (5, 9):
        table = pa.table(dict(zip(("group", "src", "dst", "level"), zip(*[x for x in rows if x[0] == group]))))
        got = [x for b in dominators._trees_of(table) for x in b.to_pylist()]
        assert {(group, x["root"], x["id"]): (x["parent"], x["depth"]) for x in got} == {k: x for k, x in want.items() if k[0] == group}
    both = pa.table(dict(zip(("group", "src", "dst", "level"), zip(*rows))))
    got = [(x["root"], x["id"], x["parent"], x["depth"]) for b in dominators._trees_of(both) for x in b.to_pylist()]
    assert sorted(got) == sorted((s, v, p, k) for (_, s, v), (p, k) in want.items())
