"""Differential tests on seeded random digraphs against plain Python."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from codestrata.operators import decouple, graph, modules, rules


def digraph(seed, n=40, p=0.05):
    r = random.Random(seed)
    return n, [(i, j) for i in range(n) for j in range(n) if i != j and r.random() < p]


def frames(spark, n, edges):
    nodes = spark.range(n).select("id")
    return nodes, spark.createDataFrame([(u, v, 1.0, 0, 1, ["depends"]) for u, v in edges], "src long, dst long, weight double, max_level int, n long, kinds array<string>")


def reach(n, edges, start, without=None):
    out = {}
    for u, v in edges:
        out.setdefault(u, []).append(v)
    seen, todo = set(), [start]
    while todo:
        for v in out.get(todo.pop(), []):
            if v not in seen and v != without:
                seen.add(v)
                todo.append(v)
    return seen


def sccs(n, edges):
    far = {i: reach(n, edges, i) for i in range(n)}
    return {i: min([i, *(j for j in far[i] if i in far[j])]) for i in range(n)}


@pytest.mark.parametrize("seed,p", [(1, 0.05), (2, 0.15), (4, 0.02)])
def test_reach_and_components(spark, seed, p):
    n, edges = digraph(seed, p=p)
    nodes, e = frames(spark, n, edges)
    assert {r["id"]: r["component"] for r in graph.components(nodes, e).collect()} == sccs(n, edges)
    assert {r["id"]: r["reach"] for r in graph.reach_counts(nodes, e).collect()} == {i: len(reach(n, edges, i) - {i}) for i in range(n)}


@pytest.mark.parametrize("seed", [3, 5])
def test_dominators(spark, seed):
    n, edges = digraph(seed, 24, 0.09)
    _, e = frames(spark, n, edges)
    got = {(r["root"], r["id"]): r["parent"] for r in graph.immediate_dominators(e, spark.createDataFrame([(0,), (1,)], "id long")).collect()}
    want = {}
    for root in (0, 1):
        for v in reach(n, edges, root) - {root}:
            doms = [d for d in range(n) if d != v and (d == root or (d in reach(n, edges, root) and v not in reach(n, edges, root, without=d)))]
            want[root, v] = max(doms, key=lambda d: -1 if d == root else sum(x != d and (x == root or d not in reach(n, edges, root, without=x)) for x in doms))
    assert got == want


def test_levels_roots_cycles(spark):
    n, edges = digraph(6, 30, 0.08)
    dag = [(u, v) for u, v in edges if u < v]
    nodes, e = frames(spark, n, dag)
    level = {}
    for i in range(n):
        level[i] = max([level[u] + 1 for u, v in dag if v == i], default=0)
    assert {r["id"]: r["level"] for r in graph.topological_levels(nodes, e).collect()} == level
    assert {r["id"] for r in graph.roots(nodes, e).collect()} == {i for i in range(n) if not any(v == i for _, v in dag)}
    assert not graph.has_cycle(nodes, e) and graph.has_cycle(nodes, frames(spark, n, [*dag, (29, 0), (0, 29)])[1])
    assert graph.reach_counts(nodes, e.limit(0)).filter("reach > 0").count() == 0 and graph.components(nodes.limit(0), e.limit(0)).count() == 0


def test_partitioning_changes_nothing(spark):
    n, edges = digraph(7, p=0.06)
    nodes, e = frames(spark, n, edges)
    one = sorted(map(tuple, graph.components(nodes.repartition(1), e.repartition(1)).collect()))
    assert one == sorted(map(tuple, graph.components(nodes.repartition(5), e.repartition(7)).collect()))


def test_representatives_and_folding(spark):
    nodes = spark.createDataFrame([(x,) for x in "ABCDEFGH"], "id string")
    rel = spark.createDataFrame([("B", "A", "inherits", 1), ("C", "A", "inherits", 1), ("D", "B", "implements", 1), ("E", "B", "inherits", 2), ("E", "C", "inherits", 1), ("F", "G", "inherits", 1), ("G", "F", "inherits", 1), ("H", "D", "depends", 1)], "src string, dst string, kind string, line int")
    parent = graph.parents(rel, [F.col("line")])
    assert {r["id"]: r["parent"] for r in parent.collect()} == {"B": "A", "C": "A", "D": "B", "E": "C", "F": "G", "G": "F"}
    rep = lambda mode, **k: {r["id"]: r["rep"] for r in graph.representatives(nodes, parent, mode, **k).collect()}
    assert rep("all") == {"A": "A", "B": "A", "C": "A", "D": "A", "E": "A", "F": "F", "G": "F", "H": "H"}
    assert rep("leaves") == {x: x for x in "ABCDEFGH"}  # B and C have children, D and E have no brother
    more = parent.unionByName(spark.createDataFrame([("H", "A")], "id string, parent string"))
    assert {r["id"]: r["rep"] for r in graph.representatives(nodes, more, "leaves").collect()}["H"] == "A"
    assert {r["id"]: r["rep"] for r in graph.representatives(nodes, more, "leaves", ("H",)).collect()}["H"] == "H"
    folded_nodes, folded = graph.fold(graph.collapse(rel), graph.representatives(nodes, parent, "all"))
    assert {r["id"]: r["members"] for r in folded_nodes.collect()}["A"] == list("ABCDE")
    assert [(r["src"], r["dst"], r["kinds"]) for r in folded.collect()] == [("H", "A", ["depends"])]


def test_crtp_library(spark):
    ents = spark.createDataFrame([(i, "class") for i in range(60)], "id long, kind string")
    rel = spark.createDataFrame([(i, 0, "inherits") for i in range(1, 60)], "src long, dst long, kind string")
    assert graph.style(ents, graph.build_graph(ents, rel)).first()["style"] == "crtp"
    assert graph.crtp_scores(ents, graph.build_graph(ents, rel)).orderBy(F.desc("score")).first()["id"] == 0


def test_labels(spark):
    names = spark.createDataFrame([(1, "X"), (2, "X"), (3, "Y"), (4, "Z")], "id long, name string")
    comp = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 3)], "id long, component long")
    assert {r["component"]: r["label"] for r in graph.labels(comp, names).collect()} == {1: "X", 2: "X#1", 3: "cluster(Y, Z)"}


def test_visible_roots_reach_everything(spark):
    n, edges = digraph(8, 40, 0.04)
    nodes, e = frames(spark, n, edges)
    chosen = {r["id"] for r in graph.visible_roots(nodes, e).collect()}
    assert set().union(chosen, *(reach(n, edges, i) for i in chosen)) == set(range(n))
    few, fe = frames(spark, 5, [(0, 1)])
    assert graph.visible_roots(few, fe).count() == 5


@pytest.mark.parametrize("seed", range(6))
def test_least_cuts_equal_a_search_over_all_cuts(seed):
    r = random.Random(seed)
    edges = [(u, v, float(r.randint(1, 9))) for u in "abcd" for v in "abcd" if u != v and r.random() < 0.6]
    acyclic = lambda es: all(u not in reach_s(es, v) for u, v in es)

    def reach_s(es, start):
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for u, v in es:
                if u == x and v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen

    pairs = [(u, v) for u, v, _ in edges]
    cost = {(u, v): c for u, v, c in edges}
    cut = decouple.least_cuts(edges)
    size = next(k for k in range(len(pairs) + 1) if any(acyclic([e for e in pairs if e not in c]) for c in combinations(pairs, k)))
    assert acyclic([e for e in pairs if e not in cut])
    assert len(cut) == size
    assert sum(cost[e] for e in cut) == min(sum(cost[e] for e in c) for c in combinations(pairs, size) if acyclic([e for e in pairs if e not in c]))


def module_graph(spark, counts):
    rows = [(u, v, k, f"{u}{v}{i}") for (u, v, k), n in counts.items() for i in range(n)]
    refs = spark.createDataFrame(rows, "src string, dst string, kind string, e string")
    names = sorted({x for u, v, _ in counts for x in (u, v)})
    return rules.ModuleGraph(spark.createDataFrame([(x,) for x in names], "id string"), modules.module_edges(refs, F.col("e")))


def test_plans(spark):
    mg = module_graph(spark, {("A", "B", "depends"): 2, ("B", "C", "depends"): 1, ("C", "A", "depends"): 3})
    plan = decouple.plans(mg.nodes, mg.edges).collect()
    assert len(plan) == 1 and [(c["src"], c["dst"]) for c in plan[0]["cuts"]] == [("B", "C")]
    assert plan[0]["order"] == ["B", "A", "C"] and plan[0]["effort"] == 1
    two = module_graph(spark, {("A", "B", "inherits"): 1, ("B", "A", "depends"): 4})
    cut = decouple.cuts(two.nodes, two.edges).first()
    assert (cut["src"], cut["dst"], cut["prescription"]) == ("A", "B", "extract shared base")
    same = module_graph(spark, {("A", "B", "inherits"): 2, ("B", "A", "depends"): 2})
    assert decouple.cuts(same.nodes, same.edges).first()["prescription"] == "dependency inversion"


def test_rules_fire_and_rest(spark):
    god = module_graph(spark, {(x, "H", "depends"): 1 for x in "ABCD"})
    found = rules.audit(god).collect()
    assert [(r["kind"], r["subject"]) for r in found] == [("god_module", ["H"])]
    core = module_graph(spark, {("A", "C", "depends"): 1, ("B", "C", "depends"): 1, ("C", "V", "depends"): 1, ("V", "X", "depends"): 1, ("V", "Y", "depends"): 1})
    assert [r["modules"] for r in rules.audit(core).filter("kind = 'inverted_core'").collect()] == [["C", "V"]]
    ring = module_graph(spark, {("A", "B", "depends"): 1, ("B", "A", "depends"): 1, ("C", "A", "depends"): 1})
    audit = rules.audit(ring)
    assert [r["modules"] for r in audit.collect()] == [["A", "B"]]
    member = spark.createDataFrame([("A", "a1"), ("A", "a2"), ("B", "b"), ("C", "c")], "module string, name string")
    nodes = {r["id"]: r for r in rules.audit_nodes(ring, audit, member).collect()}
    assert nodes["A"]["in_cycle"] and not nodes["C"]["in_cycle"] and nodes["A"]["size"] == 2 and nodes["A"]["in_degree"] == 2
    assert {(r["src"], r["dst"]): r["in_cycle"] for r in rules.audit_edges(ring, audit).collect()} == {("A", "B"): True, ("B", "A"): True, ("C", "A"): False}
    forbid = rules.Rule("F", "forbid_dependency", {"from": "C", "to": "A"})
    assert rules.audit(ring, (forbid, rules.Rule("X", "unknown"))).count() == 1
    assert rules.audit(ring, ()).count() == 0


def test_grouping(spark):
    rows = [("src/a/x.hxx", "N::A::X"), ("src/a/y.hxx", "N::A::Y"), ("src/b/c/z.hxx", "N::B::Z"), ("src/w.hxx", "N::W"), ("src/v.hxx", "V")]
    df = spark.createDataFrame(rows, "file_path string, qualified_name string")
    by = lambda d: {r["qualified_name"]: r["module"] for r in d.collect()}
    assert by(modules.by_folder(df)) == {"N::A::X": "a", "N::A::Y": "a", "N::B::Z": "b/c", "N::W": "(root)", "V": "(root)"}
    assert set(by(modules.by_folder(df.filter("file_path LIKE 'src/a/%'"))).values()) == {"(root)"}
    assert by(modules.by_folder(df.filter("qualified_name = 'N::B::Z'"))) == {"N::B::Z": "src/b/c"}
    assert by(modules.by_namespace(df)) == {"N::A::X": "A", "N::A::Y": "A", "N::B::Z": "B", "N::W": "N", "V": "(root)"}
    assert by(modules.by_groups(df, [("as", ["src/a/*"]), ("late", ["*"])]))["N::A::X"] == "as"
    assert by(modules.by_groups(df, [("zs", ["*Z"])])) == {"N::A::X": "(unassigned)", "N::A::Y": "(unassigned)", "N::B::Z": "zs", "N::W": "(unassigned)", "V": "(unassigned)"}
    assert modules.assign(df, df.limit(0), "auto")[1] == "folder" and modules.assign(df, df.limit(0), "namespace")[1] == "namespace"
    cliques = [(f"{g}{i}", f"{g}{j}") for g in "pq" for i in range(4) for j in range(4) if i < j] + [("p0", "q0")]
    edges = spark.createDataFrame(cliques, "src string, dst string")
    names = spark.createDataFrame([(f"{g}{i}",) for g in "pq" for i in range(4)], "qualified_name string")
    got = by(modules.by_community(names, edges))
    assert len({got[f"p{i}"] for i in range(4)}) == 1 and len({got[f"q{i}"] for i in range(4)}) == 1 and got["p1"] != got["q1"]


def test_plans_look_for_components_once(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", 1, ["depends"], {"depends": 1}, ["x"]), ("b", "a", 2, ["depends"], {"depends": 2}, ["y"])], "src string, dst string, weight long, kinds array<string>, kind_counts map<string,long>, evidence array<string>")
    calls = []
    whole = graph.components
    monkeypatch.setattr(graph, "components", lambda *a: calls.append(a) or whole(*a))
    plan = decouple.plans(spark.createDataFrame([("a",), ("b",)], "id string"), edges).collect()
    assert [(r["members"], r["order"], [(c["src"], c["dst"]) for c in r["cuts"]], r["effort"]) for r in plan] == [(["a", "b"], ["a", "b"], [("a", "b")], 1)]
    assert len(calls) == 1
