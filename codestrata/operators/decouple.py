"""Breaking module cycles at least cost."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.kinds import cut_cost_of
from codestrata.operators import graph, ordering
from codestrata.session import Scratch, dealt

#: Components of at most so many edges are searched for the best cut.
EXACT_EDGES = 12
#: Keys under which the size of a component meets its edges.
SALTS = 32
#: Cut edges that a task gives at a time.
CUT_ROWS = 10_000


def edge_costs(edges: DataFrame) -> DataFrame:
    """Edges with `cost`: references times the price of their kinds; the weight where there are no counts."""
    priced = F.aggregate(F.map_entries("kind_counts"), F.lit(0.0), lambda s, e: s + e["value"] * cut_cost_of(e["key"]))
    return edges.withColumn("cost", F.when(F.size(F.map_keys("kind_counts")) > 0, priced).otherwise(F.col("weight").cast("double")))


def _find_cycle(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The edges of one cycle, found depth-first in sorted order; empty if there is none."""
    out: dict[str, list[str]] = {}
    for u, v in sorted(edges):
        out.setdefault(u, []).append(v)
    state: dict[str, int] = {}
    for start in sorted(out):
        if start in state:
            continue
        path, stack = [start], [iter(out[start])]
        state[start] = 1
        while stack:
            v = next(stack[-1], None)
            if v is None:
                state[path.pop()] = 2
                stack.pop()
            elif state.get(v) == 1:
                ring = path[path.index(v) :]
                return list(zip(ring, [*ring[1:], v]))
            elif v not in state:
                state[v] = 1
                path.append(v)
                stack.append(iter(out.get(v, [])))
    return []


def least_cuts(edges: list[tuple[str, str, float]]) -> list[tuple[str, str]]:
    """The edges to cut so that no cycle is left: of the smallest number that does, the cheapest, ties in order. All cuts are tried, so this is for at most EXACT_EDGES edges."""
    cost = {(u, v): c for u, v, c in edges}
    every = sorted(cost)
    if not _find_cycle(every):
        return []
    for n in range(1, len(every) + 1):
        fits = [(sum(cost[e] for e in cut), cut) for cut in combinations(every, n) if not _find_cycle([e for e in every if e not in cut])]
        if fits:
            return list(min(fits)[1])
    return []


def _within(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges inside components, with `component` and whether it is `large`: of more than EXACT_EDGES edges.

    A component may hold most edges, so those that are large meet them under several keys; the small ones, which may be many, send nothing.
    """
    a, b = comp.select(F.col("id").alias("src"), "component"), comp.select(F.col("id").alias("dst"), F.col("component").alias("__other"))
    inner = edges.filter("src <> dst").join(a, "src").join(b, "dst").filter("component = __other").drop("__other")
    many = inner.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > EXACT_EDGES)
    spread = many.select("component", F.lit(True).alias("large"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salted = inner.withColumn("__salt", F.pmod(F.xxhash64("src", "dst"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["component", "__salt"], "left").withColumn("large", F.coalesce("large", F.lit(False))).drop("__salt")


def _searched(edges: DataFrame) -> DataFrame:
    """(component, src, dst) of the least cuts of small components. Small as they are they may be many, so they are dealt over the tasks, and a task reads one after the other."""
    types = dict(edges.dtypes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def rows():
            for b in batches:
                kinds[:] = [b.column(i).type for i in range(3)]
                yield from zip(*[b.column(i).to_pylist() for i in range(4)])

        cut = ((c, u, v) for c, group in groupby(rows(), key=itemgetter(0)) for u, v in least_cuts([x[1:] for x in group]))
        while some := list(islice(cut, CUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some), kinds)], ["component", "src", "dst"])

    dealt_out = dealt(edges.select("component", "src", "dst", "cost"), "component").sortWithinPartitions("component")
    return dealt_out.mapInArrow(search, ", ".join(f"{c} {types[c]}" for c in ("component", "src", "dst")))


def chosen_cuts(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, src, dst) of the edges to cut, given comp (id, component) and edges (src, dst, cost), one for each pair.

    Components of at most EXACT_EDGES edges are searched, each on its own; the
    larger ones are put in order together and lose the edges that go against it.
    """
    scratch = Scratch(edges.sparkSession, "cuts")
    inner = scratch.write(_within(comp, edges).select("component", "src", "dst", "cost", "large"))

    exact = _searched(inner.filter("NOT large"))
    large, n = scratch.counted(inner.filter("large").select("component", "src", "dst", "cost"))
    if not n:
        return exact
    return exact.unionByName(ordering.against_order(large, ordering.places(large)).select("component", "src", "dst"))


def cuts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, src, dst, weight, cost, kinds, evidence, prescription) of the edges to cut, for every cyclic component on its own."""
    return _cuts_of(Scratch(edges.sparkSession, "cut-components").write(graph.components(nodes, edges)), edges)


def _cuts_of(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """cuts, of the components (id, component) at hand."""
    priced = edge_costs(edges)
    chosen = chosen_cuts(comp, priced.select("src", "dst", "cost"))
    # The two prescriptions.
    by_base = F.size(F.array_except("kinds", F.array(F.lit("inherits"), F.lit("implements")))) == 0
    prescription = F.when(by_base, "extract shared base").otherwise("dependency inversion")
    return chosen.join(priced, ["src", "dst"]).select("component", "src", "dst", "weight", "cost", "kinds", F.slice("evidence", 1, 8).alias("evidence"), prescription.alias("prescription"))


def plans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, members, cuts, order, effort), largest component first: what to cut, the members dependencies first, and the references to change."""
    scratch = Scratch(edges.sparkSession, "plans")
    comp = scratch.write(graph.components(nodes, edges))
    many = comp.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members")).filter("size(members) > 1")
    found = scratch.write(_cuts_of(comp, edges))
    cyclic = comp.join(many.select("component"), "component")
    inner = edges.select("src", "dst").join(cyclic.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(cyclic.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").filter("a = b")
    levels = graph.topological_levels(cyclic.select("id"), inner.select("src", "dst").join(found.select("src", "dst"), ["src", "dst"], "left_anti"))
    order = levels.join(cyclic, "id").groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("l"), "id"))), lambda x: x["id"]).alias("order"))
    cut_list = F.array_sort(F.collect_list(F.struct("src", "dst", "weight", "cost", "prescription")))
    sums = found.groupBy("component").agg(cut_list.alias("cuts"), F.sum("weight").alias("effort"))
    return many.join(sums, "component").join(order, "component").orderBy(F.desc(F.size("members")), "component")
