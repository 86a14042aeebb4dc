"""Condensing a directed graph: chains, strongly connected components, levels, cycles.

Nodes without an edge in or out are peeled off while that removes a good part of the
edges; when it no longer does, chains (nodes joined by an edge that is the only one out
of its start and the only one into its end) are contracted to one node by pointer
jumping, which halves the way each round; what is left is coloured. So a path of any
length takes a logarithmic number of rounds. Each round is written to the shared folder.
A graph, or what a round leaves of it, of few edges (REST) is done by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import Scratch

#: Peeling or contracting goes on while a round takes away one edge in so many.
WORTH = 10
#: Steps that one job makes, where a step uses the one before once.
STRIDE = 4
#: Components among so many edges or fewer are found by one task, by depth-first search in some 100 MB.
REST = 200_000


def simple_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without loops and nulls."""
    return edges.filter("src <> dst").select("src", "dst").distinct()


def chains(edges: DataFrame, scratch: Scratch, least: int = 1, weights: DataFrame | None = None) -> DataFrame | None:
    """(id, head, place) of the nodes in chains of two or more: the chain's first node and how many come before; None if fewer than `least` edges link chains.

    With `weights` (id, w), place is the weight of the nodes before. A ring (a cycle
    that nothing enters or leaves) has its smallest node as head, and no defined places.
    `edges` are distinct and without loops.
    """
    one_out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst")).filter("n = 1")
    one_in = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("src")).filter("n = 1")
    links, n = scratch.counted(one_out.select("src", "dst").join(one_in.select("src", "dst"), ["src", "dst"]))
    if n < max(least, 1):
        return None
    step = links.withColumn("w", F.lit(1)) if weights is None else links.join(weights.select(F.col("id").alias("src"), "w"), "src")
    inner = links.select(F.col("dst").alias("src"), F.lit(True).alias("open"))
    first = step.join(inner, "src", "left").select(F.col("dst").alias("id"), F.col("src").alias("up"), F.col("w").cast("long").alias("place"), F.least("src", "dst").alias("low"), F.coalesce("open", F.lit(False)).alias("open"), F.lit(True).alias("lower"))
    table, n = scratch.counted(first, F.col("open"))
    while n:
        far = table.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("place").alias("far_place"), F.col("low").alias("far_low"), F.col("open").alias("far_open"))
        jumped = table.filter("open").join(far, "up").select("id", F.col("far").alias("up"), (F.col("place") + F.col("far_place")).alias("place"), F.least("low", "far_low").alias("low"), F.col("far_open").alias("open"), (F.col("far_low") < F.col("low")).alias("lower"))
        before = n
        table, n = scratch.counted(table.filter("NOT open").unionByName(jumped), F.col("open"))
        if n == before and table.filter("open AND lower").isEmpty():  # only rings are left, and all know their smallest node
            break
    members = table.select("id", F.when(F.col("open"), F.col("low")).otherwise(F.col("up")).alias("head"), F.when(F.col("open"), 0).otherwise(F.col("place")).cast("long").alias("place"))
    heads = table.filter("NOT open").select(F.col("up").alias("id"), F.col("up").alias("head"), F.lit(0).cast("long").alias("place")).distinct()
    return scratch.write(members.unionByName(heads))


def contracted(edges: DataFrame, chain: DataFrame) -> DataFrame:
    """(src, dst, closes) with each node of a chain replaced by its head; `closes` marks the edge that makes a chain a cycle, the chains' own links are gone."""
    a = chain.select(F.col("id").alias("src"), F.col("head").alias("a"))
    b = chain.select(F.col("id").alias("dst"), F.col("head").alias("b"))
    both = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b"), "dst")
    # Within a chain only its head has an edge that is no link.
    kept = both.filter((F.col("a") != F.col("b")) | (F.col("dst") == F.col("b")))
    return kept.select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("a") == F.col("b")).alias("closes")).distinct()


def _peeled(left: DataFrame, n: int, scratch: Scratch, to_the_end: bool = False) -> tuple[DataFrame, int]:
    """Edges whose start has an edge in and whose end has an edge out, again and again while it is worth it.

    A step keeps the nodes that have a kept node before and one behind them; it uses the
    step before once, so one job makes several.
    """
    while n:
        sides = left.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(True).alias("leaves")).unionByName(left.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(False).alias("leaves")))
        kept = None
        for _ in range(STRIDE):
            seen = sides if kept is None else sides.join(kept.withColumnRenamed("id", "other"), "other")
            kept = seen.groupBy("id").agg(F.bool_or("leaves").alias("o"), F.bool_or(~F.col("leaves")).alias("i")).filter("o AND i").select("id")
        kept = scratch.write(kept)
        before = n
        left, n = scratch.counted(left.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
        if n == before or (not to_the_end and (before - n) * WORTH < before):
            break
    return left, n


def strong(n: int, src: list[int], dst: list[int]) -> list[tuple[int, int]]:
    """(node, label) of the nodes 0 to n - 1 in strongly connected components of two or more, each labelled by one of its nodes: Tarjan's search with a stack of its own."""
    out: list[list[int]] = [[] for _ in range(n)]
    for u, v in zip(src, dst):
        out[u].append(v)
    order, low, open_ = [0] * n, [0] * n, [False] * n
    found, stack, seen = [], [], 0
    for start in range(n):
        if order[start]:
            continue
        seen += 1
        order[start] = low[start] = seen
        open_[start] = True
        stack.append(start)
        way = [(start, iter(out[start]))]
        while way:
            u, rest = way[-1]
            for v in rest:
                if not order[v]:
                    seen += 1
                    order[v] = low[v] = seen
                    open_[v] = True
                    stack.append(v)
                    way.append((v, iter(out[v])))
                    break
                if open_[v] and order[v] < low[u]:
                    low[u] = order[v]
            else:
                way.pop()
                if way and low[u] < low[way[-1][0]]:
                    low[way[-1][0]] = low[u]
                if low[u] == order[u]:
                    several = stack[-1] != u
                    while True:
                        v = stack.pop()
                        open_[v] = False
                        if several:
                            found.append((v, u))
                        if v == u:
                            break
    return found


def _strong_in_one_task(edges: DataFrame) -> DataFrame:
    """(id, label) of the nodes in components of two or more of a graph of few edges (src, dst)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        m = sum(b.num_rows for b in got)
        names = pa.concat_arrays([b.column(i) for i in (0, 1) for b in got]).dictionary_encode()
        code = names.indices.to_pylist()
        found = strong(len(names.dictionary), code[:m], code[m:])
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array([x[i] for x in found], pa.int64())) for i in (0, 1)], ["id", "label"])

    kind = dict(edges.dtypes)["src"]
    return edges.select("src", "dst").repartition(1).mapInArrow(search, f"id {kind}, label {kind}")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): strongly connected components, named by their smallest member.

    What has few edges is searched by one task. Else, after peeling and contracting, every node takes the first by hash of those that
    reach it, all of them pivots at once; the nodes of a colour that reach its pivot back
    are a component. Repeat with the edges within colours that are left.
    """
    scratch = Scratch(edges.sparkSession, "components")
    left, n = scratch.counted(simple_edges(edges))
    folds: list[DataFrame] = []  # (id, head), the first contraction first
    found: list[list[DataFrame]] = [[]]  # (id, label) found among the nodes after so many contractions, the widest first
    while n:
        if n > REST:
            left, n = _peeled(left, n, scratch)
        if not n:
            break
        if n <= REST:
            found[-1].insert(0, scratch.write(_strong_in_one_task(left)))
            break
        chain = chains(left, scratch, -(-n // WORTH))
        if chain is not None:
            mapped = scratch.write(contracted(left, chain))
            folds.append(chain.select("id", "head"))
            found.append([mapped.filter("closes").select(F.col("src").alias("id"), F.col("src").alias("label")).distinct()])
            left, n = scratch.counted(mapped.filter("NOT closes").select("src", "dst"))
            continue
        colour = _spread(left, scratch)
        both = left.join(colour.withColumnRenamed("id", "src").withColumnRenamed("colour", "a"), "src").join(colour.withColumnRenamed("id", "dst").withColumnRenamed("colour", "b"), "dst")
        same = scratch.write(both.filter("a = b").select("src", "dst", F.col("a").alias("colour")))
        back = _reaching_back(same, scratch, colour)
        # A pivot that nothing else reaches back is done, but no component: it may stand for a chain, which is none.
        several = back.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("colour")
        found[-1].insert(0, back.join(several, "colour", "left_semi").select("id", F.col("colour").alias("label")))
        # A component has one colour, so edges between colours go, too, and the rest falls into parts.
        gone = back.select("id")
        left, n = scratch.counted(same.select("src", "dst").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    # From the outermost nodes to their members: the widest component that holds a node is its component.
    label = None
    for level in range(len(folds), -1, -1):
        for part in found[level]:
            label = part if label is None else label.unionByName(part.join(label.select("id"), "id", "left_anti"))
        if label is not None:
            label = scratch.write(label)
            if level:
                inside = folds[level - 1]
                label = inside.join(label.withColumnRenamed("id", "head"), "head").select("id", "label").unionByName(label.join(inside.select("id"), "id", "left_anti"))
    every = nodes.select("id").distinct()
    if label is None:
        return every.withColumn("component", F.col("id"))
    least = label.groupBy("label").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return every.join(label.join(least, "label").select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _and_self(edges: DataFrame) -> DataFrame:
    """Edges (src, dst), and each of their nodes as an edge to itself: so a step over them keeps what was known, and uses the step before once."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return edges.select("src", "dst").unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst")))


def _spread(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, colour): of the nodes from which each node can be reached, itself included, the one first by hash, so that no order of ids makes one colour of all."""
    steps = scratch.write(_and_self(edges))
    colour = steps.filter("src = dst").select(F.col("src").alias("id"), F.struct(F.xxhash64("src").alias("h"), F.col("src").alias("id")).alias("colour"))
    while True:
        for _ in range(STRIDE):
            offered = steps.join(colour.withColumnRenamed("id", "src"), "src")
            found = offered.groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("colour"), F.min(F.when(F.col("src") == F.col("dst"), F.col("colour"))).alias("before"))
            colour = found.select("id", "colour")
        found, n = scratch.counted(found, F.col("colour") < F.col("before"))
        colour = found.select("id", "colour")
        if not n:
            return found.select("id", F.col("colour.id").alias("colour"))


def _reaching_back(edges: DataFrame, scratch: Scratch, named: DataFrame) -> DataFrame:
    """(id, colour) for the nodes that reach the node named by their colour (id, colour) along edges (src, dst) of that colour; a pivot without such edges is a component of its own and left out."""
    steps, n = scratch.write(_and_self(edges)), -1
    known = steps.filter("src = dst").select(F.col("src").alias("id")).join(named.filter("id = colour").select("id"), "id", "left_semi")
    while True:
        for _ in range(STRIDE):
            known = steps.join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        before = n
        known, n = scratch.counted(known)
        if n == before:
            return known.join(named, "id")


def condensed_edges(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight, n) between components: the largest weight, the number of collapsed edges."""
    weighted = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    both = weighted.join(comp.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(comp.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
    return both.filter("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) of an acyclic graph: the longest path from a node without incoming edges. Nodes on or behind cycles are left out.

    Chains are one node of their length. A round places the nodes all of whose edges in
    come from placed ones; its rows are a file set of their own, read together at the end.
    """
    spark = edges.sparkSession
    scratch, out = Scratch(spark, "levels"), Scratch(spark, "levels-placed")
    left, n = scratch.counted(simple_edges(edges))
    chain = chains(left, scratch, -(-n // WORTH)) if n else None
    ids = nodes.select("id").distinct()
    if chain is None:
        left = left.select("src", "dst", F.lit(1).cast("long").alias("length"), F.lit(None).cast("long").alias("at"))
    else:
        mapped = scratch.write(contracted(left, chain))
        length = chain.groupBy(F.col("head").alias("src")).agg((F.max("place") + 1).alias("length"))
        left = mapped.join(length, "src", "left").select("src", "dst", F.coalesce("length", F.lit(1)).cast("long").alias("length"), F.lit(None).cast("long").alias("at"))
        ids = ids.join(chain.filter("id <> head").select("id"), "id", "left_anti")
    left = scratch.write(left)
    placed, n = out.counted(ids.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(0).cast("long")))
    while n:
        known = left.join(placed.withColumnRenamed("id", "src"), "src", "left").select("src", "dst", "length", F.coalesce("at", F.col("level") + F.col("length")).alias("at"))
        ready = known.groupBy(F.col("dst").alias("id")).agg(F.max("at").alias("level"), F.count_if(F.col("at").isNull()).alias("open")).filter("open = 0").select("id", "level")
        placed, n = out.counted(ready)
        left = scratch.write(known.join(placed.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "length", "at"))
    found = spark.read.schema(placed.schema).parquet(*out.paths)
    if chain is not None:
        inside = chain.filter("id <> head").join(found.withColumnRenamed("id", "head"), "head").select("id", (F.col("level") + F.col("place")).alias("level"))
        found = found.unionByName(inside)
    return found.select("id", F.col("level").cast("int").alias("level"))


def has_cycle(nodes: DataFrame, edges: DataFrame) -> bool:
    """Whether there is a cycle, loops among them; peeling and contracting decide it, components are not looked for."""
    if not edges.filter("src = dst").isEmpty():
        return True
    scratch = Scratch(edges.sparkSession, "acyclic")
    left, n = scratch.counted(simple_edges(edges))
    while n:
        left, n = _peeled(left, n, scratch)
        chain = chains(left, scratch, -(-n // WORTH)) if n else None
        if chain is None:
            return _peeled(left, n, scratch, to_the_end=True)[1] > 0
        mapped = scratch.write(contracted(left, chain))
        if not mapped.filter("closes").isEmpty():
            return True
        left, n = scratch.counted(mapped.select("src", "dst"))
    return False


def find_cycle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, id): the nodes of one cycle in their order, from its smallest; no rows in an acyclic graph.

    A loop is a cycle of one. Else, in the smallest component of several nodes, each node
    goes to its smallest successor there: following these from anywhere ends in a cycle,
    found by squaring the map; the cycle is cut at its smallest node and is a chain then.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "cycle")
    loop = edges.filter("src = dst").agg(F.min("src").alias("id")).first()["id"]
    if loop is not None:
        return edges.filter(F.col("src") == F.lit(loop)).select(F.lit(0).cast("long").alias("place"), F.col("src").alias("id")).distinct()
    comp = scratch.write(components(nodes, edges))
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.min(F.struct("n", "component")).alias("m")).first()["m"]
    if size is None:
        return comp.limit(0).select(F.lit(0).cast("long").alias("place"), "id")
    inside = comp.filter(F.col("component") == F.lit(size["component"])).select("id")
    inner = simple_edges(edges).join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi")
    to = scratch.write(inner.groupBy("src").agg(F.min("dst").alias("dst")))
    far = to
    for _ in range((size["n"] - 1).bit_length()):
        far = scratch.write(far.join(far.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst")))
    on = far.select(F.col("dst").alias("id")).distinct()
    start = on.agg(F.min("id").alias("id")).first()["id"]
    ring = scratch.write(to.join(on.withColumnRenamed("id", "src"), "src", "left_semi").filter(F.col("dst") != F.lit(start)))
    return chains(ring, scratch).filter(F.col("head") == F.lit(start)).select("place", "id")
