"""The weighted class graph and what is derived from it, as DataFrame programs.

A graph is an edge table (src, dst, ...) with any orderable node ids, and a node
table. Loops are semi-naive: each round joins only what the last round found, and
is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.kinds import STRUCTURAL, kinds_by_strength, level_of, primary_kind, weight_of
from codestrata.operators.condense import components, condensed_edges, find_cycle, has_cycle, topological_levels
from codestrata.operators.reach import reach_counts
from codestrata.session import Scratch

__all__ = ["components", "condensed_edges", "find_cycle", "has_cycle", "reach_counts", "topological_levels"]

IS_A = ("inherits", "implements")


# -- edges and degrees ---------------------------------------------------------
def internal_edges(relationships: DataFrame, nodes: DataFrame, node: str = "id") -> DataFrame:
    """Relationships (src, dst, ...) with both ends among the nodes, without self-loops."""
    ids = nodes.select(F.col(node).alias("__n"))
    found = relationships.filter("dst IS NOT NULL AND src <> dst")
    return found.join(ids, F.col("src") == F.col("__n"), "left_semi").join(ids, F.col("dst") == F.col("__n"), "left_semi")


def collapse(relationships: DataFrame) -> DataFrame:
    """One edge for each pair: the largest weight, the highest level, the sorted kinds, the number of references."""
    per = relationships.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("src", "dst").agg(
        F.max(weight_of(F.col("kind"))).alias("weight"), F.max(level_of(F.col("kind"))).alias("max_level"), F.sum("n").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds")
    )


def build_graph(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Collapsed edges between the entities; pairs meet the entities, not each of their relationships."""
    return internal_edges(collapse(relationships.filter("dst IS NOT NULL AND src <> dst")), entities)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_w, in_w, out_n, in_n), 0 for nodes without edges; one aggregation of both directions."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), "weight"), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), "weight"))).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(
        F.sum(F.col("weight") * F.col("o")).alias("out_w"), F.sum(F.col("weight") * F.col("i")).alias("in_w"), F.sum("o").alias("out_n"), F.sum("i").alias("in_n")
    )
    return nodes.select("id").join(sums, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("out_w", "double"), ("in_w", "double"), ("out_n", "long"), ("in_n", "long"))])


def is_utility() -> Column:
    """Used by two or more and using nothing."""
    return (F.col("in_n") >= 2) & (F.col("out_n") == 0)


# -- reachability --------------------------------------------------------------
def reach_pairs(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """All (src, dst) with a path of one edge or more; from the given sources (src) only, if given.

    Each round follows one edge from the pairs found last and drops those known.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    step = scratch.write(edges.select("src", "dst").distinct())
    start = step if sources is None else step.join(sources.select("src"), "src", "left_semi")
    delta, n = scratch.counted(start)
    found = [delta]
    hop = step.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    while n:
        known = found[0]
        for f in found[1:]:
            known = known.unionByName(f)
        grown = delta.join(hop, "dst").select("src", F.col("next").alias("dst")).distinct()
        delta, n = scratch.counted(grown.join(known, ["src", "dst"], "left_anti"))
        found.append(delta)
        if len(found) > 8:
            found = [scratch.write(known.unionByName(delta))]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# -- the condensed graph ----------------------------------------------------------
def labels(comp: DataFrame, names: DataFrame) -> DataFrame:
    """(component, label, members): a single node's name, or `cluster(A, B)` of the first two; equal labels get #1, #2, ... in order."""
    named = comp.join(names.select("id", "name"), "id").groupBy("component").agg(F.array_sort(F.collect_list("name")).alias("members"))
    base = F.when(F.size("members") == 1, F.get("members", F.lit(0))).otherwise(F.concat(F.lit("cluster("), F.array_join(F.slice("members", 1, 2), ", "), F.lit(")")))
    k = F.row_number().over(Window.partitionBy("base").orderBy("component")) - 1
    return named.withColumn("base", base).withColumn("k", k).select("component", F.when(F.col("k") > 0, F.concat("base", F.lit("#"), "k")).otherwise(F.col("base")).alias("label"), "members")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return nodes.select("id").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def roots_by_reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, reach, place): nodes without an incoming edge, those that reach most others first."""
    found = roots(nodes, edges).join(reach_counts(nodes, edges), "id")
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("reach"), "id")).cast("long"))


# -- scores and style ----------------------------------------------------------
def oop_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_w, in_w, reach, score): out + 0.5 reach - 0.8 in."""
    return degrees(nodes, edges).join(reach_counts(nodes, edges), "id").select("id", "out_w", "in_w", "reach", (F.col("out_w") + 0.5 * F.col("reach") - 0.8 * F.col("in_w")).alias("score"))


def crtp_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_w, in_w, reach, score): in + 0.5 reverse reach - 0.8 out."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return degrees(nodes, edges).join(reach_counts(nodes, turned), "id").select("id", "out_w", "in_w", "reach", (F.col("in_w") + 0.5 * F.col("reach") - 0.8 * F.col("out_w")).alias("score"))


def style(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: classes, abstractions (interfaces and abstract classes), is-a edges, ratio, style."""
    abstract = (F.col("kind") == "interface") | F.coalesce(F.col("abstract"), F.lit(False)) if "abstract" in entities.columns else F.col("kind") == "interface"
    e = entities.filter(F.col("kind").isin("class", "struct", "interface")).agg(F.count(F.lit(1)).alias("classes"), F.count_if(abstract).alias("abstractions"))
    r = edges.agg(F.count_if(F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in IS_A]))).alias("is_a"))
    both = e.join(F.broadcast(r), how="cross")  # one row each
    ratio = F.coalesce(F.col("abstractions") / F.nullif("classes", F.lit(0)), F.lit(0.0))
    named = F.when((F.col("classes") < 50) | (F.col("is_a") < 20), "oop").when(ratio < 0.02, "crtp").when(ratio < 0.05, "mixed").otherwise("oop")
    return both.select("classes", "abstractions", "is_a", ratio.cast("double").alias("ratio"), named.alias("style"))


# -- folding -------------------------------------------------------------------
def parents(relationships: DataFrame, order: list[Column]) -> DataFrame:
    """(id, parent): the first is-a target of each node in the given order."""
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("dst").alias("parent")))
    return relationships.filter(F.col("kind").isin(*IS_A)).groupBy(F.col("src").alias("id")).agg(first.alias("m")).select("id", "m.parent")


def families(parent: DataFrame) -> DataFrame:
    """(parent, children) of bases with two children or more."""
    return parent.groupBy("parent").agg(F.count(F.lit(1)).alias("children")).filter("children >= 2")


def representatives(nodes: DataFrame, parent: DataFrame, mode: str = "leaves", protect: tuple = ()) -> DataFrame:
    """(id, rep): `none` keeps nodes apart; `leaves` folds leaf children of families into their base; `all` folds into the topmost base."""
    ids = nodes.select("id")
    if mode == "none":
        return ids.withColumn("rep", F.col("id"))
    if mode == "leaves":
        bases = parent.select(F.col("parent").alias("id")).distinct()
        leaf = parent.join(bases, "id", "left_anti").join(families(parent).select("parent"), "parent", "left_semi")
        leaf = leaf.filter(~F.col("id").isin(list(protect))) if protect else leaf
        return ids.join(leaf, "id", "left").select("id", F.coalesce("parent", "id").alias("rep"))
    # Pointer jumping: each round doubles the height looked up. A cycle ends at its smallest member.
    scratch = Scratch(nodes.sparkSession, "representatives")
    comp = components(ids, parent.select(F.col("id").alias("src"), F.col("parent").alias("dst")))
    up = parent.join(comp.withColumnRenamed("component", "a"), "id").join(comp.select(F.col("id").alias("parent"), F.col("component").alias("b")), "parent")
    step = ids.join(up.select("id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("parent")).alias("rep")), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    on_cycle = up.filter("a = b").select(F.col("a").alias("id")).distinct().withColumn("stop", F.lit(True))
    step = scratch.write(step.join(on_cycle, "id", "left").select("id", F.when(F.col("stop"), F.col("id")).otherwise(F.col("rep")).alias("rep")))
    while True:
        far = step.select(F.col("id").alias("rep"), F.col("rep").alias("far"))
        jumped, n = scratch.counted(step.join(far, "rep", "left").select("id", F.coalesce("far", "rep").alias("rep"), F.coalesce(F.col("far") != F.col("rep"), F.lit(False)).alias("moved")), F.col("moved"))
        step = jumped.select("id", "rep")
        if not n:
            return step


def fold(edges: DataFrame, rep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with each node replaced by its representative: nodes (id, members), edges (src, dst, weight, max_level, n, kinds)."""
    nodes = rep.groupBy(F.col("rep").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("members"))
    both = edges.join(rep.select(F.col("id").alias("src"), F.col("rep").alias("a")), "src").join(rep.select(F.col("id").alias("dst"), F.col("rep").alias("b")), "dst").filter("a <> b")
    folded = both.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(
        F.max("weight").alias("weight"), F.max("max_level").alias("max_level"), F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds")
    )
    return nodes, folded


# -- order and dominators ------------------------------------------------------
def dominators(edges: DataFrame, root_ids: DataFrame) -> DataFrame:
    """(root, id, dominator): all strict dominators of each node reached from each root, the root among them.

    A strict dominator of a node is, or dominates, every predecessor of it; the sets
    are the greatest fixpoint of that rule. From all candidates, rows that break it
    are taken away until none does; each round is two joins and a count, for all
    roots at once.
    """
    scratch = Scratch(edges.sparkSession, "dominators")
    starts = root_ids.select(F.col("id").alias("src")).distinct()
    inside = scratch.write(reach_pairs(edges, starts).select(F.col("src").alias("root"), F.col("dst").alias("id")).filter("root <> id"))
    within = inside.unionByName(inside.select("root", F.col("root").alias("id")).distinct()).distinct()
    step = edges.filter("src <> dst").select("src", "dst").distinct()
    used = within.select("root", F.col("id").alias("src")).join(step, "src").join(inside.select("root", F.col("id").alias("dst")), ["root", "dst"])
    used = scratch.write(used.select("root", "src", "dst"))
    fan = scratch.write(used.groupBy("root", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")))
    # Candidates: what is reached from the root and reaches the node.
    far = reach_pairs(used.select(F.struct("root", F.col("src").alias("n")).alias("src"), F.struct("root", F.col("dst").alias("n")).alias("dst")))
    dom, size = scratch.counted(far.select(F.col("src.root").alias("root"), F.col("dst.n").alias("id"), F.col("src.n").alias("dominator")).filter("id <> dominator AND id <> root"))
    while True:
        own = dom.unionByName(inside.select("root", "id", F.col("id").alias("dominator"))).unionByName(inside.select("root", F.col("root").alias("id"), F.col("root").alias("dominator")).distinct())
        votes = used.join(own.withColumnRenamed("id", "src"), ["root", "src"]).groupBy("root", F.col("dst").alias("id"), "dominator").agg(F.count(F.lit(1)).alias("votes"))
        dom, n = scratch.counted(dom.join(votes, ["root", "id", "dominator"]).join(fan, ["root", "id"]).filter("votes = n").select("root", "id", "dominator"))
        if n == size:
            return dom
        size = n


def immediate_dominators(edges: DataFrame, root_ids: DataFrame) -> DataFrame:
    """(root, id, parent): the dominator tree, the dominator that has most dominators itself."""
    dom = dominators(edges, root_ids)
    depth = dom.groupBy("root", F.col("id").alias("dominator")).agg(F.count(F.lit(1)).alias("depth"))
    ranked = dom.join(depth, ["root", "dominator"], "left").groupBy("root", "id").agg(F.max(F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), "dominator")).alias("m"))
    return ranked.select("root", "id", F.col("m.dominator").alias("parent"))


# -- neighbourhoods ------------------------------------------------------------
def ego(edges: DataFrame, node) -> DataFrame:
    """(side, relation, id): bases and users above a node, subclasses and what it uses below."""
    is_a = F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in IS_A]))
    other = F.exists("kinds", lambda k: ~k.isin(*IS_A))
    out, into = edges.filter(F.col("src") == F.lit(node)), edges.filter(F.col("dst") == F.lit(node))
    part = lambda e, when, side, relation, end: e.filter(when).select(F.lit(side).alias("side"), F.lit(relation).alias("relation"), F.col(end).alias("id"))
    return part(out, is_a, "above", "base", "dst").unionByName(part(into, other, "above", "user", "src")).unionByName(part(into, is_a, "below", "subclass", "src")).unionByName(part(out, other, "below", "used", "dst"))


def pair_edges(relationships: DataFrame) -> DataFrame:
    """One row for each ordered pair: the primary kind, all kinds strongest first, level, whether structural, and the ordered evidence lines."""
    kinds = kinds_by_strength(F.collect_set("kind"))
    out = relationships.groupBy("src", "dst").agg(kinds.alias("kinds"), F.max(level_of(F.col("kind"))).alias("level"), F.array_sort(F.collect_list(F.struct("kind", "evidence_line"))).alias("evidence"))
    return out.withColumn("primary_kind", primary_kind(F.col("kinds"))).withColumn("structural", F.exists("kinds", lambda k: k.isin(*STRUCTURAL)))


def visible_roots(nodes: DataFrame, edges: DataFrame, limit: int = 25) -> DataFrame:
    """(id): nodes to show first. All where there are few; else those without incoming edges, and for each part that these do not reach one node after another, that with most outgoing edges (ties to the smaller id), until all is reached.

    A part without a source is entered through its own source components, so all can be chosen at once: one for each component of the condensed graph without incoming edges.
    """
    if nodes.count() <= limit:
        return nodes.select("id")
    comp = Scratch(nodes.sparkSession, "visible").write(components(nodes, edges))
    first = roots(comp.select(F.col("component").alias("id")).distinct(), condensed_edges(comp, edges))
    out_n = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    members = comp.join(first.withColumnRenamed("id", "component"), "component").join(out_n, "id", "left")
    return members.groupBy("component").agg(F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "id")).alias("m")).select("m.id")


def root_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, root): the node without incoming edges that is met by walking to the smallest predecessor each time; on acyclic graphs. Pointer jumping halves the way each round."""
    scratch = Scratch(edges.sparkSession, "root-of")
    up = edges.filter("src <> dst").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("up"))
    step = scratch.write(nodes.select("id").distinct().join(up, "id", "left").select("id", F.coalesce("up", "id").alias("root")))
    while True:
        far = step.select(F.col("id").alias("root"), F.col("root").alias("far"))
        jumped, n = scratch.counted(step.join(far, "root").select("id", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), F.col("moved"))
        step = jumped.select("id", "root")
        if not n:
            return step


def subtree_members(comp: DataFrame, edges: DataFrame, root_ids: DataFrame, rep: DataFrame | None = None) -> DataFrame:
    """(root, id): the nodes at or below each root of the condensed graph; with `rep` (id, rep) folded nodes stand for all that were folded into them."""
    below = reach_pairs(edges, root_ids.select(F.col("id").alias("src"))).select(F.col("src").alias("root"), F.col("dst").alias("component"))
    every = below.unionByName(root_ids.select(F.col("id").alias("root"), F.col("id").alias("component"))).distinct()
    members = every.join(comp, "component").select("root", "id")
    return members if rep is None else members.join(rep.select(F.col("rep").alias("id"), F.col("id").alias("folded")), "id").select("root", F.col("folded").alias("id"))


def responsibility_tree(tree: DataFrame, max_depth: int = 3) -> DataFrame:
    """(root, id, parent, depth, place, weight, truncated) of a dominator tree (root, id, parent): nodes to `max_depth`, brothers by the size of what hangs below them, `truncated` where a node's children are cut off.

    The tree's height bounds the rounds; a node's size is one aggregation over the pairs of ancestors, which the dominators are.
    """
    scratch = Scratch(tree.sparkSession, "responsibility")
    pairs = reach_pairs(tree.select(F.struct("root", F.col("parent").alias("n")).alias("src"), F.struct("root", F.col("id").alias("n")).alias("dst")))
    pairs = scratch.write(pairs.select(F.col("src.root").alias("root"), F.col("src.n").alias("above"), F.col("dst.n").alias("id")))
    depth = pairs.groupBy("root", "id").agg(F.count(F.lit(1)).alias("depth"))
    weight = pairs.groupBy("root", F.col("above").alias("id")).agg((F.count(F.lit(1)) + 1).alias("weight"))
    full = tree.join(depth, ["root", "id"]).join(weight, ["root", "id"], "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("root", "parent").orderBy(F.desc("weight"), "id"))
    return full.filter(F.col("depth") <= max_depth).withColumn("place", place).withColumn("truncated", (F.col("depth") == max_depth) & (F.col("weight") > 1))
