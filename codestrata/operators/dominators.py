"""Dominator trees of acyclic graphs, for all roots at once.

A node's path is the list of its strict dominators from the top down; that of a node is
the longest common beginning of its predecessors' paths, each with the predecessor
itself behind it. Of a set of lists this is the common beginning of the least and the
greatest, so a step is one join and one aggregation with partial minima and maxima,
and no table of ancestors is kept. One row is a node, as long as it is deep. A step uses
the one before once, and a job makes several; after as many steps as the longest path
has edges nothing changes any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.operators.condense import STRIDE, simple_edges
from codestrata.operators.reach import heights
from codestrata.session import Scratch, dealt

#: 1 << GROUP_BITS roots are taken together.
GROUP_BITS = 6
#: Groups of more edges are spread over tasks; a task takes groups together until it has BATCH_EDGES, and gives OUT_ROWS at a time.
LARGE, BATCH_EDGES, OUT_ROWS = 50_000, 30_000, 100_000


def common_beginning(a: Column, b: Column) -> Column:
    """The longest common beginning of two arrays."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(differ == 0, a).otherwise(F.slice(a, F.lit(1), F.greatest(differ - 1, F.lit(0)).cast("int")))


def dominator_tree(edges: DataFrame) -> DataFrame:
    """(id, parent, depth) for all nodes of an acyclic edge table: the nearest node on all ways to a node from the nodes without incoming edges; null and 0 for these, and null and 0 where there is none.

    With several such starts a virtual root stands above them all.
    """
    scratch = Scratch(edges.sparkSession, "dominators")
    plain = scratch.write(simple_edges(edges))
    ids = plain.select(F.col("src").alias("id")).union(plain.select("dst")).distinct()
    starts = plain.select(F.col("src").alias("id")).distinct().join(plain.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    steps = scratch.write(plain.withColumn("own", F.lit(False)).unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(True).alias("own"))))
    empty = F.slice(F.array("id"), 1, 0)
    now = scratch.write(starts.select("id", empty.alias("path")))
    while True:
        for _ in range(STRIDE):
            offered = steps.join(now.select(F.col("id").alias("src"), "path"), "src")
            way = F.when(~F.col("own"), F.concat("path", F.array("src")))
            met = offered.groupBy(F.col("dst").alias("id")).agg(F.min(way).alias("a"), F.max(way).alias("b"), F.max(F.when(F.col("own"), F.col("path"))).alias("before"))
            now = met.select("id", F.coalesce(common_beginning(F.col("a"), F.col("b")), "before").alias("path"), "before")
        now, n = scratch.counted(now, ~F.col("path").eqNullSafe(F.col("before")))
        if not n:
            return now.select("id", F.try_element_at("path", F.lit(-1)).alias("parent"), F.size("path").alias("depth"))


def trees(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(root, id, parent, depth): a dominator tree for each root of an acyclic graph, over the nodes (root, id) that it reaches; the roots themselves have no row."""
    return root_trees(edges, reached.select(F.col("root").alias("id")))


def root_trees(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, id, parent, depth): the dominator tree of each of the nodes `starts` (id) of an acyclic graph; the roots themselves have no row.

    Roots that share successors reach nearly the same, so GROUP of them are taken
    together: what a group reaches is found level by level (the longest path from a node
    without incoming edges), each pair of a group and a node once, and the group's edges
    meet in one task, which makes the trees of its roots side by side. So no pair of a
    root and a node is shuffled or kept. Groups of more than LARGE edges are not gathered
    but spread by `_spread_trees`.
    """
    scratch = Scratch(edges.sparkSession, "dominator-levels")
    plain = scratch.write(simple_edges(edges))
    level = heights(plain.select(F.col("dst").alias("src"), F.col("src").alias("dst")), scratch)
    marked = plain.join(level.select(F.col("id").alias("src"), F.col("height").alias("from_level")), "src").join(level.select(F.col("id").alias("dst"), F.col("height").alias("level")), "dst")
    marked = scratch.write(marked.select("src", "dst", "from_level", "level"))
    first = plain.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("next"))
    # The number holds the partition in its upper bits and counts from 0 within, so groups are full but at the ends of partitions.
    near = starts.select("id").distinct().join(first, "id").orderBy("next", "id").withColumn("group", F.shiftright(F.monotonically_increasing_id(), GROUP_BITS))
    roots = scratch.write(near.join(level, "id").select("group", "id", F.col("height").alias("level")))
    pairs = _reached_by_groups(marked, roots, scratch)
    inside = pairs.select("group", F.col("id").alias("src")).join(marked.select("src", "dst", "level"), "src").select("group", "src", "dst", "level")
    rows = inside.unionByName(roots.select("group", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(-1).alias("level")))
    sizes = pairs.join(plain.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id").groupBy("group").agg(F.sum("n").alias("n"))
    large, n = scratch.counted(sizes.filter(F.col("n") > LARGE).select("group"))
    if not n:
        return _gathered_trees(rows)
    return _gathered_trees(rows.join(large, "group", "left_anti")).unionByName(_spread_trees(marked, roots.join(large, "group", "left_semi").select("id")))


def _reached_by_groups(marked: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(group, id): the nodes that any root (group, id, level) of a group reaches, the roots among them.

    A step turns the pairs of one level into offers to higher levels; those wait, each
    pair once, until their level comes. `marked` are edges with the levels of both ends.
    """
    out = Scratch(scratch.spark, "dominator-reach")
    most = marked.agg(F.max("level").alias("m")).first()["m"]
    waiting = roots.select("group", "id", "level")
    done = [waiting.filter("level = 0").select("group", "id")]
    for k in range(0 if most is None else most):
        offered = waiting.filter(F.col("level") == k).select("group", F.col("id").alias("src")).join(marked.filter(F.col("from_level") == k).select("src", F.col("dst").alias("id"), "level"), "src")
        waiting = out.write(waiting.filter(F.col("level") > k).unionByName(offered.select("group", "id", "level")).distinct())
        done.append(waiting.filter(F.col("level") == k + 1).select("group", "id"))
    first, *rest = done
    for part in rest:
        first = first.unionByName(part)
    return first


def _meeting(a: np.ndarray, b: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The deepest common ancestor, itself included, of each two cells a and b of one tree."""
    a, b = a.copy(), b.copy()
    apart = np.flatnonzero(a != b)
    while apart.size:
        x, y = a[apart], b[apart]
        dx, dy = depth[x], depth[y]
        a[apart], b[apart] = np.where(dx >= dy, parent[x], x), np.where(dy >= dx, parent[y], y)
        apart = apart[a[apart] != b[apart]]
    return a


def grown(src: np.ndarray, dst: np.ndarray, level: np.ndarray, root_node: np.ndarray, root_slot: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(parent, depth) by cell: node * width + slot of the root, for the nodes 0 to n - 1 of groups of at most `width` roots. Depth is -1 where the root does not reach the node.

    A node's parent is where its predecessors meet in the tree, which are of lower levels
    and so placed before it; they meet two by two.
    """
    depth, parent = np.full(n * width, -1, np.int32), np.zeros(n * width, np.int32)
    depth[root_node * width + root_slot] = 0
    order = np.lexsort((dst, level))
    src, dst, level = src[order], dst[order], level[order]
    bounds = np.flatnonzero(np.r_[True, level[1:] != level[:-1]]) if len(level) else np.array([], np.int64)
    for lo, hi in zip(bounds, [*bounds[1:], len(level)]):
        edge, slot = np.nonzero(depth.reshape(n, width)[src[lo:hi]] >= 0)
        to, by = (dst[lo:hi][edge] * width + slot), (src[lo:hi][edge] * width + slot)
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        while to.size:
            new = np.r_[True, to[1:] != to[:-1]]
            if new.all():
                break
            start = np.flatnonzero(new)
            odd = (np.arange(len(to)) - np.repeat(start, np.diff(np.r_[start, len(to)]))) % 2 == 1
            at = np.flatnonzero(odd)
            by[at - 1] = _meeting(by[at - 1], by[at], parent, depth)
            to, by = to[~odd], by[~odd]
        parent[to], depth[to] = by, depth[by] + 1
    return parent, depth


def _trees_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(root, id, parent, depth) of whole groups (group, src, dst, level); a root's own row has it at both ends and level -1."""
    rows = rows.combine_chunks()
    m, column = rows.num_rows, lambda c: rows.column(c).combine_chunks()
    names = pa.concat_arrays([x for c in ("src", "dst") for x in rows.column(c).chunks]).dictionary_encode()
    group, level = np.unique(column("group").to_numpy(zero_copy_only=False), return_inverse=True)[1], column("level").to_numpy(zero_copy_only=False)
    key, node = np.unique(np.r_[group, group] * len(names.dictionary) + names.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
    src, dst, own = node[:m], node[m:], level < 0
    order = np.argsort(group[own], kind="stable")
    root, of = src[own][order], group[own][order]
    begin = np.searchsorted(of, np.arange(group.max() + 1))
    slot = np.arange(len(root)) - begin[of]
    width = int(slot.max()) + 1
    parent, depth = grown(src[~own], dst[~own], level[~own], root, slot, len(key), width)
    cells, code = np.flatnonzero(depth > 0), key % len(names.dictionary)
    for lo in range(0, len(cells), OUT_ROWS):
        at = cells[lo : lo + OUT_ROWS]
        above = root[begin[key[at // width] // len(names.dictionary)] + at % width]
        ids = [names.dictionary.take(pa.array(code[x])) for x in (above, at // width, parent[at] // width)]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(depth[at])], ["root", "id", "parent", "depth"])


def _gathered_trees(rows: DataFrame) -> DataFrame:
    """(root, id, parent, depth) of the groups' edges and roots (group, src, dst, level): a group meets in one task, which takes a few groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < BATCH_EDGES or not batch.num_rows:
                continue
            table = pa.Table.from_batches(held)
            group = table.column("group").to_numpy()
            whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if whole:
                yield from _trees_of(table.slice(0, whole))
            held, n = table.slice(whole).combine_chunks().to_batches(), len(group) - whole
        if n:
            yield from _trees_of(pa.Table.from_batches(held))

    kind = dict(rows.dtypes)["src"]
    return dealt(rows.select("group", "src", "dst", "level"), "group").sortWithinPartitions("group").mapInArrow(run, f"root {kind}, id {kind}, parent {kind}, depth int")


def _spread_trees(marked: DataFrame, starts: DataFrame) -> DataFrame:
    """root_trees of roots that reach much: nodes are taken level by level, so all that leads to a node has its path before it.

    Each pair of a root and a node is made once, and each edge is followed once for each
    root that reaches its start. A level's rows are a file set of their own, read
    together by the next.
    """
    spark, out = marked.sparkSession, Scratch(marked.sparkSession, "dominator-paths")
    done = out.write(starts.select(F.col("id").alias("root"), "id", F.slice(F.array("id"), 1, 0).alias("path")).distinct())
    most = marked.agg(F.max("level").alias("m")).first()["m"] or 0
    for k in range(1, most + 1):
        offered = marked.filter(F.col("level") == k).select("src", "dst").join(done.withColumnRenamed("id", "src"), "src")
        way = F.concat("path", F.array("src"))
        met = offered.groupBy("root", F.col("dst").alias("id")).agg(F.min(way).alias("a"), F.max(way).alias("b"))
        part = out.write(met.select("root", "id", common_beginning(F.col("a"), F.col("b")).alias("path")))
        done = spark.read.schema(part.schema).parquet(*out.paths)
    return done.filter("size(path) > 0").select("root", "id", F.try_element_at("path", F.lit(-1)).alias("parent"), F.size("path").alias("depth"))


def owners(edges: DataFrame) -> DataFrame:
    """(id, root) for the nodes of an acyclic edge table: the smallest node without incoming edges that reaches it, or that it is."""
    scratch = Scratch(edges.sparkSession, "owners")
    plain = scratch.write(simple_edges(edges))
    starts = plain.select(F.col("src").alias("id")).distinct().join(plain.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    ids = plain.select(F.col("src").alias("id")).union(plain.select("dst")).distinct()
    steps = scratch.write(plain.unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"))))
    now = scratch.write(starts.select("id", F.col("id").alias("root")))
    while True:
        for _ in range(STRIDE):
            offered = steps.join(now.select(F.col("id").alias("src"), "root"), "src")
            met = offered.groupBy(F.col("dst").alias("id")).agg(F.min("root").alias("root"), F.min(F.when(F.col("src") == F.col("dst"), F.col("root"))).alias("before"))
            now = met
        now, n = scratch.counted(now, ~F.col("root").eqNullSafe(F.col("before")))
        if not n:
            return now.select("id", "root")
        now = now.select("id", "root")


def forest(edges: DataFrame) -> DataFrame:
    """(root, id, parent, depth): each node of an acyclic graph below the first root that reaches it, under its nearest dominator on the ways from that root; the roots have depth 0.

    What leads from the first root to a node is first reached from that root, too, so the
    edges between nodes of one owner are all that is needed, and rows and edges stay
    those of the graph however many roots there are.
    """
    scratch = Scratch(edges.sparkSession, "forest")
    own = scratch.write(owners(edges))
    a, b = own.select(F.col("id").alias("src"), F.col("root").alias("a")), own.select(F.col("id").alias("dst"), F.col("root").alias("b"))
    within = simple_edges(edges).join(a, "src").join(b, "dst").filter("a = b").select("src", "dst")
    tree = dominator_tree(within)
    return own.join(tree, "id", "left").select("root", "id", "parent", F.coalesce("depth", F.lit(0)).alias("depth"))
