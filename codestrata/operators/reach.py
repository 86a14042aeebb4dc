"""How many nodes each node reaches, by bitmaps.

The graph is condensed and its chains contracted; what is left is an acyclic graph of
groups of nodes. Groups that can be reached get a bit in a word of 64; all groups of a
word have the same number of members, so a count of bits and one product count members.
Words are OR-ed along the edges in reverse topological order: a few levels at a time
(condense.STRIDE), each edge carries the finished words of its end to its start once. No pair of nodes is
ever written: a row is a node and a word, 64 pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators.condense import STRIDE, WORTH, chains, components, condensed_edges, contracted
from codestrata.session import Scratch



def heights(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, height) for the nodes of the edges of an acyclic graph: the longest path to a node without outgoing edges.

    Each step takes, over a node's successors and itself, the largest height offered; the
    node itself stands as an edge that adds nothing, so a step uses the one before once,
    and a job makes several. It ends when nothing rises.
    """
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    ids = scratch.write(ids)
    steps = scratch.write(edges.select("src", "dst", F.lit(1).alias("up")).unionByName(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("up"))))
    now = ids.withColumn("height", F.lit(0))
    while True:
        for _ in range(STRIDE):
            offered = steps.join(now.select(F.col("id").alias("dst"), "height"), "dst")
            now = offered.groupBy(F.col("src").alias("id")).agg(F.max(F.col("height") + F.col("up")).alias("height"), F.max(F.when(F.col("up") == 0, F.col("height"))).alias("before"))
        now, n = scratch.counted(now, F.col("height") != F.col("before"))
        if not n:
            return now.select("id", "height")


def words(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, word, size, bits) for groups (id, size): one bit each; the groups of a word and size fill up to 64 bits, neighbours by id together."""
    placed = groups.orderBy("size", "id").withColumn("place", F.monotonically_increasing_id())
    # The number holds the partition in its upper bits and counts from 0 within, so words are full but at the ends of partitions.
    return scratch.write(placed.select("id", F.shiftright("place", 6).alias("word"), "size", F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int")).alias("bits")))


def reached(edges: DataFrame, size: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, beyond): the members of all groups that a group of an acyclic graph reaches, itself apart; groups that reach none are left out."""
    spark = edges.sparkSession
    high = heights(edges, scratch)
    level = F.floor((F.col("height") - 1) / STRIDE).cast("int")  # of nodes with successors
    own = words(size.join(edges.select(F.col("dst").alias("id")), "id", "left_semi"), scratch)
    marked = edges.join(high.select(F.col("id").alias("src"), level.alias("a")), "src").join(high.select(F.col("id").alias("dst"), level.alias("b"), (F.col("height") == 0).alias("sink")), "dst")
    marked = scratch.write(marked.select("src", "dst", "a", F.when(F.col("sink"), -1).otherwise(F.col("b")).alias("b")))
    most = marked.agg(F.max("a").alias("m")).first()["m"]
    done: list[str] = []
    reach = own.limit(0)
    merged = lambda df, to: df.groupBy(F.col(to).alias("id"), "word", "size").agg(F.bit_or("bits").alias("bits"))
    for k in range(0, -1 if most is None else most + 1):
        below, inner = marked.filter(f"a = {k} AND b < {k}"), marked.filter(f"a = {k} AND b = {k}")
        finished = own.unionByName(reach)  # what a node hands on: its own bit and what it reaches
        given = below.unionByName(inner).join(own.withColumnRenamed("id", "dst"), "dst").unionByName(below.join(reach.withColumnRenamed("id", "dst"), "dst")) if done else below.unionByName(inner).join(finished.withColumnRenamed("id", "dst"), "dst")
        now = merged(given, "src")
        # Within the stride words go on along its inner edges; a node stands as an edge to itself.
        if STRIDE > 1 and not inner.isEmpty():
            start = scratch.write(now)
            stay = start.select(F.col("id").alias("src"), F.col("id").alias("dst")).distinct()
            steps = inner.select("src", "dst").unionByName(stay)
            now = start
            for _ in range(STRIDE - 1):
                now = merged(steps.join(now.withColumnRenamed("id", "dst"), "dst"), "src")
        part = scratch.write(now)
        done.append(scratch.paths[-1])
        reach = spark.read.schema(part.schema).parquet(*done)
    return reach.groupBy("id").agg(F.sum(F.bit_count("bits") * F.col("size")).cast("long").alias("beyond"))


def reach_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, reach): how many other nodes can be reached. Members of a component reach alike; in a chain, a node reaches what comes after it and what its last node does."""
    scratch = Scratch(edges.sparkSession, "reach-counts")
    comp = scratch.write(components(nodes, edges))
    size = scratch.write(comp.groupBy(F.col("component").alias("id")).agg(F.count(F.lit(1)).alias("size")))
    cond, n = scratch.counted(condensed_edges(comp, edges).select("src", "dst"))
    chain = chains(cond, scratch, -(-n // WORTH), size.withColumnRenamed("size", "w"))
    if chain is None:
        group, flat = size.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("place"), "size"), cond
    else:
        group = size.join(chain, "id", "left").select("id", F.coalesce("head", "id").alias("head"), F.coalesce("place", F.lit(0)).cast("long").alias("place"), "size")
        flat = scratch.write(contracted(cond, chain).select("src", "dst"))
    whole = scratch.write(group.groupBy(F.col("head").alias("id")).agg(F.sum("size").alias("size")))
    beyond = reached(flat, whole, scratch)
    per = whole.join(beyond, "id", "left").select(F.col("id").alias("head"), F.col("size").alias("whole"), F.coalesce("beyond", F.lit(0)).alias("beyond"))
    counted = group.join(per, "head").select(F.col("id").alias("component"), (F.col("whole") - F.col("place") - 1 + F.col("beyond")).cast("long").alias("reach"))
    return comp.join(counted, "component").select("id", "reach")
