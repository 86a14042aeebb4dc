"""Communities by modularity: nodes move while that gains, then communities become nodes, level by level.

The modularity of a partition of an undirected graph of total edge weight m is the sum over
communities of in / m - (degree / 2m)^2, `in` being the weight of the edges inside.

A round moves many nodes at once, and every move still gains. A community either sends or
receives, by a coin of the round where some want to leave it and others to enter. A node that wants from a sender to a receiver is
judged as if all others that want to leave its community had left it and all that want to
enter its target were there; what is left of the gain is a lower bound of the true one,
in whatever order the moves are taken. Where a target is so wanted that nobody passes,
only a part of its suitors, chosen by hash, is let in; and where that fails, each
community takes part in one move at most, which makes the gains exact. So modularity
grows in each round and the rounds end. Gains are whole numbers: m-fold, never rounded.

No community is gathered in one group: what travels are sums by (node, community), and
one row a community. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.session import Scratch

#: Of the suitors of a target one in 2 ** thin is let in; beyond this the communities move one node each.
THINNEST = 12
#: With so few wishes they are taken without a coin, one a community.
FEW = 32
#: A level ends when fewer than one node in so many would move; the last level ends when none would.
WORTH = 50


def _each(df: DataFrame) -> DataFrame:
    """A table of a row a node, to be joined by merging: a broadcast would send it through the driver in every round. Tables of a row a community are left to Catalyst."""
    return df.hint("merge")


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions: one edge of weight 1 for each pair that (src, dst) links either way; loops and nulls are left out."""
    pairs = edges.filter("src <> dst").select("src", "dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("w", F.lit(1).cast("long"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(communities, edges, inside, modularity), one row, of membership (id, community) on edges (src, dst) taken as undirected.

    Communities are counted with those that have no edge; without edges modularity is 0.
    """
    both = undirected(edges)
    side = lambda c, to: membership.select(F.col("id").alias(c), F.col("community").alias(to))
    ends = both.join(_each(side("src", "a")), "src").join(_each(side("dst", "b")), "dst")
    per = ends.groupBy(F.col("a").alias("community")).agg(F.sum("w").alias("degree"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0)).alias("inside"))
    full = membership.select("community").distinct().join(per, "community", "left")
    total, inside = F.coalesce(F.sum("degree"), F.lit(0)), F.coalesce(F.sum("inside"), F.lit(0))
    squares = F.coalesce(F.sum(F.col("degree").cast("decimal(18,0)") * F.col("degree").cast("decimal(18,0)")), F.lit(0))
    sums = full.agg(F.count(F.lit(1)).alias("communities"), total.alias("t"), inside.alias("i"), squares.cast("double").alias("s"))
    value = F.when(F.col("t") > 0, F.col("i") / F.col("t") - F.col("s") / F.col("t") / F.col("t")).otherwise(0.0)
    return sums.select("communities", F.floor(F.col("t") / 2).alias("edges"), F.floor(F.col("i") / 2).alias("inside"), value.alias("modularity"))


def _gain(to: Column, own: Column, k: Column, at: Column, home: Column, twice: int) -> Column:
    """m times twice the gain in modularity of a node of degree k that leaves a community of degree `home`, it included, for one of degree `at`; exact."""
    whole = lambda c: c.cast("decimal(18,0)")
    return F.lit(twice).cast("decimal(18,0)") * whole(to - own) - whole(k) * whole(at - home + k)


def _wishes(both: DataFrame, label: DataFrame, twice: int) -> DataFrame:
    """(id, k, label, home, own, target, to, at, gain): each node's best move, if one gains; ties to the smaller target.

    `both` is (src, k, dst, w), k the degree of src; `label` is (id, k, label). What a node
    gives up is the same for all its targets, so one aggregation finds the best of them.
    """
    degree = label.groupBy(F.col("label").alias("target")).agg(F.sum("k").alias("at"))
    near = both.join(_each(label.select(F.col("id").alias("dst"), F.col("label").alias("target"))), "dst").select(F.col("src").alias("id"), "k", "target", "w", F.lit(False).alias("mine"))
    votes = near.unionByName(label.select("id", "k", F.col("label").alias("target"), F.lit(0).cast("long").alias("w"), F.lit(True).alias("mine")))
    seen = votes.groupBy("id", "k", "target").agg(F.sum("w").alias("to"), F.bool_or("mine").alias("mine")).join(degree, "target")
    mine = lambda c: F.max(F.when(F.col("mine"), F.col(c))).alias
    order = F.struct((-_gain(F.col("to"), F.lit(0), F.col("k"), F.col("at"), F.lit(0), twice)).alias("g"), "target")
    best = F.min_by(F.struct("target", "to", "at"), F.when(~F.col("mine"), order)).alias("m")
    per = seen.groupBy("id", "k").agg(mine("target")("label"), mine("to")("own"), mine("at")("home"), best).filter("m IS NOT NULL")
    return per.select("id", "k", "label", "own", "home", "m.*").withColumn("gain", _gain(F.col("to"), F.col("own"), F.col("k"), F.col("at"), F.col("home"), twice)).filter("gain > 0")


def _together(wish: DataFrame, turn: int, thin: int, twice: int) -> DataFrame:
    """(id, target) of the moves that gain whatever else of them is made."""
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0
    let_in = F.pmod(F.xxhash64("id", F.lit(turn), F.lit("thin")), F.lit(1 << thin)) == 0
    entered = wish.select(F.col("target").alias("label"), F.lit(True).alias("entered")).distinct()
    left = wish.select(F.col("label").alias("target"), F.lit(True).alias("left")).distinct()
    sends, receives = F.col("entered").isNull() | coin("label"), F.col("left").isNull() | ~coin("target")
    some = wish.join(entered, "label", "left").join(left, "target", "left").filter(sends & receives & let_in)
    coming = some.groupBy("target").agg(F.sum("k").alias("coming"))
    going = some.groupBy("label").agg(F.sum("k").alias("going"))
    crowd = some.join(coming, "target").join(going, "label")
    least = _gain(F.col("to"), F.col("own"), F.col("k"), F.col("at") + F.col("coming") - F.col("k"), F.col("home") - F.col("going") + F.col("k"), twice)
    return crowd.filter(least > 0).select("id", "target")


def _singly(wish: DataFrame) -> DataFrame:
    """(id, target) of moves no two of which touch the same community; the best of all is among them."""
    rank = F.struct((-F.col("gain")).alias("g"), F.xxhash64("id").alias("h"), "id")
    touched = wish.select(rank.alias("rank"), F.explode(F.array("label", "target")).alias("community"))
    first = touched.groupBy("community").agg(F.min("rank").alias("rank"))
    won = first.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(F.col("rank.id").alias("id"))
    return wish.join(_each(won), "id", "left_semi").select("id", "target")


def _settled(both: DataFrame, nodes: DataFrame, n: int, twice: int, scratch: Scratch, rounds: int) -> tuple[DataFrame, int]:
    """(id, k, label) when few nodes gain by a move, none on a level where nothing has moved, and how many moves were made."""
    label, thin, moved, alone = nodes.select("id", "k", F.col("id").alias("label")), 0, 0, False
    for turn in range(rounds):
        wish, wishing = scratch.counted(_wishes(both, label, twice))
        if not wishing or (moved and wishing * WORTH < n):
            return label, moved
        alone = alone or wishing <= FEW
        moves = _singly(wish) if alone else _together(wish, turn, thin, twice)
        step = label.join(_each(moves), "id", "left")
        after, made = scratch.counted(step.select("id", "k", F.coalesce("target", "label").alias("label"), F.col("target").isNotNull().alias("moved")), F.col("moved"))
        if made:
            label, moved, thin, alone = after.drop("moved"), moved + made, max(0, thin - 1), False
        else:
            thin += 2
            alone = thin > THINNEST
    raise RuntimeError(f"communities not settled after {rounds} rounds")


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(id, community) for every distinct non-null id of `nodes`: the smallest id of its community.

    Edges (src, dst) count once for each pair, whatever their direction; those with an end
    outside `nodes` are left out. Nodes without edges are communities of their own. Equal
    inputs give equal communities. Raises if a level takes more than `rounds` rounds.
    """
    scratch = Scratch(edges.sparkSession, "modularity")
    every = scratch.write(nodes.select("id").filter("id IS NOT NULL").distinct())
    inside = undirected(edges).join(_each(every.withColumnRenamed("id", "src")), "src", "left_semi").join(_each(every.withColumnRenamed("id", "dst")), "dst", "left_semi")
    level, n = scratch.counted(inside.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    heavy = lambda e, of: scratch.write(e.join(_each(of.withColumnRenamed("id", "src")), "src").select("src", "k", "dst", "w"))
    twice = level.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("t")).first()["t"]
    found, both = level.select("id", F.col("id").alias("label")), heavy(inside, level)
    while n:
        label, moved = _settled(both, level, n, twice, scratch, rounds)
        if not moved:
            break
        found = scratch.write(found.join(_each(label.select(F.col("id").alias("label"), F.col("label").alias("next"))), "label").select("id", F.col("next").alias("label")))
        level, n = scratch.counted(label.groupBy(F.col("label").alias("id")).agg(F.sum("k").alias("k")))
        a, b = label.select(F.col("id").alias("src"), F.col("label").alias("a")), label.select(F.col("id").alias("dst"), F.col("label").alias("b"))
        between = both.drop("k").join(_each(a), "src").join(_each(b), "dst").filter("a <> b")
        both = heavy(between.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), level)
    names = found.groupBy("label").agg(F.min("id").alias("community"))
    return every.join(_each(found.join(names, "label").select("id", "community")), "id", "left").select("id", F.coalesce("community", "id").alias("community"))
