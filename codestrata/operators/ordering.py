"""Orders of a graph's nodes that cheap edges only go against: what to cut in large cyclic components.

Edges against an order are a cut that leaves no cycle, whatever the order is. The order is
found level by level. Two nodes that are each other's costliest link become one, the start
before the end, as long as that removes a good part of the nodes. What is left is smoothed:
a node's place is drawn to one behind the nodes before it and one before those behind it.
Then, on this level and on each finer one, nodes move: each finds the slot between its
neighbours where least goes against it, and of those that gain by a move no two neighbours
move in the same round. What a node's edges cost depends on it and its neighbours only, so
the gains add up and the cost falls in every round.

Places and costs are whole numbers, so reruns agree. A node with many neighbours looks at
cells of places in place of single ones: what a node ranks is bounded, whatever its degree.
Each round is two written tables of a row a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.session import Scratch

#: The distance of one layer on the coarsest level; places are four times as far apart on each finer one.
UNIT = 1 << 20
#: No more levels than this, and none that takes away less than one node in so many.
LEVELS, WORTH = 16, 10
#: Rounds of moves on a level that is not the finest.
COARSE_ROUNDS = 2
#: Costs are counted in thousandths.
MILLI = 1000
#: A node with more neighbours than this looks at about as many cells of places.
CELLS = 1024
#: Rounds of smoothing, and how many one job makes.
SMOOTH, STRIDE = 16, 4


def _ends(edges: DataFrame) -> DataFrame:
    """(id, other, leaving, entering): each linked pair from both sides, with the cost of the edges from id to other and back."""
    there = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.col("units").alias("leaving"), F.lit(0).cast("long").alias("entering"))
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(0).cast("long").alias("leaving"), F.col("units").alias("entering"))
    return there.unionByName(back).groupBy("id", "other").agg(F.sum("leaving").alias("leaving"), F.sum("entering").alias("entering"))


def _smoothed(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, n, at): the first places, and each node's number of neighbours."""
    place = scratch.write(ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("at")))
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    pull = F.col("leaving") * wide(F.col("there") - UNIT, 19) + F.col("entering") * wide(F.col("there") + UNIT, 19)
    both = ends.select("id", "other", wide(F.col("leaving"), 15).alias("leaving"), wide(F.col("entering"), 15).alias("entering"))
    for turn in range(SMOOTH):
        drawn = both.join(place.select(F.col("id").alias("other"), F.col("at").alias("there")), "other")
        mean = drawn.groupBy("id").agg((F.sum(pull) / F.sum(F.col("leaving") + F.col("entering"))).cast("long").alias("mean"))
        place = place.join(mean, "id").select("id", "n", F.floor((F.col("at") + F.col("mean")) / 2).alias("at"))
        if turn % STRIDE == STRIDE - 1:
            place = scratch.write(place)
    return place


def _paired(ends: DataFrame) -> DataFrame:
    """(id, head, tail) of nodes that are each other's costliest link: the start of the costlier direction is the head, the other the tail."""
    net = F.col("leaving") - F.col("entering")
    rank = F.struct(F.abs(net).alias("w"), F.xxhash64(F.least("id", "other"), F.greatest("id", "other")).alias("h"), F.greatest("id", "other").alias("g"))
    pick = ends.groupBy("id").agg(F.max_by(F.struct("other", net.alias("net")), rank).alias("p")).select("id", F.col("p.other").alias("other"), F.col("p.net").alias("net"))
    back = pick.select(F.col("id").alias("other"), F.col("other").alias("id"))
    first = (F.col("net") > 0) | ((F.col("net") == 0) & (F.col("id") < F.col("other")))
    return pick.join(back, ["id", "other"]).select("id", F.when(first, F.col("id")).otherwise(F.col("other")).alias("head"), (~first).alias("tail"))


def _contracted(ends: DataFrame, pairs: DataFrame) -> DataFrame:
    """ends between the heads of pairs and the nodes left alone."""
    a, b = pairs.select("id", F.col("head").alias("a")), pairs.select(F.col("id").alias("other"), F.col("head").alias("b"))
    both = ends.join(a, "id", "left").join(b, "other", "left").select(F.coalesce("a", "id").alias("id"), F.coalesce("b", "other").alias("other"), "leaving", "entering")
    return both.filter("id <> other").groupBy("id", "other").agg(F.sum("leaving").alias("leaving"), F.sum("entering").alias("entering"))


def _against(at: Column, me: Column, there: Column, other: Column) -> Column:
    """Whether `other` comes before `me`; equal places go by id."""
    return (there < at) | ((there == at) & (other < me))


def _wishes(ends: DataFrame, place: DataFrame, low: int, width: int, turn: int) -> DataFrame:
    """(id, to, gain) of the nodes that cost less elsewhere while all others stay."""
    seen = ends.join(place.select(F.col("id").alias("other"), F.col("at").alias("there")), "other").join(place, "id")
    before = _against(F.col("at"), F.col("id"), F.col("there"), F.col("other"))
    cell = F.when(F.col("n") > CELLS, F.floor((F.col("there") - F.lit(low)) / F.lit(width))).otherwise(F.col("there"))
    groups = seen.groupBy("id", cell.alias("cell")).agg(
        F.min("there").alias("first"), F.max("there").alias("last"), F.sum("entering").alias("entering"), F.sum(F.col("leaving") - F.col("entering")).alias("step"), F.sum(F.when(before, F.col("leaving")).otherwise(F.col("entering"))).alias("now")
    )
    order = Window.partitionBy("id").orderBy("cell")
    slots = groups.withColumn("gap", F.lead("first").over(order) - F.col("last")).withColumn("rise", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Nodes that choose the same slot take places of their own in its middle half.
    jitter = F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1024))
    aside = lambda c: F.greatest(F.shiftright(c, 2) + F.shiftright(c, 11) * jitter, F.lit(1))
    behind = F.when(F.col("gap").isNull(), F.col("last") + aside(F.lit(UNIT))).when(F.col("gap") >= 2, F.col("last") + aside(F.col("gap")))
    choice = F.when(behind.isNotNull(), F.struct(F.col("rise").alias("rise"), behind.alias("to")))
    best = slots.groupBy("id").agg(F.sum("entering").alias("entering"), F.sum("now").alias("now"), F.min("first").alias("first"), F.min(choice).alias("best"))
    front = F.col("best.rise") >= 0
    to = F.when(front, F.col("first") - aside(F.lit(UNIT))).otherwise(F.col("best.to"))
    gain = F.col("now") - F.col("entering") - F.least(F.lit(0).cast("long"), F.col("best.rise"))
    return best.select("id", to.alias("to"), gain.alias("gain")).filter("gain > 0")


def _movers(ends: DataFrame, wish: DataFrame, turn: int) -> DataFrame:
    """(id, to) of wishes of which no two are neighbours': the larger gain by its binary digits goes first, then a hash."""
    ranked = wish.select("id", "to", F.struct((-F.floor(F.log2("gain"))).alias("g"), F.xxhash64("id", F.lit(turn)).alias("h"), "id").alias("rank"))
    rival = ranked.select(F.col("id").alias("other"), F.col("rank").alias("theirs"))
    lost = ends.select("id", "other").join(ranked.select("id", "rank"), "id").join(rival, "other").filter("theirs < rank").select("id").distinct()
    return ranked.join(lost, "id", "left_anti").select("id", "to")


def _settled(ends: DataFrame, place: DataFrame, rounds: int, scratch: Scratch) -> DataFrame:
    """place when no node gains by a move, or after so many rounds."""
    span = place.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    width = max(1, (span["high"] - span["low"]) // CELLS)
    for turn in range(rounds):
        wish, n = scratch.counted(_wishes(ends, place, span["low"], width, turn))
        if not n:
            break
        moved = place.join(_movers(ends, wish, turn), "id", "left").select("id", "n", F.coalesce("to", "at").alias("at"))
        place = scratch.write(moved)
    return place


def places(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id, at): the place of every node of the edges (src, dst, cost), distinct and without loops and nulls; equal places go by id.

    Ends when no node gains by a move, or after so many rounds: every order gives a cut.
    """
    scratch = Scratch(edges.sparkSession, "ordering")
    units = edges.select("src", "dst", F.greatest(F.round(F.col("cost") * MILLI), F.lit(1)).cast("long").alias("units"))
    ends = scratch.write(_ends(units))
    n = ends.select("id").distinct().count()
    if not n:
        return ends.select("id", F.lit(0).cast("long").alias("at"))
    finer: list[tuple[DataFrame, DataFrame]] = []
    while len(finer) < LEVELS:
        pairs, paired = scratch.counted(_paired(ends))
        left = n - paired // 2
        if (n - left) * WORTH < n:
            break
        coarse, linked = scratch.counted(_contracted(ends, pairs))
        if not linked:  # nothing is linked any more: this level's pairs are in order as they are
            break
        finer.append((ends, pairs))
        ends, n = coarse, left
    place = _settled(ends, _smoothed(ends, scratch), COARSE_ROUNDS if finer else rounds, scratch)
    while finer:
        ends, pairs = finer.pop()
        known = pairs.join(place.select(F.col("id").alias("head"), "at"), "head", "left").select("id", (F.coalesce("at", F.lit(0)) * 4 + F.when(F.col("tail"), 2).otherwise(0)).alias("at"))
        alone = place.join(pairs.select("id"), "id", "left_anti").select("id", (F.col("at") * 4).alias("at"))
        degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        place = scratch.write(degree.join(known.unionByName(alone), "id", "left").select("id", "n", F.coalesce("at", F.lit(0).cast("long")).alias("at")))
        place = _settled(ends, place, COARSE_ROUNDS if finer else rounds, scratch)
    return place.select("id", "at")


def against_order(edges: DataFrame, place: DataFrame) -> DataFrame:
    """The edges (src, dst, ...) whose end comes before their start; without them no cycle is left."""
    a, b = place.select(F.col("id").alias("src"), F.col("at").alias("__a")), place.select(F.col("id").alias("dst"), F.col("at").alias("__b"))
    both = edges.join(a, "src").join(b, "dst")
    return both.filter(_against(F.col("__a"), F.col("src"), F.col("__b"), F.col("dst"))).select(*edges.columns)
