"""Grouping classes into modules, and the graph of modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.text import dirname, glob_match, last_segment
from codestrata.operators import communities
from codestrata.session import Scratch

ROOT, UNASSIGNED = "(root)", "(unassigned)"
#: Where at most one node in so many has moved, only what the moves touch is judged anew.
FEW = 16


def common_prefix(paths: DataFrame, segments: Column) -> list[str]:
    """The leading segments that all rows share; at most as many as the shortest has. The result has the length of one path."""
    rows = paths.select(segments.alias("s"))
    found = rows.select(F.posexplode("s").alias("i", "seg")).groupBy("i").agg(F.min("seg").alias("a"), F.max("seg").alias("b"), F.count(F.lit(1)).alias("n"))
    total = rows.count()
    out: list[str] = []
    for r in found.filter((F.col("a") == F.col("b")) & (F.col("n") == total)).orderBy("i").collect():
        if r["i"] != len(out):
            break
        out.append(r["a"])
    return out


def by_folder(classes: DataFrame) -> DataFrame:
    """(id columns, module): the directory relative to what all share, where more than one class has a directory; `(root)` where nothing remains."""
    d = dirname(F.col("file_path"))
    full = classes.withColumn("__d", F.coalesce(d, F.lit("")))
    placed = full.filter("__d <> ''").select("__d")
    skip = len(common_prefix(placed.distinct(), F.split("__d", "/"))) if placed.limit(2).count() > 1 else 0
    rel = F.array_join(F.slice(F.split("__d", "/"), skip + 1, 1 << 20), "/")
    return full.withColumn("module", F.when(rel.isin("", "."), ROOT).otherwise(rel)).drop("__d")


def by_namespace(classes: DataFrame) -> DataFrame:
    """The first namespace segment after those that all share, else the last; `(root)` without a namespace."""
    full = classes.withColumn("__s", F.slice(F.split("qualified_name", "::"), 1, F.greatest(F.size(F.split("qualified_name", "::")) - 1, F.lit(0))))
    skip = len(common_prefix(full.filter("size(__s) > 0").select("__s").distinct(), F.col("__s")))
    module = F.coalesce(F.get("__s", F.lit(skip)), F.try_element_at("__s", F.lit(-1)), F.lit(ROOT))
    return full.withColumn("module", module).drop("__s")


def by_groups(classes: DataFrame, groups: list[tuple[str, list[str]]]) -> DataFrame:
    """The first group, as declared, one of whose patterns fits; else `(unassigned)`. The patterns are one expression, evaluated in the scan."""
    short = last_segment(F.col("qualified_name"))
    module = F.lit(UNASSIGNED)
    for name, patterns in reversed(groups):
        fits = F.lit(False)
        for p in patterns:
            fits = fits | glob_match(p, F.col("file_path"), short, F.col("qualified_name"))
        module = F.when(fits, name).otherwise(module)
    return classes.withColumn("module", module)


def by_community(classes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Communities by label propagation on the undirected graph of (src, dst) over qualified names, named after the member of most neighbours.

    An edge weighs the inverse of its ends' degrees' product, so that a bridge between
    two hubs ties less than an edge within a group. In a round every node that would gain
    takes the label of most weight among its neighbours (ties to the smaller), if no neighbour that would gain too comes before it by
    hash. So neighbours never move together, each move adds to the weight within
    communities or keeps them and makes a label smaller, and the rounds end. Raises if
    `rounds` do not suffice. Equal inputs give equal communities.

    Names are numbered in their order once; what travels are numbers. What a node wishes
    depends on its own and its neighbours' labels, so after few moves only those that moved
    and their neighbours are judged anew.
    """
    scratch = Scratch(classes.sparkSession, "community")
    linked = edges.filter("src <> dst").select("src", "dst")
    said = classes.select(F.col("qualified_name").alias("name"), F.lit(True).alias("inside")).unionByName(linked.select(F.explode(F.array("src", "dst")).alias("name"), F.lit(False).alias("inside")))
    every = said.filter("name IS NOT NULL").groupBy("name").agg(F.max("inside").alias("inside")).orderBy("name")
    every = scratch.write(every.select("name", "inside", F.monotonically_increasing_id().alias("id"), F.xxhash64("name").alias("h")))
    number = lambda c: every.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    one_way = linked.join(number("src"), "src").join(number("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    pairs = scratch.write(one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label, n = scratch.counted(every.filter("inside").select("id", "h", F.col("id").alias("label")))
    degree = scratch.write(pairs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")).join(label.select("id"), "id", "left_semi"))
    ends = pairs.join(degree.select(F.col("id").alias("src"), F.col("d").alias("a")), "src").join(degree.select(F.col("id").alias("dst"), F.col("d").alias("b")), "dst")
    both = scratch.write(ends.select("src", "dst", F.greatest(F.floor(F.lit(10**12) / (F.col("a") * F.col("b"))), F.lit(1)).alias("w")))
    touched, held = None, None
    for _ in range(rounds):
        near, whose = (both, label) if touched is None else (both.join(touched.withColumnRenamed("id", "src"), "src", "left_semi"), label.join(touched, "id", "left_semi"))
        wish = _wishes(near, label, whose)
        wish, wishing = scratch.counted(wish if touched is None else wish.unionByName(held.join(touched, "id", "left_anti")))
        if not wishing:
            break
        turn = F.struct("h", "id")
        before = both.join(wish.select(F.col("id").alias("dst"), turn.alias("other")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("other").alias("other"))
        moves, made = scratch.counted(wish.join(before, "id", "left").filter(F.col("other").isNull() | (turn < F.col("other"))).select("id", "new"))
        label = scratch.write(label.join(moves, "id", "left").select("id", "h", F.coalesce("new", "label").alias("label")))
        touched, held = None, wish
        if made * FEW < n:
            around = both.join(moves.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
            touched = scratch.write(around.unionByName(moves.select("id")).distinct())
    else:
        raise RuntimeError(f"communities not settled after {rounds} rounds")
    names = label.join(degree, "id", "left").groupBy("label").agg(F.min(F.struct((-F.coalesce("d", F.lit(0))).alias("d"), "id")).alias("m")).select("label", F.col("m.id").alias("named"))
    named = label.join(names, "label").join(every.select(F.col("id").alias("named"), F.concat(F.lit("cluster:"), F.col("name")).alias("module")), "named").select("id", "module")
    return classes.join(named.join(every, "id").select(F.col("name").alias("qualified_name"), "module"), "qualified_name").select(*classes.columns, "module")


def _wishes(near: DataFrame, label: DataFrame, whose: DataFrame) -> DataFrame:
    """(id, h, new): the nodes of `whose` (id, h, label) that would take another label, given the edges (src, dst, w) out of them and all labels; one aggregation finds the best label and what the own one has."""
    votes = near.join(label.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label", "w", F.lit(None).cast("long").alias("h"))
    own = whose.select("id", "label", F.lit(0).cast("long").alias("w"), "h")
    seen = votes.unionByName(own).groupBy("id", "label").agg(F.sum("w").alias("n"), F.max("h").alias("h"))
    mine = lambda c: F.max(F.when(F.col("h").isNotNull(), F.col(c)))
    best = F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("n"), "label")))
    per = seen.groupBy("id").agg(F.max("h").alias("h"), mine("label").alias("label"), mine("n").alias("own"), best.alias("m"))
    gain = -F.col("m.n") - F.col("own")
    return per.filter((gain > 0) | ((gain == 0) & (F.col("m.label") < F.col("label")))).select("id", "h", F.col("m.label").alias("new"))


def by_modularity(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Communities by modularity on the undirected graph of (src, dst) over qualified names, named after the member of most neighbours, ties to the smaller name."""
    found = communities.communities(classes.select(F.col("qualified_name").alias("id")), edges)
    degree = communities.undirected(edges).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    names = found.join(degree, "id", "left").groupBy("community").agg(F.min(F.struct((-F.coalesce("d", F.lit(0))).alias("d"), "id")).alias("m")).select("community", F.concat(F.lit("cluster:"), F.col("m.id")).alias("module"))
    return classes.join(found.join(names, "community").select(F.col("id").alias("qualified_name"), "module"), "qualified_name").select(*classes.columns, "module")


def assign(classes: DataFrame, edges: DataFrame, strategy: str = "auto", groups: list[tuple[str, list[str]]] | None = None) -> tuple[DataFrame, str]:
    """Classes with `module`, and the strategy used: groups, else folders or namespaces if they make two modules or more, else communities."""
    several = lambda df: df.select("module").distinct().limit(2).count() >= 2
    if strategy == "explicit" or (strategy == "auto" and groups):
        return by_groups(classes, groups or []), "explicit"
    if strategy in ("folder", "auto"):
        out = by_folder(classes)
        if strategy == "folder" or several(out):
            return out, "folder"
    if strategy in ("namespace", "auto"):
        out = by_namespace(classes)
        if strategy == "namespace" or several(out):
            return out, "namespace"
    if strategy not in ("community", "auto"):
        raise ValueError(f"unknown strategy: {strategy}")
    return by_modularity(classes, edges), "community"


def module_references(relationships: DataFrame, membership: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Relationships (src, dst, ...) between modules, as (src, dst, from_class, to_class, kind, ...); membership is (id, module), of the targets `targets`, where it is given."""
    a = membership.select(F.col("id").alias("src"), F.col("module").alias("__a"))
    b = (membership if targets is None else targets).select(F.col("id").alias("dst"), F.col("module").alias("__b"))
    rest = [c for c in relationships.columns if c not in ("src", "dst")]
    both = relationships.filter("dst IS NOT NULL").join(a, "src").join(b, "dst").filter("__a <> __b")
    return both.select(F.col("__a").alias("src"), F.col("__b").alias("dst"), F.col("src").alias("from_class"), F.col("dst").alias("to_class"), *rest)


def module_edges(references: DataFrame, evidence: Column | None = None, keep: int = 12) -> DataFrame:
    """(src, dst, weight, kinds, kind_counts[, evidence]): references counted, by kind first, then by pair; a row with `n` stands for n references. Of the evidence the first `keep` in order stay, bounded on the map side by kind."""
    many = F.sum("n") if "n" in references.columns else F.count(F.lit(1))
    per = references.groupBy("src", "dst", "kind").agg(many.alias("n"))
    out = per.groupBy("src", "dst").agg(F.sum("n").alias("weight"), F.array_sort(F.collect_list("kind")).alias("kinds"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kind_counts"))
    if evidence is None:
        return out
    # Each task ranks its own first, so few lines of a pair travel; repeats of a line share its rank and are dealt by the task that met them.
    rank = F.dense_rank().over(Window.partitionBy("src", "dst", "salt").orderBy("e"))
    some = references.select("src", "dst", evidence.alias("e")).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).withColumn("r", rank).filter(F.col("r") <= keep).select("src", "dst", "e").distinct()
    kept = some.groupBy("src", "dst").agg(F.slice(F.array_sort(F.collect_list("e")), 1, keep).alias("evidence"))
    return out.join(kept, ["src", "dst"])
