"""Table operators: upserts, logs, caches, name resolution, de-duplication, reports."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.kinds import CLASS_KINDS
from codestrata.functions.text import last_segment
from codestrata.session import Scratch, bounded_batches

MAX_ALIAS_DEPTH = 9


# -- keyed tables --------------------------------------------------------------
def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order; `max_by` on the map side, so a busy key does not fill one task."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(pick.alias("__last")).select(*keys, "__last.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """old with new rows on top; of one key the last in `order` wins, new before old. Parquet has no MERGE, so callers write the result to a new directory."""
    both = old.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys, [F.col("__gen"), *(order or [])]).drop("__gen")


def append_log(old: DataFrame, new: DataFrame, seq: str = "id") -> DataFrame:
    """old and new, the new rows numbered on from the largest `seq`, in steps that need no global order."""
    top = old.agg(F.coalesce(F.max(seq), F.lit(0)).alias("__top"))
    numbered = new.withColumn(seq, F.monotonically_increasing_id() + 1)
    return old.unionByName(numbered.join(F.broadcast(top), how="cross").withColumn(seq, F.col(seq) + F.col("__top")).drop("__top"), allowMissingColumns=True)


def cache_hits(files: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose fingerprint is in the cache."""
    return files.join(cache.select(*keys).distinct(), keys, "left_semi")


def cache_misses(files: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return files.join(cache.select(*keys).distinct(), keys, "left_anti")


def without(df: DataFrame, when: Column) -> DataFrame:
    """A filtered delete: what remains is to be written to a new directory."""
    return df.filter(~F.coalesce(when, F.lit(False)))


# -- names ---------------------------------------------------------------------
def unique_names(entities: DataFrame, within: list[str] | None = None) -> DataFrame:
    """(..., name, qualified_name) of short names that stand for one qualified name, in each group of `within`."""
    keys = [*(within or []), "name"]
    return entities.groupBy(*keys).agg(F.min("qualified_name").alias("qualified_name"), F.max("qualified_name").alias("__other")).filter("qualified_name = __other").drop("__other")


def ambiguous_names(entities: DataFrame) -> DataFrame:
    """(name, candidates) of short names with several qualified names."""
    return entities.groupBy("name").agg(F.countDistinct("qualified_name").alias("candidates")).filter("candidates > 1")


def resolve_names(relationships: DataFrame, entities: DataFrame, within: dict[str, str] | None = None) -> DataFrame:
    """Fill a missing target_qname from the target's short name where that is unique among classes; ambiguous names stay null.

    `within` maps relationship columns to entity columns that must agree, a file for one.
    """
    classes = entities.filter(F.col("kind").isin(*CLASS_KINDS))
    names = unique_names(classes, list((within or {}).values()))
    for r, e in (within or {}).items():
        names = names.withColumnRenamed(e, f"__{r}")
    names = names.withColumnRenamed("name", "__short").withColumnRenamed("qualified_name", "__found")
    todo = relationships.withColumn("__short", F.when(F.col("target_qname").isNull(), last_segment(F.col("target_name"))))
    for r in within or {}:
        todo = todo.withColumn(f"__{r}", F.col(r))
    keys = ["__short", *[f"__{r}" for r in within or {}]]
    return todo.join(names, keys, "left").withColumn("target_qname", F.coalesce("target_qname", "__found")).select(*relationships.columns)


def chase_aliases(aliases: DataFrame, max_depth: int | None = MAX_ALIAS_DEPTH) -> DataFrame:
    """(alias, target, kind, depth): the end of each alias's chain of (alias, target, kind).

    The kind is the first on the way that is not null, so the outermost wrapper wins.
    Chains that end in a null target, or are longer than `max_depth`, cycles among them,
    are left out; with None chains of any length are followed, and cycles alone are left
    out. The table is unique in alias. Each round joins the table with itself, doubles the
    way looked ahead and is written; it ends when all chains have, or when a round ends
    none, as then only cycles and what leads into them are left.
    """
    scratch = Scratch(aliases.sparkSession, "aliases")
    first = aliases.select("alias", "target", "kind", F.lit(1).alias("depth"))
    names = aliases.select(F.col("alias").alias("target"), F.lit(True).alias("open")).distinct()
    table, n = scratch.counted(first.join(names, "target", "left").select("alias", "target", "kind", "depth", F.coalesce("open", F.lit(False)).alias("open")), F.col("open"))
    rounds = itertools.count() if max_depth is None else range(max(max_depth - 1, 0).bit_length())
    for _ in rounds:
        if not n:
            break
        before = n
        far = table.select(F.col("alias").alias("target"), F.col("target").alias("__next"), F.col("kind").alias("__kind"), F.col("depth").alias("__depth"), F.col("open").alias("__open"))
        on = table.filter("open").join(far, "target").select("alias", F.col("__next").alias("target"), F.coalesce("kind", "__kind").alias("kind"), (F.col("depth") + F.col("__depth")).alias("depth"), F.col("__open").alias("open"))
        table, n = scratch.counted(table.filter("NOT open").unionByName(on), F.col("open"))
        if n == before:
            break
    ended = table.filter(~F.col("open") & F.col("target").isNotNull())
    return (ended if max_depth is None else ended.filter(F.col("depth") <= max_depth)).drop("open")


def suffix_merges(entities: DataFrame) -> DataFrame:
    """(kind, qualified_name, merged): bare names that are the trailing segments of exactly one other name of their kind.

    Each name offers its proper suffixes, as many as it has segments less one, so this
    is one equi-join on whole suffixes, however often a last segment is used.
    """
    e = entities.select("kind", "qualified_name").distinct()
    segs = F.split("qualified_name", "::")
    suffixes = F.transform(F.sequence(F.lit(2), F.size("segs")), lambda i: F.array_join(F.slice("segs", i, F.size("segs")), "::"))
    long = e.withColumn("segs", segs).filter(F.size("segs") > 1).select("kind", F.col("qualified_name").alias("merged"), F.explode(suffixes).alias("qualified_name"))
    pairs = long.join(e, ["kind", "qualified_name"])
    return pairs.groupBy("kind", "qualified_name").agg(F.min("merged").alias("merged"), F.count(F.lit(1)).alias("__n")).filter("__n = 1").drop("__n")


def merge_tips(merges: DataFrame) -> DataFrame:
    """Merges followed to their end, however long the chain; those on or before a cycle keep their own target.

    Each round doubles the distance and is written; after as many as the number of
    merges has binary digits only cycles can be left.
    """
    scratch = Scratch(merges.sparkSession, "merge-tips")
    first, total = scratch.counted(merges.select("kind", "qualified_name", "merged"))
    names = first.select("kind", F.col("qualified_name").alias("merged"), F.lit(True).alias("open")).distinct()
    table, n = scratch.counted(first.join(names, ["kind", "merged"], "left").select("kind", "qualified_name", "merged", F.coalesce("open", F.lit(False)).alias("open")), F.col("open"))
    for _ in range(total.bit_length()):
        if not n:
            break
        far = table.select("kind", F.col("qualified_name").alias("merged"), F.col("merged").alias("__far"), F.col("open").alias("__open"))
        on = table.filter("open").join(far, ["kind", "merged"]).select("kind", "qualified_name", F.col("__far").alias("merged"), F.col("__open").alias("open"))
        table, n = scratch.counted(table.filter("NOT open").unionByName(on), F.col("open"))
    ended = table.filter("NOT open").select("kind", "qualified_name", "merged")
    return ended if not n else ended.unionByName(first.join(ended, ["kind", "qualified_name"], "left_anti"))


def phantom_parents(entities: DataFrame, order: list[Column]) -> DataFrame:
    """(qualified_name, file_path) of parents that methods or fields name but no entity is; the file is that of the first member."""
    members = entities.filter(F.col("kind").isin("method", "field") & F.col("parent_qname").isNotNull())
    missing = members.join(entities.select(F.col("qualified_name").alias("parent_qname")).distinct(), "parent_qname", "left_anti")
    return missing.groupBy("parent_qname").agg(F.min_by("file_path", F.struct(*order)).alias("file_path")).withColumnRenamed("parent_qname", "qualified_name")


def retag_inheritance(relationships: DataFrame, abstract: DataFrame) -> DataFrame:
    """inherits and implements set by whether the target is among the abstract names (qualified_name)."""
    marked = abstract.select(F.col("qualified_name").alias("target_qname")).distinct().withColumn("__abstract", F.lit(True))
    kind = F.when(F.col("kind").isin("inherits", "implements"), F.when(F.col("__abstract"), "implements").otherwise("inherits")).otherwise(F.col("kind"))
    return relationships.join(marked, "target_qname", "left").withColumn("kind", kind).select(*relationships.columns)


def refine_class_kinds(entities: DataFrame) -> DataFrame:
    """Per file: a class with a pure virtual method is abstract; one that also has no field and no other method but destructors is an interface."""
    members = entities.filter(F.col("kind").isin("method", "field")).groupBy("file_path", F.col("parent_qname").alias("qualified_name")).agg(
        F.max(F.col("kind") == "field").alias("__fields"), F.max(F.coalesce("pure", F.lit(False))).alias("__pure"),
        F.max((F.col("kind") == "method") & ~F.coalesce("pure", F.lit(False)) & ~F.col("name").startswith("~")).alias("__other"),
    )
    joined = entities.join(members, ["file_path", "qualified_name"], "left")
    is_class = F.col("kind").isin("class", "struct")
    abstract = is_class & F.coalesce("__pure", F.lit(False))
    interface = abstract & ~F.col("__fields") & ~F.col("__other")
    return joined.withColumn("abstract", abstract).withColumn("kind", F.when(interface, "interface").otherwise(F.col("kind"))).select(*dict.fromkeys([*entities.columns, "abstract"]))


# -- de-duplication ------------------------------------------------------------
def first_of(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    pick = F.min_by(F.struct(*df.columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*named).agg(pick.alias("__first")).select("__first.*")


def dedup_edges(relationships: DataFrame, order: list[Column]) -> DataFrame:
    """One edge for each source, target, kind, file and line; the first wins."""
    return first_of(relationships, [F.col("source_qname"), F.coalesce("target_qname", "target_name"), F.col("kind"), F.col("evidence_file"), F.col("evidence_line")], order)


def dedup_entities(entities: DataFrame, order: list[Column]) -> DataFrame:
    """One entity for each name and kind: a real one before a phantom, then that of most lines, then the first. It is a phantom only if all were."""
    keys = ["qualified_name", "kind"]
    phantom = F.coalesce(F.col("phantom"), F.lit(False))
    real = entities.groupBy(*keys).agg(F.min(phantom).alias("__phantom"))
    kept = first_of(entities, [F.col(k) for k in keys], [phantom, F.col("start_line") - F.col("end_line"), *order])
    return kept.join(real, keys).withColumn("phantom", F.col("__phantom")).select(*entities.columns)


# -- look-ups ------------------------------------------------------------------
def resolve_tiered(classes: DataFrame, query: str) -> DataFrame:
    """Classes that a loosely written name means, with the number of the best tier that any reaches; case does not count.

    1: the whole name. 2: the query's segments, parted by `::` or also by `_`, are the
    last segments of the name. 3: the query is a part of the name, `::` and `_` alike.
    """
    low = query.strip().lower()
    name = F.lower("qualified_name")
    segments, tail = F.split(name, "::"), F.lit(False)
    for pattern in (r"::|_", r"::"):
        wanted = [p for p in re.split(pattern, low) if p]
        if wanted:
            n = len(wanted)
            tail = tail | ((F.size(segments) >= n) & (F.slice(segments, F.greatest(F.size(segments) - n + 1, F.lit(1)), n) == F.array(*[F.lit(w) for w in wanted])))
    part = F.replace(name, F.lit("::"), F.lit("_")).contains(low.replace("::", "_"))
    tier = F.when(F.lit(low == ""), None).when(name == low, 1).when(tail, 2).when(part, 3)
    hits = classes.withColumn("tier", tier).filter("tier IS NOT NULL")
    return hits.join(F.broadcast(hits.agg(F.min("tier").alias("tier"))), "tier")


def resolve_file(files: DataFrame, query: str, path: str = "file_path") -> DataFrame:
    """Files by base name, else by the end of the path, else by a part of it; case does not count."""
    p, q = F.lower(path), query.lower()
    tier = F.when(F.element_at(F.split(p, "/"), -1) == q, 1).when(p.endswith(q), 2).when(p.contains(q), 3)
    hits = files.withColumn("tier", tier).filter("tier IS NOT NULL")
    return hits.join(F.broadcast(hits.agg(F.min("tier").alias("tier"))), "tier")


def source_lines(texts: DataFrame, text: str, start: int = 1, end: int = 300) -> DataFrame:
    """The lines from start to end, numbered, with the other columns."""
    cut = F.slice(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), start, max(0, end - start + 1))
    return texts.select(*[c for c in texts.columns if c != text], F.posexplode(cut).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + start).cast("long"))


# -- reports -------------------------------------------------------------------
def unresolved_ratio(relationships: DataFrame) -> DataFrame:
    """(total, unresolved, pct, caution): the share of relationships without a resolved target; null without rows."""
    pct = F.avg(F.when(F.col("target_qname").isNull(), 100.0).otherwise(0.0))
    return relationships.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("target_qname").isNull()).alias("unresolved"), pct.alias("pct")).withColumn("caution", F.coalesce(F.col("pct") > 25, F.lit(False)))


def member_counts(entities: DataFrame) -> DataFrame:
    """(qualified_name, methods, fields) of every class, 0 where it has none."""
    counts = entities.filter("parent_qname IS NOT NULL").groupBy("parent_qname").agg(F.count_if(F.col("kind") == "method").alias("methods"), F.count_if(F.col("kind") == "field").alias("fields"))
    classes = entities.filter(F.col("kind").isin(*CLASS_KINDS)).select("qualified_name").distinct()
    return classes.join(counts.withColumnRenamed("parent_qname", "qualified_name"), "qualified_name", "left").select("qualified_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("methods", "fields")])


def profile(entities: DataFrame, relationships: DataFrame, qname: str) -> DataFrame:
    """One row: a class's methods, fields, what it uses and what uses it, each as sorted names."""
    own = entities.filter(F.col("parent_qname") == qname).agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "method", F.col("name")))).alias("methods"), F.array_sort(F.collect_set(F.when(F.col("kind") == "field", F.col("name")))).alias("fields")
    )
    target = F.coalesce(F.nullif("target_qname", F.lit("")), F.col("target_name"))
    out, into = F.col("source_qname") == qname, F.col("target_qname") == qname
    sides = relationships.filter(out | into).agg(
        F.array_sort(F.collect_set(F.when(out & F.col("kind").isin("inherits", "implements"), target))).alias("bases"),
        F.array_sort(F.collect_set(F.when(out & ~F.col("kind").isin("inherits", "implements"), target))).alias("uses"),
        F.array_sort(F.collect_set(F.when(into & F.col("kind").isin("inherits", "implements"), F.col("source_qname")))).alias("subclasses"),
        F.array_sort(F.collect_set(F.when(into & ~F.col("kind").isin("inherits", "implements"), F.col("source_qname")))).alias("users"),
    )
    return own.join(F.broadcast(sides), how="cross").withColumn("qualified_name", F.lit(qname))  # one row each


def graph_fingerprint(relationships: DataFrame) -> DataFrame:
    """One row `fingerprint`: SHA-256 over the sorted lines source|target|kind.

    Lines are counted and sorted by ranges, and packed into blocks of neighbours. As the
    digest is defined over one text, a single task reads it: block by block in order, so
    it holds one batch of them and never the text. `incremental_fingerprint` has no such task.
    """
    spark = relationships.sparkSession
    bounded_batches(spark)
    counted = relationships.groupBy(_line().alias("line")).agg(F.count(F.lit(1)).alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lines, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([lines[0]]), pa.array([lines]), pa.array([n], pa.list_(pa.int64()))], ["first", "lines", "n"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, behind = hashlib.sha256(), ""
        for batch in batches:
            for lines, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for line, k in zip(lines, n):
                    sha.update((behind + line).encode())
                    behind = "\n"
                    again = ("\n" + line).encode()
                    step = max(1, (1 << 20) // len(again))
                    for done in range(1, k, step):
                        sha.update(again * min(step, k - done))
        yield pa.RecordBatch.from_arrays([pa.array([sha.hexdigest()])], ["fingerprint"])

    blocks = Scratch(spark, "fingerprint").write(counted.repartitionByRange("line").sortWithinPartitions("line").mapInArrow(pack, "first string, lines array<string>, n array<long>"))
    # Lines are distinct here, so blocks are in the order of their first lines.
    found = blocks.repartition(1).sortWithinPartitions("first").select("lines", "n").mapInArrow(digest, "fingerprint string")
    return found.agg(F.coalesce(F.max("fingerprint"), F.sha2(F.lit(""), 256)).alias("fingerprint"))


def incremental_fingerprint(relationships: DataFrame) -> DataFrame:
    """One row `fingerprint` that depends on the bag of lines only: sums of hashes, for graphs whose lines fit no single task."""
    h = F.sha2(_line(), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    return relationships.agg(F.count(F.lit(1)).alias("n"), *parts).select(F.sha2(F.concat_ws("|", "n", *[f"p{i}" for i in range(4)]), 256).alias("fingerprint"))


def fingerprint_tree(relationships: DataFrame, key: str = "evidence_file", digits: int = 3) -> DataFrame:
    """(level, node, n, p0..p3, digest): a hash tree over ranges of the key's SHA-256.

    A leaf is named by the first `digits` hexadecimal digits of its keys' hash (null as an
    empty key) and holds the number of its lines and sums of their hashes, so that no list
    of lines is made and a busy key is summed where it lies; its digest is that of these
    numbers. A node above has one digit less, at most 16 children, and the digest of their
    names and digests in order. The root has no digits; a tree without lines has no rows.
    """
    h, empty = F.sha2(_line(), 256), F.lit("")
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    node = F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), empty), 256), 1, digits)
    return _tree(relationships.groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("n"), *parts), digits)


def _tree(leaves: DataFrame, digits: int) -> DataFrame:
    """All levels over leaves (node, n, p0..p3)."""
    sums = [f"p{i}" for i in range(4)]
    out = level = leaves.select(F.lit(digits).alias("level"), "node", "n", *sums, F.sha2(F.concat_ws("|", "n", *sums), 256).alias("digest"))
    for d in range(digits - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.concat("node", F.lit(":"), "digest")))
        above = level.groupBy(F.substring("node", 1, d).alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(children, ","), 256).alias("digest"))
        level = above.select(F.lit(d).alias("level"), "node", "n", *[F.lit(None).cast("decimal(38,0)").alias(p) for p in sums], "digest")
        out = out.unionByName(level)
    return out


def refreshed_tree(tree: DataFrame, gone: DataFrame, came: DataFrame, key: str = "evidence_file", digits: int = 3) -> DataFrame:
    """The tree after the lines `gone` have left and `came` have come; only these are read and hashed, and a leaf without lines left goes."""
    sums = ["n", *[f"p{i}" for i in range(4)]]
    leaves = lambda t: t.filter(F.col("level") == digits).select("node", *sums)
    less = leaves(fingerprint_tree(gone, key, digits)).select("node", *[(-F.col(c)).alias(c) for c in sums])
    every = leaves(tree).unionByName(less).unionByName(leaves(fingerprint_tree(came, key, digits)))
    return _tree(every.groupBy("node").agg(*[F.sum(c).cast("long" if c == "n" else "decimal(38,0)").alias(c) for c in sums]).filter("n <> 0"), digits)


def changed_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(level, node) whose digests differ between two trees, nodes of one tree only among them."""
    side = lambda t, c: t.select("level", "node", F.col("digest").alias(c))
    return side(old, "a").join(side(new, "b"), ["level", "node"], "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("level", "node")


def _line() -> Column:
    return F.concat_ws("|", "source_qname", F.coalesce(F.nullif("target_qname", F.lit("")), F.col("target_name")), "kind")


def fail_open(findings: DataFrame, verdicts: DataFrame, keys: list[str], flag: str = "is_real") -> DataFrame:
    """Findings but those that a verdict denies; without a verdict a finding stays."""
    return findings.join(verdicts.select(*keys, flag), keys, "left").filter(F.coalesce(F.col(flag), F.lit(True))).drop(flag)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 64) -> DataFrame:
    """The first k rows of each key in order, ranked within salted parts first, so that a busy key does not fill one task."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    for by in ([*keys, "__salt"], keys):
        salted = salted.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__place") <= k)
    return salted.drop("__salt", "__place")
