"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands propose, exact sets decide.

A text is the set of the XXH64 of its `shingle`-word shingles. Texts of equal sets
are one node. A node has BANDS keys of ROWS minima each; two nodes of similarity s
have a key in common with chance 1 - (1 - s^ROWS)^BANDS, which is 0.99997 at 0.8.
Every proposed pair is checked on the whole sets.

In a bucket all members are held against its smallest and its largest node first,
which joins most groups. Buckets whose members are still in different components are
cut into chunks; a cell, one chunk against another, counts what its sets have in common
by matrix products and returns a spanning forest of its links, never pairs. All chunks
of a bucket meet, so nothing is capped.

Defined results: null and wordless texts have the empty set and are one node; texts
of fewer words than a shingle are one shingle; letters A-Z fold to lower case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm import simhash
from codestrata.llm.components import connected_components
from codestrata.llm.pstable import forest_roots
from codestrata.llm.text import bounded_batches, release_memory
from codestrata.session import Scratch

SHINGLE = 5
TENTHS = 8  # the least similarity, in tenths, so that the check is exact
BANDS, ROWS = 20, 4
CHUNK, CHUNK_BYTES = 256, 4 << 20  # members of a chunk, and bytes of their sets
COLUMNS = 8192  # shingles that a cell counts at a time
SALTS = 16  # copies of a bucket's pivots, so that one pivot does not fill one task
AT_ONCE = 1 << 16  # shingles whose hashes are permuted together
SIGNATURE = T.StructType().add("fp", T.LongType()).add("bands", T.ArrayType(T.LongType()))
ODD = np.random.default_rng(42).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order."""
    count, words = simhash.split_words(texts)
    words, out, at = words.to_pylist(), [], 0
    for n in count.tolist():
        w = words[at : at + n]
        at += n
        found = {xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]), simhash.SEED) for i in range(max(1, n - shingle + 1))} if n else ()
        out.append(np.sort(np.fromiter(found, np.uint64, len(found))))
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, BANDS): a key of each band's minima; the empty set has zeros."""
    least = np.full((len(sets), BANDS * ROWS), np.iinfo(np.uint64).max)
    for i, s in enumerate(sets):
        for a in range(0, len(s), AT_ONCE // 64):
            h = s[a : a + AT_ONCE // 64, None] * ODD[0] + ODD[1]
            least[i] = np.minimum(least[i], (h ^ (h >> np.uint64(31))).min(axis=0))
    key = np.zeros((len(sets), BANDS), np.uint64)
    for r in range(ROWS):
        key = (key ^ least[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    key[[len(s) == 0 for s in sets]] = 0
    return key


@F.arrow_udf(SIGNATURE)
def _signature(texts: pa.Array, shingle: pa.Array) -> pa.Array:
    sets = shingle_sets(texts, shingle[0].as_py()) if len(texts) else []
    fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], np.uint64).view(np.int64)
    keys = band_keys(sets).view(np.int64)
    bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
    release_memory()
    return pa.StructArray.from_arrays([pa.array(fp), bands], ["fp", "bands"])


@F.arrow_udf(T.BinaryType())
def _set(texts: pa.Array, shingle: pa.Array) -> pa.Array:
    out = pa.array([s.tobytes() for s in shingle_sets(texts, shingle[0].as_py())] if len(texts) else [], pa.binary())
    release_memory()
    return out


def similar(a: np.ndarray, b: np.ndarray, tenths: int = TENTHS) -> bool:
    """Whether the Jaccard similarity of two ordered sets is at least so many tenths."""
    if 10 * min(len(a), len(b)) < tenths * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 10 * common >= tenths * (len(a) + len(b) - common)


@F.arrow_udf(T.BooleanType())
def _similar(a: pa.Array, b: pa.Array, tenths: pa.Array) -> pa.Array:
    t = tenths[0].as_py() if len(tenths) else TENTHS
    return pa.array([similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), t) for x, y in zip(a, b)], pa.bool_())


def cell_links(sets: list[np.ndarray], left: np.ndarray | None, tenths: int) -> np.ndarray:
    """The root of each set in a spanning forest of the links of similarity `tenths`; with `left`, only links between a left and a right set."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [a, a + COLUMNS])
        held = np.zeros((n, COLUMNS), np.float32)
        held[owner[i:j], column[i:j] - a] = 1
        common += held @ held.T
    linked = 10 * common.astype(np.int64) >= tenths * (size[:, None] + size[None, :] - common.astype(np.int64))
    if left is not None:
        linked &= left[:, None] != left[None, :]
    return forest_roots(linked)


@F.arrow_udf(simhash.EDGES)
def _cell_edges(cells: pa.Array, across: pa.Array, tenths: pa.Array) -> pa.Array:
    edges = []
    for cell, both, t in zip(cells.to_pylist(), across.to_pylist(), tenths.to_pylist()):
        fp = [m["fp"] for m in cell]
        root = cell_links([np.frombuffer(m["grams"], np.uint64) for m in cell], np.array([m["left"] for m in cell]) if both else None, t)
        edges.append([{"u": fp[r], "v": fp[i]} for i, r in enumerate(root.tolist()) if r != i])
    release_memory()
    return pa.array(edges, pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int64())])))


def _verified(pairs: DataFrame, sets: DataFrame, tenths: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    left = salted.select("u", "salt").distinct().join(sets.select(F.col("fp").alias("u"), F.col("grams").alias("a")), "u")
    both = salted.join(sets.select(F.col("fp").alias("v"), F.col("grams").alias("b")), "v").join(left, ["u", "salt"])
    return both.filter(_similar("a", "b", F.lit(tenths))).select("u", "v")


def links(nodes: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int = SHINGLE, tenths: int = TENTHS, proposed: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) among nodes (fp, bands) that connect all that meet in a band and are similar; texts is (fp, text). Pairs (u, v) that are `proposed` are checked, too."""
    own = Scratch(nodes.sparkSession, "shingle-links")
    tables = nodes.select("fp", F.posexplode("bands").alias("t", "k"))
    ends = tables.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1")
    met = own.write(tables.join(ends, ["t", "k"]))
    pivots = F.explode(F.array(F.col("lo"), F.col("hi"))).alias("p")
    pair = lambda df, a, b: df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    first = own.write(pair(met.select("fp", pivots), "p", "fp"))
    named = met.select("fp")
    if proposed is not None:
        first = own.write(first.unionByName(pair(proposed, "u", "v")).distinct())
        named = named.union(proposed.select("u")).union(proposed.select("v"))
    one = texts.join(named.distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("text").alias("text"))
    sets = own.write(one.select("fp", _set("text", F.lit(shingle)).alias("grams")))
    found = own.write(_verified(first, sets, tenths))
    label = connected_components(found).select(F.col("node").alias("fp"), "label")
    member = own.write(met.filter("n > 2").select("t", "k", "fp").join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    mixed = member.groupBy("t", "k").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("t", "k")
    apart = own.write(member.join(mixed, ["t", "k"]).select("t", "k", "fp").join(sets, "fp"))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum(F.octet_length("grams")) / CHUNK_BYTES)).cast("int")
    spread = apart.join(apart.groupBy("t", "k").agg(parts.alias("parts")), ["t", "k"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    met = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = F.least("part", "other"), F.greatest("part", "other")
    cells = met.groupBy("t", "k", a.alias("a"), b.alias("b")).agg(F.collect_list(F.struct("fp", "grams", (F.col("part") == a).alias("left"))).alias("m"))
    edges = cells.select(F.explode(_cell_edges("m", F.col("a") != F.col("b"), F.lit(tenths))).alias("e")).select("e.u", "e.v")
    out = scratch.write(found.unionByName(edges).distinct())
    own.drop()  # the sets among them
    return out


def fingerprint_pairs(rows: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """Pairs (u, v) of nodes, from rows (fp, bits): of equal SimHash fingerprints `bits`, each node with the least; of fingerprints that link, the least nodes."""
    held = scratch.write(rows.distinct())
    least = scratch.write(held.groupBy("bits").agg(F.min("fp").alias("least")))
    near = simhash.links(least.select(F.col("bits").alias("fp")), scratch, radius)
    end = lambda c, to: least.select(F.col("bits").alias(c), F.col("least").alias(to))
    apart = near.join(end("u", "a"), "u").join(end("v", "b"), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    equal = held.join(least, "bits").filter("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    return scratch.write(apart.unionByName(equal))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tenths: int = TENTHS, radius: int | None = None) -> DataFrame:
    """The rows of df that remain when one of each component stays, chosen as by simhash.deduplicate.

    With a `radius`, SimHash fingerprints that differ in no more bits propose pairs, too.
    """
    bounded_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "shingle-dedup")
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]  # own names cannot clash
    row_id, text = (F.col(f"c{df.columns.index(c)}") for c in (id_col, text_col))
    bits = [] if radius is None else [simhash.fingerprint(F.col(text_col)).alias("bits")]
    rows = scratch.write(df.select(*columns, _signature(F.col(text_col), F.lit(shingle)).alias("s"), *bits))
    nodes = scratch.write(rows.groupBy("s.fp").agg(F.min("s.bands").alias("bands"), F.min(row_id).alias("least_id")))
    proposed = None if radius is None else fingerprint_pairs(rows.select("s.fp", "bits"), scratch, radius)
    label = connected_components(links(nodes.select("fp", "bands"), rows.select("s.fp", text.alias("text")), scratch, shingle, tenths, proposed))
    return simhash.one_of_each(rows.withColumn("fp", F.col("s.fp")).drop("s", "bits"), simhash.labelled(nodes, label), df.columns, row_id)
