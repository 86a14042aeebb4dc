"""SimHash near-duplicates through pigeonhole blocks.

A 64-bit fingerprint is cut into `blocks` parts. Two fingerprints that differ in
at most `radius` bits agree on at least blocks - radius parts, so a table for
every choice of that many parts, keyed by their bits, puts each such pair into a
common bucket; Hamming distances are then checked. The default, 3 of 7 parts, has
35 tables with keys of 27 or 28 bits. Only distinct fingerprints enter the tables,
so exact copies cost nothing here.

A bucket never becomes pairs. One of two members is verified in place. A larger
one is cut into chunks of at most about `chunk` fingerprints; each pair of chunks
is a cell, and a cell returns a spanning forest of its links: at most one edge
for each member. Every pair of a bucket meets in some cell, so nothing is capped.

Defined results: a null or wordless text has fingerprint 0 and links like any
other; texts of fewer words than a shingle hash as a whole; copies share a
fingerprint and so a component; repeated rows come back as often as given; rows
with null ids get their component but never name one; an empty table gives no
rows. Only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.components import connected_components
from codestrata.llm.text import bounded_batches, release_memory
from codestrata.session import Scratch

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCKS = 7
CHUNK = 2048
EDGES = T.ArrayType(T.StructType().add("u", T.LongType()).add("v", T.LongType()))
AT_ONCE = 1 << 17  # shingles whose bits are unpacked together


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text and all words in a row; A-Z in lower case, nulls as empty texts."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, parent = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(words), 0)
    return np.bincount(parent.filter(full).to_numpy(), minlength=len(texts)), words.filter(full)


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text, unsigned: a bit is 1 if set in over half the XXH64 of its word shingles, repeats included."""
    count, words = split_words(texts)
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(count) - count
    start = np.cumsum(length + 1) - length - 1  # in the words joined by single spaces
    end = start + length
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().encode() if len(words) else b""

    shingles = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
    owner = np.repeat(np.arange(len(count)), shingles)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(at + shingle, first[owner] + count[owner]) - 1
    ones, digest = np.zeros((len(count), 64), np.int64), xxhash.xxh64_intdigest
    for a in range(0, len(owner), AT_ONCE):
        b = min(a + AT_ONCE, len(owner))
        h = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(start[at[a:b]].tolist(), end[last[a:b]].tolist())), ">u8", b - a)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        doc = owner[a:b]
        cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        ones[doc[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > shingles[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


@F.arrow_udf(T.LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    out = pa.array(fingerprints(texts).view(np.int64))
    release_memory()
    return out


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long with the same bits."""
    return _fingerprint(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Signed masks, one for every choice of blocks - radius of the blocks."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    masks = [sum(c) for c in combinations(part, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints, found breadth-first."""
    left, edges = members.view(np.uint64), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                edges += [(x, y) for y in left[near]]
                front += list(left[near])
                left = left[~near]
    return np.array(edges, np.uint64).view(np.int64).tolist() if edges else []


@F.arrow_udf(EDGES)
def _forest(cells: pa.Array, radius: pa.Array) -> pa.Array:
    r, at, values = radius[0].as_py() if len(radius) else 0, cells.offsets.to_numpy(), cells.values.to_numpy()
    found = [forest(values[a:b], r) for a, b in zip(at, at[1:])]
    u, v = (pa.array([e[i] for f in found for e in f], pa.int64()) for i in (0, 1))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays([u, v], ["u", "v"]))


def links(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) between distinct fingerprints `fp` at up to `radius` differing bits that connect all that link."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(block_masks(blocks, radius))]))
    tables = fps.select("fp", keys.alias("b")).select("b.t", "b.k", "fp")
    buckets = scratch.write(tables.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1"))
    pairs = buckets.filter((F.col("n") == 2) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)).select("u", "v").distinct()
    large = tables.join(buckets.filter("n > 2").select("t", "k", F.ceil(F.col("n") / chunk).cast("int").alias("parts")), ["t", "k"])
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = large.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = met.groupBy("t", "k", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")).agg(F.collect_list("fp").alias("fps"))
    found = cells.select(F.explode(_forest("fps", F.lit(radius))).alias("e")).select("e.u", "e.v").distinct()
    return pairs.unionByName(found)


def components(rows: DataFrame, scratch: Scratch, id_col: str = "doc_id", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, label, component_id) for the distinct fingerprints of rows (id, fp).

    The component's label is its smallest fingerprint, its id the smallest id that is reachable.
    """
    nodes = scratch.write(rows.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    return labelled(nodes, connected_components(links(nodes.select("fp"), scratch, radius, blocks)))


def labelled(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """(fp, label, component_id) from nodes (fp, least_id) and the labels (node, label) of those that link."""
    full = nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = full.groupBy("label").agg(F.min("least_id").alias("component_id"))
    return full.join(least, "label").select("fp", "label", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All rows as (id, fingerprint in hex, component_id)."""
    bounded_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "simhash")
    rows = scratch.write(df.select(F.col(id_col), fingerprint(F.col(text_col)).alias("fp")))
    return rows.join(components(rows, scratch, id_col, radius, blocks), "fp").select(id_col, as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """The rows of df that remain when one of each component stays, that of the smallest id, with all their columns.

    Of rows repeated with that id, and of a component without ids, one row stays as well.
    """
    bounded_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "simhash-dedup")
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]  # own names cannot clash
    row_id = f"c{df.columns.index(id_col)}"
    rows = scratch.write(df.select(*columns, fingerprint(F.col(text_col)).alias("fp")))
    found = components(rows.select(F.col(row_id).alias("id"), "fp"), scratch, "id", radius, blocks)
    return one_of_each(rows, found, df.columns, F.col(row_id))


def one_of_each(rows: DataFrame, found: DataFrame, columns: list[str], row_id: Column) -> DataFrame:
    """One of the rows (c0, c1, ..., fp) of each component, under their columns' names."""
    first = rows.join(found, "fp").filter(row_id.eqNullSafe(F.col("component_id")))
    order = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(*[f"c{i}" for i in range(len(columns))])))
    kept = first.withColumn("place", order).filter("place = 1")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
