"""Centroid clustering by weighted de-duplication.

Vectors are put on an integer lattice and equal ones grouped; Lloyd's rounds then run
on the distinct vectors, each weighing as many rows as it stands for. Each task adds up
its part of every centroid's sums, so a round shuffles a row a task and centroid, and
the driver gets k rows. At last the assignments are joined back to the ids.

Defined results: vectors that are null, of another length, or hold null, non-finite or
very large components (lattice.LARGEST) take no part and have no row. The first
centroids are the vectors with the smallest SHA-256 of `1:<id>`, null ids last, equal
ids by vector; with fewer vectors than centroids there are as many centroids as
vectors. Ties go to the smaller centroid; an empty centroid stays. Repeated rows are
rows of their own; an empty table gives no rows. Only id and vector are read, so
further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.lattice import join_values, matrix, nearest, quantised
from codestrata.llm.text import bounded_batches
from codestrata.session import Scratch

SUMS = "cluster int, n long, sums array<long>"


def seeds(rows: DataFrame, k: int) -> np.ndarray:
    """The first centroids, from rows (id, q)."""
    marked = rows.select(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).alias("mark"), "q")
    return np.array([r["q"] for r in marked.orderBy(F.asc_nulls_last("mark"), "q").limit(k).collect()], np.int64)


def moved(distinct: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centroids after a round over the distinct vectors (q, n)."""
    k, dim = centres.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            x, w = matrix(b["q"], dim), b["n"].to_numpy()
            at, _ = nearest(x, centres)
            np.add.at(n, at, w)
            np.add.at(total, at, x * w[:, None])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    added = distinct.mapInArrow(sums, SUMS).groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(dim)]).alias("sums"))
    out = centres.copy()
    for r in added.collect():
        out[r["cluster"]] = [s // r["n"] for s in r["sums"]]
    return out


def assigned(distinct: DataFrame, centres: np.ndarray) -> DataFrame:
    """Distinct vectors (q, n) with their cluster and squared distance."""
    dim = centres.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d = nearest(matrix(b["q"], dim), centres)
            yield pa.RecordBatch.from_arrays([b["q"], b["n"], pa.array(at, pa.int32()), pa.array(d)], ["q", "n", "cluster", "distance"])

    return distinct.mapInArrow(assign, "q array<int>, n long, cluster int, distance long")


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64) -> DataFrame:
    """One row for each vector that takes part: id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "clustering")
    vectors = df.filter(F.size(vec_col) == dim).select(F.col(id_col).alias("id"), quantised(F.col(vec_col), scale).alias("q")).filter("q IS NOT NULL")
    rows, n_rows = scratch.counted(vectors)
    centres = seeds(rows, k)
    if not n_rows:
        centres = np.zeros((1, dim), np.int64)
    distinct = scratch.write(rows.groupBy("q").agg(F.count(F.lit(1)).alias("n")))
    for _ in range(rounds):
        centres = moved(distinct, centres)
    found = scratch.write(assigned(distinct, centres))
    spread = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum((F.col("distance") * F.col("n")).cast("decimal(38,0)")).alias("s")).collect()}
    pick = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))  # noqa: E731  one value a centroid
    named = [",".join(map(str, c)) for c in centres.tolist()]
    return join_values(rows, found, "q", n_rows).select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        pick([spread.get(i, 0) for i in range(len(centres))], "long").alias("cluster_inertia"),
        F.lit(sum(spread.values())).cast("long").alias("inertia"),
        pick([hashlib.sha256(c.encode()).hexdigest() for c in named], "string").alias("centroid_sha256"),
    )
