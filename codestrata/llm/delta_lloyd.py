"""Vector codes from product codebooks, trained by delta-maintained rounds.

Vectors are put on an integer lattice and cut into equal parts; each part position has
a codebook. The assignments of a round are stored with the vectors, and the driver
holds the running sum and number of parts of every codebook entry. A round assigns
anew, and only parts whose entry has changed contribute: plus to the new one, minus to
the old one, added up in each task before the shuffle. So rounds get cheaper as the
codebooks settle, and the sums stay exact.

Defined results: vectors that are null or hold null, non-finite or very large components
(lattice.LARGEST) have no row. All vectors have the length of that with the smallest id
among those whose length is a multiple of the parts; codes of others are not defined
and they have no row either. The first entries are the parts of the vectors of the
smallest ids, null ids last, equal ids by vector; with fewer vectors than entries there
are as many entries. Ties go to the smaller entry; an unused entry stays. Repeated rows
are rows of their own; null labels form one group; an empty table gives no rows. Only
id, vector and label are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.lattice import join_values, matrix, nearest, quantised
from codestrata.llm.text import bounded_batches
from codestrata.session import Scratch


class Codebooks:
    """Entries (part, entry, component) with the running sums and numbers of the parts assigned to them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.n = np.zeros(entries.shape[:2], np.int64)
        self.sums = np.zeros(entries.shape, np.int64)

    def add(self, part: int, entry: int, n: int, sums: list[int]) -> None:
        self.n[part, entry] += n
        self.sums[part, entry] += sums

    def move(self) -> None:
        """Every used entry becomes the floored mean of its parts."""
        used = self.n > 0
        self.entries = self.entries.copy()
        self.entries[used] = self.sums[used] // self.n[used][:, None]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _cut(lists: pa.Array, shape: tuple[int, int]) -> np.ndarray:
    """Vectors as (row, part, component)."""
    return matrix(lists, shape[0] * shape[1]).reshape(len(lists), *shape)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def encoded(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """Rows (id, label, q, ...) with their code, the code they had before if there was one, and the squared error."""
    parts, _, width = entries.shape
    out = T.StructType([*(rows.schema[c] for c in ("id", "label", "q")), T.StructField("code", T.BinaryType()), T.StructField("before", T.BinaryType()), T.StructField("error", T.LongType())])
    had = "code" in rows.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _cut(b["q"], (parts, width))
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                code[:, p], d = nearest(x[:, p], entries[p])
                error += d
            named = pa.array([c.tobytes() for c in code], pa.binary())
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], b["q"], named, b["code"] if had else pa.nulls(len(x), pa.binary()), pa.array(error)], ["id", "label", "q", "code", "before", "error"])

    return rows.mapInArrow(assign, out)


def deltas(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(part, entry, n, sums): what the parts whose entry is another than before add and take away."""
    parts, size, width = shape

    def contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, size), np.int64), np.zeros(shape, np.int64)
        touched = np.zeros((parts, size), bool)
        for b in batches:
            x, new = _cut(b["q"], (parts, width)), _codes(b["code"], parts)
            known = b["before"].null_count == 0 and len(x) > 0
            old = _codes(b["before"], parts) if known else new
            row, part = np.nonzero(new != old if known else np.ones(new.shape, bool))
            for sign, code in ((1, new), (-1, old))[: 2 if known else 1]:
                at = (part, code[row, part])
                np.add.at(n, at, sign)
                np.add.at(total, at, sign * x[row, part])
                touched[at] = True
        p, e = np.nonzero(touched)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    changed = rows.filter("before IS NULL OR before <> code").select("q", "code", "before")
    each = changed.mapInArrow(contributions, "part int, entry int, n long, sums array<long>")
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """One row for each vector that takes part: id, code (two hex digits a part), error, label_error and codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part")
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "codes")
    vectors = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), quantised(F.col(vec_col), scale).alias("q")).filter((F.size("q") > 0) & (F.size("q") % parts == 0))
    first = vectors.select("id", "q").orderBy(F.asc_nulls_last("id"), "q").limit(1).collect()
    dim = len(first[0]["q"]) if first else parts
    rows, n_rows = scratch.counted(vectors.filter(F.size("q") == dim))
    start = [r["q"] for r in rows.select("id", "q").orderBy(F.asc_nulls_last("id"), "q").limit(entries).collect()] or [[0] * dim]
    books = Codebooks(np.array(start, np.int64).reshape(len(start), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        rows = scratch.write(encoded(rows, books.entries))
        scratch.drop(keep=1)
        for r in deltas(rows, books.entries.shape).collect():  # parts x entries rows at most
            books.add(r["part"], r["entry"], r["n"], r["sums"])
        books.move()
    coded = scratch.write(encoded(rows, books.entries).select("id", "label", "code", "error"))
    scratch.drop(keep=1)
    per_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return join_values(coded, per_label, "label", n_rows).select(F.col("id").alias(id_col), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
