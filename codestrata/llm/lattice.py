"""Vectors on an integer lattice, and what the exact clusterings of such vectors share.

Components are multiplied by a scale and floored; from then on all sums, distances and
means are integers, so results do not depend on the order in which Spark adds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond this no distance is sure to fit a long; a vector that goes beyond takes no part.
LARGEST = 1 << 26
#: A key with this share of all rows or more counts as hot, so there are 1,024 hot keys at most.
HOT_SHARE = 1024


def quantised(vec: Column, scale: int) -> Column:
    """array<int> of floor(scale * x), x as double; null if a component is null, not finite or beyond LARGEST, or the vector is null."""
    inside = F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < LARGEST, F.lit(False)))  # false for NaN, too: it is larger than all
    return F.when(inside, F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of `width` integers as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), width)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the number of the nearest centre (ties: the smaller) and the squared distance, exactly.

    Doubles are exact while all sums stay below 2**53; larger components go through integers.
    """
    far = max(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * far * far < 1 << 53 else np.int64
    a, c = x.astype(kind), centres.astype(kind)
    d = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best].astype(np.int64)


def join_values(rows: DataFrame, values: DataFrame, key: str, n_rows: int, count: str = "n") -> DataFrame:
    """Rows with the columns of `values`, which has one row for each key of `rows` and how many rows that key has.

    A key of a thousandth of all rows or more (1,024 such keys at most) is joined by
    broadcast, so its rows stay where they are; the others are shuffled. Null is a key.
    """
    values = values.withColumnRenamed(key, "__key")
    hot, cold = values.filter(F.col(count) * HOT_SHARE >= n_rows), values.filter(F.col(count) * HOT_SHARE < n_rows)
    same = F.col(key).eqNullSafe(F.col("__key"))
    near = rows.join(F.broadcast(hot), same)
    far = rows.join(F.broadcast(hot.select("__key")), same, "left_anti").join(cold, same)
    return near.unionByName(far).drop("__key", count)
