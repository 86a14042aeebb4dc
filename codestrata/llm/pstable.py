"""Euclidean p-stable hashing of normalised vectors: search and near-duplicates.

A table has `hashes` Gaussian projections, shifted, divided by `width` and
floored; the integers name a bucket, as a 32-bit key. The number of hashes grows
with the logarithm of the number of distinct vectors, so that buckets of unlike
vectors keep their size; the number of tables follows from the wanted recall.
Equal vectors form a class, hashed once; a class stands for its rows by their
number or their least ids.

Buckets are cut into chunks of bounded size; a cell, one chunk against another, is
one matrix product and returns a few rows for each member, never pairs. All chunks
of a bucket meet, each pair under a join key of its own, so a crowded bucket becomes
more cells in more tasks and is not capped.

Search: a query visits the buckets next to its own in each table in order of the
estimated chance that they hold its neighbours. Perturbation sets are taken from a
heap over the ranks of the distances to the walls (Lv et al., 2007), one sequence
for all queries. Probes come in rounds: after each, the distance of the k-th nearest
found gives the chance that a vector at that distance lies in a bucket already
visited, and so how many probes more each query needs; those with near neighbours stop
early and only those without go on.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of different lengths never meet; ties go to the
smaller id; an empty table gives no rows. A row with a null id counts as a link of
others and takes their component, but never names one and is neither query nor
candidate of the search. Repeated ids are rows of their own. Only id and vector are
read, so further columns cannot clash.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.components import connected_components
from codestrata.llm.text import bounded_batches
from codestrata.session import Scratch


def usable(vec: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def _keyed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Usable rows as (id, vec, h1, h2); 96 bits of hash stand for the vector in joins."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter(usable(F.col("vec")))
    return rows.select("id", "vec", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def collision(distance: float, width: float) -> float:
    """The chance that two points at a distance share a floored projection (Datar et al., 2004)."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def hashes_for(n: int, width: float, per_bucket: float, least: int = 4) -> int:
    """How many hashes leave about `per_bucket` of n unlike (orthogonal) unit vectors in a bucket."""
    return max(least, round(math.log(max(n, 2) / per_bucket) / -math.log(collision(math.sqrt(2), width))))


@lru_cache(maxsize=8)
def perturbations(hashes: int, n: int) -> np.ndarray:
    """(sets, 2 * hashes): the first n perturbation sets by expected cost, the empty one first, as 0/1 over ranks of wall distances.

    Rank r and rank 2 * hashes - 1 - r are the two walls of one hash, so no set has both.
    """
    m = 2 * hashes
    cost = [j * (j + 1) / (4 * (hashes + 1) * (hashes + 2)) if j <= hashes else 1 - (m + 1 - j) / (hashes + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (hashes + 1) * (hashes + 2)) for j in range(1, m + 1)]
    found: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(found) < n:
        c, ranks = heapq.heappop(heap)
        if len({min(r, m - 1 - r) for r in ranks}) == len(ranks):
            found.append(ranks)
        last = ranks[-1]
        if last + 1 < m:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*ranks, last + 1)))
    out = np.zeros((len(found), m), np.int64)
    for i, ranks in enumerate(found):
        out[i, list(ranks)] = 1
    return out


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 2e-4."""
    return 1 / (1 + np.exp(np.clip(-1.5976 * x - 0.07056 * x**3, -500, 500)))


class Tables:
    """The projections of all tables for vectors of one length."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.shape, self.width, self.dim = (tables, hashes), width, dim
        self.a = rng.standard_normal((dim, tables * hashes))
        self.b = rng.uniform(0, width, tables * hashes)
        self.mix = rng.integers(1, 2**62, (tables, hashes), dtype=np.int64) | 1

    def project(self, x: np.ndarray) -> np.ndarray:
        """Positions (row, table, hash) in units of the width."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return ((unit @ self.a + self.b) / self.width).reshape(len(x), *self.shape)

    def _name(self, k: np.ndarray) -> np.ndarray:
        k = k + self.dim
        k ^= (k >> 29) & 0x7FFFFFFFF
        return ((k * np.int64(0x2545F4914F6CDD1D)) >> 32).astype(np.int32)

    def keys(self, at: np.ndarray) -> np.ndarray:
        """Positions (row, table, hash) to the keys (row, table) of their buckets."""
        with np.errstate(over="ignore"):
            return self._name((np.floor(at).astype(np.int64) * self.mix).sum(axis=-1))

    def _walls(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in the bucket, and the walls (all lower, then all upper) in order of their distance."""
        part = at - np.floor(at)
        return part, np.argsort(np.concatenate([part, 1 - part], axis=-1), axis=-1, kind="stable")

    def probes(self, at: np.ndarray, first: int, last: int) -> np.ndarray:
        """Keys (row, table, probe) of the buckets first to last in the order of their estimated chance."""
        sets = perturbations(self.shape[1], last)[first:last]
        _, order = self._walls(at)
        with np.errstate(over="ignore"):
            step = np.take_along_axis(np.broadcast_to(np.concatenate([-self.mix, self.mix], axis=-1), order.shape), order, -1)
            return self._name((np.floor(at).astype(np.int64) * self.mix).sum(axis=-1)[..., None] + step @ sets.T)

    def success(self, at: np.ndarray, probes: int, distance: np.ndarray) -> np.ndarray:
        """(row, probe): the chance that a point at each row's distance lies in one of its first 1, 2, ... buckets of some table."""
        sets = perturbations(self.shape[1], probes)
        part, order = self._walls(at)
        x = 1 / (np.maximum(distance, 1e-9)[:, None, None] / self.width)
        below, above = _normal(-part * x), _normal((1 - part) * x)
        own = np.maximum(above - below, 1e-12)
        beside = np.concatenate([below - _normal((-1 - part) * x), _normal((2 - part) * x) - above], axis=-1)
        ratio = np.log(np.maximum(beside, 1e-12)) - np.log(np.concatenate([own, own], axis=-1))
        chance = np.exp(np.log(own).sum(axis=-1)[..., None] + np.take_along_axis(ratio, order, -1) @ sets.T.astype(float)).cumsum(axis=-1)
        return 1 - np.prod(1 - np.minimum(chance, 1), axis=1)


def _by_length(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch with vectors of one length, of at most so many rows."""
    sizes = batch["vec"].value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        part = batch.filter(pa.array(sizes == dim))
        for i in range(0, len(part), rows):
            yield int(dim), part.slice(i, rows)


def _hashed(df: DataFrame, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    """df with `keys`: a key per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch in batches:
            for dim, b in _by_length(batch, 4096):
                t = made.setdefault(dim, Tables(dim, tables, hashes, width, seed))
                k = t.keys(t.project(_matrix(b["vec"])))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * tables, pa.int32()), pa.array(k.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "keys"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("keys", T.ArrayType(T.IntegerType()))]))


def _asking(queries: DataFrame, first: int, last: int, sure: float, tables: int, hashes: int, width: float, seed: int) -> DataFrame:
    """(q, t, key) of the probes from `first` on, up to `last`, that queries (q, vec, far) need to be sure to have found all nearer than `far`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch in batches:
            for dim, b in _by_length(batch, 64):
                t = made.setdefault(dim, Tables(dim, tables, hashes, width, seed))
                at, q, far = t.project(_matrix(b["vec"])), b["q"].to_numpy(), b["far"].fill_null(2.0).to_numpy(zero_copy_only=False)
                k = t.probes(at, first, last)
                wanted = np.arange(first, first + k.shape[2])
                need = (t.success(at, last, far) < sure).sum(axis=1) + 1 if first else np.full(len(q), last)
                go = np.broadcast_to((wanted < need[:, None])[:, None, :], k.shape)
                if go.any():
                    row, table, _ = np.nonzero(go)
                    yield pa.RecordBatch.from_arrays([pa.array(q[row]), pa.array(table.astype(np.int32)), pa.array(k[go])], ["q", "t", "key"])

    return queries.mapInArrow(run, "q long, t int, key int")


def _chunked(members: DataFrame, chunk: int, least: int, scratch: Scratch) -> DataFrame:
    """members (t, key, id, ...) with `part` and `parts`, from buckets of `least` members or more."""
    sizes = scratch.write(members.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least))
    parts = F.ceil(F.col("n") / chunk).cast("int")
    return members.join(sizes.select("t", "key", parts.alias("parts")), ["t", "key"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))


def forest_roots(linked: np.ndarray) -> np.ndarray:
    """The root of each member in a breadth-first forest of the links."""
    n = len(linked)
    root, left = np.arange(n), np.arange(n)
    while len(left):
        first, left = left[0], left[1:]
        front = [first]
        while front and len(left):
            near = linked[front.pop(), left]
            if near.any():
                root[left[near]] = first
                front += list(left[near])
                left = left[~near]
    return root


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, tables: int | None = None, hashes: int | None = None, width: float = 2.0, miss: float = 0.002, chunk: int = 512, seed: int = 9) -> DataFrame:
    """All rows as (id, n_links, component_id, kept), linking pairs that share a bucket and have cosine >= threshold.

    Hashes grow with the logarithm of the number of vectors, and there are as many
    tables as leave a pair right at the threshold without a common bucket with a chance
    of at most `miss`. A pair is counted in the first table that it shares, so the
    counts are exact for the pairs found. A row with a null id is kept only by others'
    components; its own is null where no id is reached, and it is never `kept`.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "pstable")
    rows = _keyed(df, id_col, vec_col)
    grouped = rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    # Written once, as the numbers of classes hold for one computation only.
    classes, total = scratch.counted(grouped.withColumn("id", F.monotonically_increasing_id()))
    hashes = hashes or hashes_for(total, width, 8)
    if tables is None:
        apart = 1 - collision(math.sqrt(2 - 2 * threshold) or 1e-6, width) ** hashes
        tables = max(1, math.ceil(math.log(miss) / math.log(apart)))
    hashed = scratch.write(_hashed(classes.select("id", "n", "vec"), tables, hashes, width, seed))
    members = _chunked(hashed.select("id", "n", "vec", "keys", F.posexplode("keys").alias("t", "key")), chunk, 2, scratch)
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = F.least("part", "other"), F.greatest("part", "other")
    cells = met.groupBy("t", "key", a.alias("a"), b.alias("b")).agg(F.collect_list(F.struct("id", "n", "vec", "keys", (F.col("part") == a).alias("left"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, roots = [], [], []
            lists, table = batch["m"], batch["t"].to_numpy()
            across = batch["a"].to_numpy() != batch["b"].to_numpy()
            at, m = lists.offsets.to_numpy(), lists.values
            at, m = at - at[0], m.slice(at[0], at[-1] - at[0])
            own, n, left = (m.field(x).to_numpy(zero_copy_only=False) for x in ("id", "n", "left"))
            vecs, keys, sizes = m.field("vec"), m.field("keys"), m.field("vec").value_lengths().to_numpy(zero_copy_only=False)
            for c, (i, j) in enumerate(zip(at, at[1:])):
                pick = np.arange(i, j)
                pick = pick[sizes[i:j] == sizes[i]]  # a key that vectors of two lengths share by chance
                x = _matrix(vecs.take(pa.array(pick)))
                norm = np.sqrt((x * x).sum(axis=1))
                linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
                if across[c]:
                    linked &= left[pick][:, None] != left[pick][None, :]
                np.fill_diagonal(linked, False)
                u, v = np.nonzero(np.triu(linked))
                k = np.stack(keys.take(pa.array(pick)).to_numpy(zero_copy_only=False))[:, : table[c]]
                fresh = np.concatenate([~(k[u[s : s + 65536]] == k[v[s : s + 65536]]).any(axis=1) for s in range(0, len(u), 65536)]) if len(u) else np.zeros(0, bool)
                u, v, w = u[fresh], v[fresh], n[pick]
                got = np.bincount(u, w[v], len(pick)) + np.bincount(v, w[u], len(pick))
                root = forest_roots(linked)
                full = (got > 0) | (root != np.arange(len(pick)))
                ids.append(own[pick][full])
                counts.append(got[full].astype(np.int64))
                roots.append(own[pick][root[full]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (ids, counts, roots)], ["id", "n_links", "root"])

    found = scratch.write(cells.select("t", "a", "b", "m").mapInArrow(run, "id long, n_links long, root long"))
    label = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    full = classes.select("h1", "h2", "id", "least", "n").join(found.groupBy("id").agg(F.sum("n_links").alias("others")), "id", "left").join(label.withColumnRenamed("node", "id"), "id", "left")
    full = full.withColumn("label", F.coalesce("label", "id"))
    names = full.groupBy("label").agg(F.min("least").alias("component_id"))
    info = full.join(names, "label").select("h1", "h2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("linked"))
    every = df.select(F.col(id_col).cast("long").alias("id"), F.when(usable(F.col(vec_col)), F.xxhash64(vec_col)).alias("h1"), F.when(usable(F.col(vec_col)), F.hash(vec_col)).alias("h2"))
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    out = every.join(info, ["h1", "h2"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _first(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> list[np.ndarray]:
    """Each query's first k + 1 distinct candidates."""
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])] if len(q) else np.zeros(0, bool)  # a pair's score is always the same
    q, c, s = q[new], c[new], s[new]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return [q[place <= k], c[place <= k], s[place <= k]]


def _compare(k: int):
    """Cells (m, q), lists of (id, vec) and (id, vec, least), to each query's k + 1 nearest of the cells seen by a task, of those not below its `least` score."""
    none = lambda: [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = none()
        for batch in batches:
            sides = []
            for name in ("m", "q"):
                at, m = batch[name].offsets.to_numpy(), batch[name].values
                m = m.slice(at[0], at[-1] - at[0])
                sides.append((at - at[0], m.field("id").to_numpy(), m.field("vec"), m.field("vec").value_lengths().to_numpy(zero_copy_only=False)))
            (at_m, id_m, vec_m, dim_m), (at_q, id_q, vec_q, dim_q) = sides
            lists = batch["q"].values.field("least")
            least = lists.slice(batch["q"].offsets[0].as_py(), len(id_q)).to_numpy()
            out = [[held[i]] for i in range(3)]
            for i, j, a, b in zip(at_m, at_m[1:], at_q, at_q[1:]):
                for d in np.unique(dim_q[a:b]):  # more than one only where lengths share a key by chance
                    mi, qi = i + np.flatnonzero(dim_m[i:j] == d), a + np.flatnonzero(dim_q[a:b] == d)
                    if not len(mi):
                        continue
                    x, y = _matrix(vec_m.take(pa.array(mi))), _matrix(vec_q.take(pa.array(qi)))
                    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
                    s = (y @ x.T) / (ny[:, None] * nx)
                    n = min(k + 1 + 3, len(mi))  # a few more, as the product may round ties apart
                    top = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < len(mi) else np.broadcast_to(np.arange(n), (len(qi), n))
                    r, c = np.repeat(np.arange(len(qi)), n), top.ravel()
                    score = (y[r] * x[c]).sum(1) / (ny[r] * nx[c])
                    good = score >= least[qi][r] - 1e-12
                    for o, v in zip(out, (id_q[qi][r], id_m[mi][c], score)):
                        o.append(v[good])
            held = _first(*map(np.concatenate, out), k)
            if len(held[0]) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["q", "c", "score"])
                held = none()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["q", "c", "score"])

    return run


#: How many buckets of a table may have been visited after each round; a query stops within a round where it is sure.
ROUNDS = (1, 8, 64, 512, 2048)
#: How many unlike vectors a bucket should hold: a visit is one row of a matrix product, far cheaper than a probe.
PER_BUCKET = 128


def search(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 8, hashes: int | None = None, width: float = 2.0, rounds: tuple[int, ...] = ROUNDS, sure: float = 0.95, chunk: int = 1024, query_chunk: int = 256, seed: int = 3, report: dict | None = None) -> DataFrame:
    """The k nearest found of every query row among all other ids: (query_id, rank, vec_id, score).

    All rows are indexed. A query probes until a vector at the distance of its k-th
    nearest found would have been met with chance `sure`, or the rounds end; queries
    that then have met fewer than k + 1 classes are held against all rows in blocks.
    `report`, if given, receives the numbers of queries, classes and visits.
    `tests/llm` measures recall against brute force.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "search")
    rows = _keyed(df, id_col, vec_col).filter("id IS NOT NULL")
    # The k + 1 least ids of each class, in two steps so that no task ranks a whole large class.
    salted = rows.select("id", "h1", "h2").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256)))
    for by in (["h1", "h2", "salt"], ["h1", "h2"]):
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("place") <= k + 1)
    least = salted.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = rows.groupBy("h1", "h2").agg(F.first("vec").alias("vec"))
    # Numbered in the order of their least ids, so that ties go to the smaller; written once, as the numbers hold for one computation only.
    numbered = vectors.join(least, ["h1", "h2"]).repartitionByRange(F.col("ids")[0]).sortWithinPartitions(F.col("ids")[0])
    classes, total = scratch.counted(numbered.withColumn("c", F.monotonically_increasing_id()))
    asked = scratch.write(rows.filter(is_query).select(F.col("id").alias("query_id"), "h1", "h2").distinct())
    wanted = scratch.write(classes.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select(F.col("c").alias("q"), "vec"))
    hashes = hashes or hashes_for(total, width, PER_BUCKET)

    hashed = _hashed(classes.select(F.col("c").alias("id"), "vec"), tables, hashes, width, seed)
    members = hashed.select("id", "vec", F.posexplode("keys").alias("t", "key"))
    cells = scratch.write(_chunked(members, chunk, 1, scratch).groupBy("t", "key", "part").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("id", "vec")).alias("m")))

    def visit(asks: DataFrame, cells: DataFrame, near: DataFrame | None) -> DataFrame:
        """The nearest of the buckets asked for, if not farther than the last of those found before: asks (q, t, key), cells (t, key, part, parts, m)."""
        sizes = cells.filter("part = 0").select("t", "key", "parts")
        full = scratch.write(asks.join(sizes, ["t", "key"]))
        crowd = full.groupBy("t", "key").agg(F.ceil(F.count(F.lit(1)) / query_chunk).cast("int").alias("crowds"))
        spread = full.join(crowd, ["t", "key"]).withColumn("crowd", F.pmod(F.xxhash64("q"), F.col("crowds")).cast("int"))
        least = F.lit(-2.0)
        asking = wanted
        if near is not None:
            asking, least = wanted.join(near.filter(F.col("place") == k + 1).select("q", "score"), "q", "left"), F.coalesce("score", F.lit(-2.0))
        sides = spread.join(asking.select("q", "vec", least.alias("least")), "q").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = sides.groupBy("t", "key", "part", "crowd").agg(F.collect_list(F.struct(F.col("q").alias("id"), "vec", "least")).alias("q"))
        left = cells.join(crowd, ["t", "key"]).withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)))
        both = left.select("t", "key", "part", "crowd", "m").join(right, ["t", "key", "part", "crowd"])
        if report is not None:
            report["visits"] = report.get("visits", 0) + (both.agg(F.sum(F.size("m").cast("long") * F.size("q"))).first()[0] or 0)
        return both.select("m", "q").mapInArrow(_compare(k), "q long, c long, score double")

    def nearest(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
        return found.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("place", place).filter(F.col("place") <= k + 1)

    near = None
    for first, last in zip((0, *rounds), rounds):
        left = wanted.withColumn("far", F.lit(None).cast("double"))
        if near is not None:  # the k-th other class; a class meets itself
            far = near.filter(F.col("place") == k + 1).select("q", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("far"))
            left = wanted.join(far, "q", "left")
        asks, n = scratch.counted(_asking(left, first, last, sure, tables, hashes, width, seed))
        if report is not None:
            report.setdefault("probes", []).append(n)
        if not n:
            break
        met = visit(asks, cells, near).withColumn("place", F.lit(0))
        near = scratch.write(nearest(met if near is None else near.unionByName(met)))
    few = wanted if near is None else wanted.join(near.groupBy("q").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > F.lit(min(k, total - 1))), "q", "left_anti")
    few, n = scratch.counted(few.select("q", F.size("vec").alias("key")))
    if n:  # blocks of all vectors of the query's length
        blocks = classes.select(F.col("c").alias("id"), "vec", F.size("vec").alias("key"), F.lit(-1).alias("t"))
        met = visit(few.select("q", F.lit(-1).alias("t"), "key"), scratch.write(_chunked(blocks, chunk, 1, scratch).groupBy("t", "key", "part").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("id", "vec")).alias("m"))), near)
        near = scratch.write(nearest(near.unionByName(met.withColumn("place", F.lit(0))) if near is not None else met))
    if report is not None:
        report |= {"queries": wanted.count(), "classes": total, "hashes": hashes, "scanned": n}
    if near is None:
        return asked.limit(0).select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))
    ids = near.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    hits = asked.join(classes.select("h1", "h2", F.col("c").alias("q")), ["h1", "h2"]).select("query_id", "q").join(ids, "q").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
