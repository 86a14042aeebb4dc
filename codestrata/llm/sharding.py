"""Sharding by fixed virtual slots.

A record is hashed into one of a few thousand virtual slots. The slots never
change; what changes is the slot-to-shard map, a small versioned table. Bytes
are summed per slot, the map is filled from these sums so that shards get near
equal bytes, and a later version moves only whole slots.

Defined results: a null text has no bytes and CRC 0; a null id is hashed as
null; of rows repeated with id and text the first has the slot of its hash, each
other one a slot of its own, so that many equal rows are spread like different ones;
rows of equal texts and different ids have nothing in common and are spread alike; an
empty table gives an empty result and an even map. Only the id and text
columns are read, so further columns cannot clash.

The map has `n_slots` rows, a parameter, so the driver may hold it. A stored version is
never written again: a run on a stored map edits the latest version with few moves and
adds the next.

A slot is a hash of id and text, not of the id alone, as a third of all rows may have
one id (null, for one) and the law is near equal bytes; so an edited text may change
its slot.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.session import Scratch

N_SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Version `version` of the map: shards[i] is the shard of slot i."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    def column(self, slot: Column) -> Column:
        """The shard of a slot as an expression on one literal array."""
        return lookup(self.shards, slot, "int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the stored map; earlier versions stay, and one that is there is an error."""
        rows = spark.range(len(self.shards), numPartitions=1).select(F.lit(self.n_shards).alias("n_shards"), F.col("id").cast("int").alias("slot"), self.column(F.col("id")).alias("shard"))
        rows.write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """The numbers of the stored versions that were written to their end."""
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(p)] if files.exists(p) else []
        return sorted(int(n[8:]) for n in names if n.startswith("version=") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The stored version asked for, or the latest."""
        v = version if version is not None else SlotMap.versions(spark, path)[-1]
        rows = spark.read.parquet(f"{path}/version={v}").orderBy("slot").collect()
        return SlotMap(int(v), rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def lookup(values, index: Column, kind: str) -> Column:
    """values[index] as an expression; the array is one constant-folded literal, however long."""
    text = ",".join(str(int(v)) for v in values)
    return F.get(F.split(F.lit(text), ",").cast(f"array<{kind}>"), index.cast("int"))


def slot_of(*keys: Column, n_slots: int = N_SLOTS) -> Column:
    """The virtual slot of a record: XXH64 of its keys modulo the number of slots."""
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def balanced_map(slot_bytes: list[int], n_shards: int, version: int = 1) -> SlotMap:
    """Longest processing time first: the largest slot goes to the lightest shard; ties to the smaller number."""
    heap, out = [(0, s) for s in range(n_shards)], [0] * len(slot_bytes)
    for b, slot in sorted(((b, i) for i, b in enumerate(slot_bytes)), key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        out[slot] = shard
        heapq.heapreplace(heap, (load + b + 1, shard))  # the 1 deals empty slots evenly
    return SlotMap(version, n_shards, tuple(out))


def rebalanced(old: SlotMap, slot_bytes: list[int], n_shards: int, slack: float = 0.01) -> SlotMap:
    """The next version of the map for `n_shards` shards, with few moves.

    Slots of shards that are no more move to the lightest shard. Where shards have
    joined, each in turn takes slots from the heaviest older shard, the largest that
    fits, until it has its even share; other slots stay where they are. Without
    joiners, slots move from the heaviest to the lightest shard while that narrows
    their gap, and it is above `slack` of an even share.
    """
    shards, load = list(old.shards), [0] * n_shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    homeless = []
    for slot, s in enumerate(shards):
        if s < n_shards:
            load[s] += slot_bytes[slot]
            held[s].append((slot_bytes[slot], slot))
        else:
            homeless.append((slot_bytes[slot], slot))

    def put(b: int, slot: int, s: int) -> None:
        shards[slot] = s
        load[s] += b
        held[s].append((b, slot))

    for b, slot in sorted(homeless, key=lambda x: (-x[0], x[1])):
        put(b, slot, min(range(n_shards), key=lambda s: (load[s], s)))
    def move(high: int, low: int, most: float) -> bool:
        fits = [x for x in held[high] if 0 < x[0] <= most]
        if fits:
            b, slot = max(fits, key=lambda x: (x[0], -x[1]))
            held[high].remove((b, slot))
            load[high] -= b
            put(b, slot, low)
        return bool(fits)

    even, joined = sum(load) / n_shards, range(old.n_shards, n_shards)
    for s in joined:
        while move(max(range(old.n_shards), key=lambda x: (load[x], -x)), s, even - load[s]):
            pass
    while not joined and len(load) > 1:
        low, high = min(range(n_shards), key=lambda s: (load[s], s)), max(range(n_shards), key=lambda s: (load[s], -s))
        if load[high] - load[low] <= slack * even or not move(high, low, (load[high] - load[low]) // 2):
            break
    return SlotMap(old.version + 1, n_shards, tuple(shards))


def ranked(rows: DataFrame) -> DataFrame:
    """Rows (key, part, ...) with `rank`: 0, 1, ... within those of one key.

    Each part numbers its own rows, from where the parts before it end; so a key that
    most rows have is numbered in as many tasks as there are parts.
    """
    per = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.select("key", "part", F.coalesce(before, F.lit(0)).alias("start")).filter("start > 0")
    own = F.row_number().over(Window.partitionBy("key", "part").orderBy("text_crc32", "size"))
    return rows.withColumn("own", own).join(starts, ["key", "part"], "left").withColumn("rank", F.col("own") - 1 + F.coalesce("start", F.lit(0))).drop("own", "start")


def shard_records(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Deal all rows into shards of near equal bytes.

    Returns id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (the row's
    place in its shard, without gaps from 0), virtual_slot, map_version and a null
    grown_shard. The map is stored under `map_path` (a new place in the shared folder by
    default) and read back. Where `map_path` holds a map of as many slots, its latest
    version is edited for the rows and shards at hand, and stored as the next version if
    that moves a slot.

    One pass reads the texts and keeps a few numbers per row. The place in the
    shard is the row's place in its virtual slot plus the sizes of the slots of
    the same shard before it, so no task orders a whole shard.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = scratch.write(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"),
            F.spark_partition_id().alias("part"),
        )
    )
    slot = F.when(F.col("rank") == 0, F.pmod("key", F.lit(n_slots)).cast("int")).otherwise(slot_of(F.col("key"), F.col("rank"), n_slots=n_slots))
    rows = scratch.write(ranked(read).select("id", "size", "text_crc32", slot.alias("virtual_slot")))
    found = {r["virtual_slot"]: r for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    size = [found[i]["b"] if i in found else 0 for i in range(n_slots)]
    path = map_path or scratch.path("slot_map")
    made = SlotMap.versions(spark, path)
    if made:
        old = SlotMap.load(spark, path)
        if len(old.shards) != n_slots:
            raise ValueError(f"{path}: a map of {len(old.shards)} slots, not {n_slots}")
        new = rebalanced(old, size, n_shards)
        if (new.n_shards, new.shards) != (old.n_shards, old.shards):
            new.save(spark, path)
    else:
        balanced_map(size, n_shards).save(spark, path)
    held = SlotMap.load(spark, path)
    offsets, used = [0] * n_slots, [0] * n_shards
    for i, s in enumerate(held.shards):
        offsets[i] = used[s]
        used[s] += found[i]["n"] if i in found else 0
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size"))
    return rows.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        held.column(F.col("virtual_slot")).alias("shard"),
        (place - 1 + lookup(offsets, F.col("virtual_slot"), "bigint")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(held.version).alias("map_version"),
    )
