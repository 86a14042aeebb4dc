import zlib

import pytest
from pyspark.sql import functions as F

from codestrata.llm import sharding

ROWS = [(i, "x" * (i * 37 % 500), 1, "s") for i in range(2000)] + [(3000, None, None, None), (3001, "", 1, None), (3002, "größe " * 2000, 1, None), (None, "no id", 1, None), (7, "x" * 259, 1, "s"), (7, "x" * 259, 1, "s")]
SCHEMA = "doc_id long, text string, shard int, slot string"


def test_all_rows_in_even_gapless_shards(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = sharding.shard_records(df, 8).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    load, slots, home = [0] * 8, [[] for _ in range(8)], {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert home.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(load) - min(load) <= 0.02 * sum(load) / 8
    again = sharding.shard_records(df.repartition(5), 8).filter("doc_id <> 7").collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again if r["doc_id"] is not None) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in got if r["doc_id"] not in (7, None))
    assert sharding.shard_records(df.limit(0), 8).count() == 0


def test_many_equal_rows_are_spread(spark):
    rows = [(1, "y" * 500)] * 3000 + [(None, None)] * 500 + [(i, "x" * (i % 300)) for i in range(2, 6002)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for parts in (3, 8):
        got = sharding.shard_records(df.repartition(parts), 8).collect()
        load = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
        assert len(got) == len(rows) and max(load) - min(load) <= 0.03 * sum(load) / 8
        assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got))) for k in range(8))
        found.append(sorted((str(r["doc_id"]), r["shard"], r["slot"], r["virtual_slot"]) for r in got))
    assert found[0] == found[1]


def test_map_versions_and_rebalancing(spark, tmp_path):
    sizes = [i * 7919 % 1000 for i in range(512)]
    old = sharding.balanced_map(sizes, 4)
    new = sharding.rebalanced(old, sizes, 5)
    load = [sum(b for b, s in zip(sizes, new.shards) if s == k) for k in range(5)]
    assert max(load) - min(load) <= 0.05 * sum(load) / 5
    assert all(b == 4 for a, b in zip(old.shards, new.shards) if a != b)  # a slot moves only to the shard that joined
    less = sharding.rebalanced(new, sizes, 3)
    assert set(less.shards) == {0, 1, 2}
    path = str(tmp_path / "map")
    for m in (old, new, less):
        m.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == less and less.version == 3
    assert sharding.SlotMap.load(spark, path, 1) == old


@pytest.mark.parametrize("n", [1, 4096])
def test_lookup_is_one_literal(spark, n):
    got = spark.range(n).select(sharding.lookup([3 * i for i in range(n)], F.col("id"), "bigint").alias("x")).collect()
    assert [r["x"] for r in got] == [3 * i for i in range(n)]


def test_stored_map_is_edited_not_overwritten(spark, tmp_path):
    df, path = spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "stored")
    place = lambda n: {(r["doc_id"], r["text_crc32"]): (r["virtual_slot"], r["shard"], r["map_version"]) for r in sharding.shard_records(df, n, map_path=path).collect()}
    first = place(4)
    assert place(4) == first and sharding.SlotMap.versions(spark, path) == [1]  # nothing to move
    grown = place(5)
    assert {v[2] for v in grown.values()} == {2} and all(grown[k][1] == 4 for k in first if grown[k][1] != first[k][1])
    assert sharding.SlotMap.load(spark, path, 1).n_shards == 4 and sharding.SlotMap.load(spark, path).n_shards == 5
    load = [0] * 5
    for r in sharding.shard_records(df, 5, map_path=path).collect():
        load[r["shard"]] += r["size"]
    assert max(load) - min(load) <= 0.1 * sum(load) / 5
    with pytest.raises(Exception):
        sharding.balanced_map([1] * 4096, 4).save(spark, path)
    with pytest.raises(ValueError, match="slots"):
        sharding.shard_records(df, 5, n_slots=64, map_path=path)
    less = [r["shard"] for r in sharding.shard_records(df, 3, map_path=path).collect()]
    assert set(less) == {0, 1, 2} and sharding.SlotMap.versions(spark, path) == [1, 2, 3]
