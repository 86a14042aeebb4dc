"""Look-ups by postings against the tiers over all names."""

import random

from pyspark.sql import functions as F

from codestrata.operators import names
from codestrata.operators import relational as R

CLASSES = ["A::B", "a::b_c", "X::A_B", "N::Pump::Valve", "n::pump_valve", "Valve", "AB", "B", "", "Ünï::Köder", "x_y::Z", "x::y::z", "aaaa", "aaa::a", "A::B", None, "Vİ"]
QUERIES = ["a::b", "A_B", "b", "valve", "pump::valve", "PUMP_VALVE", "a__b", "::b", "_", "::", "zz", "", "  ", "ü", "köder", "aa", "aaa", "y_z", "x::y_z"]


def test_classes_and_paths_as_without_an_index(spark, tmp_path):
    r = random.Random(4)
    made = ["::".join("".join(r.choice("ab_") for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 3))) for _ in range(60)]
    df = spark.createDataFrame([(x, "extra") for x in CLASSES + made], "qualified_name string, gram string")
    names.store_index(names.name_index(df), str(tmp_path / "postings"))
    index = names.open_index(spark, str(tmp_path / "postings"))
    every = df.select("qualified_name").distinct().cache()
    asked = QUERIES + ["".join(r.choice("ab_:") for _ in range(r.randint(1, 5))) for _ in range(6)]
    for q in asked:
        assert sorted(map(tuple, names.resolve_class(index, q).collect())) == sorted(map(tuple, R.resolve_tiered(every, q).select("qualified_name", "tier").collect())), q
    paths = spark.createDataFrame([(p,) for p in ("src/a.hxx", "src/A.hxx", "lib/ba.hxx", "a", "x/y::z.h", None)], "file_path string")
    by_path = names.name_index(paths, "file_path")
    for q in ("a.hxx", "A", "src", "", "y::z", "y_z", "none"):
        want = R.resolve_file(paths.distinct(), q).select("file_path", "tier").collect()
        assert sorted(map(tuple, names.resolve_path(by_path, q).collect())) == sorted(map(tuple, want)), q
    every.unpersist()


def test_postings_are_pruned_and_empty_tables_answer(spark, tmp_path):
    df = spark.range(2000).select(F.concat(F.lit("N::C"), "id").alias("qualified_name"))
    names.store_index(names.name_index(df), str(tmp_path / "postings"))
    index = names.open_index(spark, str(tmp_path / "postings"))
    assert "In(gram" in names.candidates(index, ["c1999"])._jdf.queryExecution().toString()
    assert [r["tier"] for r in names.resolve_class(index, "C1999").collect()] == [2]
    assert names.resolve_class(names.name_index(df.limit(0)), "C1").count() == 0
