import hashlib

from pyspark.sql import functions as F

from codestrata.functions import kinds, text
from codestrata.operators import relational as R


def test_latest_and_upsert(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, None), ("b", 1, None)], "k string, n int, v string")
    assert {r["k"]: r["v"] for r in R.latest_per_key(df, ["k"], [F.col("n")]).collect()} == {"a": "y", "b": None}
    got = R.upsert(df.filter("n = 1"), df.filter("n > 1"), ["k"], [F.col("n")]).collect()
    assert {r["k"]: (r["n"], r["v"]) for r in got} == {"a": (3, "y"), "b": (1, None)}
    assert R.upsert(df.limit(0), df.limit(0), ["k"]).count() == 0
    log = R.append_log(spark.createDataFrame([(5, "x")], "id long, v string"), spark.createDataFrame([("y",), ("z",)], "v string"))
    ids = [r["id"] for r in log.orderBy("id").collect()]
    assert ids[0] == 5 and len(set(ids)) == 3 and min(ids[1:]) > 5


def test_names(spark):
    ents = spark.createDataFrame([("class", "H", "A::H", "f1"), ("class", "H", "B::H", "f2"), ("class", "U", "A::U", "f1"), ("method", "M", "A::U::M", "f1")], "kind string, name string, qualified_name string, file_path string")
    rel = spark.createDataFrame([("x", None, "H", "f1"), ("x", None, "ns::U", "f2"), ("x", "kept", "U", "f2"), ("x", None, "M", "f1")], "source_qname string, target_qname string, target_name string, evidence_file string")
    assert [r["target_qname"] for r in R.resolve_names(rel, ents).orderBy("target_name", F.desc("target_qname")).collect()] == [None, None, "kept", "A::U"]
    assert {r["target_name"]: r["target_qname"] for r in R.resolve_names(rel.filter("target_qname IS NULL"), ents, {"evidence_file": "file_path"}).collect()} == {"H": "A::H", "ns::U": None, "M": None}


def test_aliases(spark):
    a = spark.createDataFrame([("A", "B", None), ("B", "C", "associates"), ("C", "D", "composes"), ("L", "M", None), ("M", "L", None)], "alias string, target string, kind string")
    assert {r["alias"]: (r["target"], r["kind"], r["depth"]) for r in R.chase_aliases(a).collect()} == {"A": ("D", "associates", 3), "B": ("D", "associates", 2), "C": ("D", "composes", 1)}
    long = spark.createDataFrame([(f"a{i}", f"a{i + 1}", None) for i in range(12)], "alias string, target string, kind string")
    assert min(int(r["alias"][1:]) for r in R.chase_aliases(long).collect()) == 3  # nine steps at most


def test_suffixes(spark):
    e = spark.createDataFrame([("class", q) for q in ("C", "N::C", "D", "N::D", "M::D", "a::E", "x::a::E", "x::b::E")] + [("struct", "C")], "kind string, qualified_name string")
    got = {(r["kind"], r["qualified_name"]): r["merged"] for r in R.suffix_merges(e).collect()}
    assert got == {("class", "C"): "N::C", ("class", "a::E"): "x::a::E"}
    chain = spark.createDataFrame([("c", "a", "b"), ("c", "b", "d")], "kind string, qualified_name string, merged string")
    assert {r["qualified_name"]: r["merged"] for r in R.merge_tips(chain).collect()} == {"a": "d", "b": "d"}
    long = [("c", f"n{i}", f"n{i + 1}") for i in range(80)] + [("d", "n3", "x"), ("c", "p", "q"), ("c", "q", "p"), ("c", "o", "p")]
    got = {(r["kind"], r["qualified_name"]): r["merged"] for r in R.merge_tips(spark.createDataFrame(long, "kind string, qualified_name string, merged string")).collect()}
    assert got == {("c", f"n{i}"): "n80" for i in range(80)} | {("d", "n3"): "x", ("c", "p"): "q", ("c", "q"): "p", ("c", "o"): "p"}
    assert R.merge_tips(chain.limit(0)).count() == 0


def test_kinds_are_refined_per_file(spark):
    rows = [("f", "class", "I", "I", None, None), ("f", "method", "go", "I::go", "I", True), ("f", "method", "~I", "I::~I", "I", False), ("f", "class", "B", "B", None, None), ("f", "method", "go", "B::go", "B", True), ("f", "field", "x", "B::x", "B", None), ("f", "class", "K", "K", None, None), ("g", "method", "go", "K::go", "K", True)]
    df = spark.createDataFrame(rows, "file_path string, kind string, name string, qualified_name string, parent_qname string, pure boolean")
    got = {r["qualified_name"]: (r["kind"], r["abstract"]) for r in R.refine_class_kinds(df).filter("parent_qname IS NULL").collect()}
    assert got == {"I": ("interface", True), "B": ("class", True), "K": ("class", False)}


def test_tiers(spark):
    df = spark.createDataFrame([(q,) for q in ("N::Car", "N::Old_Car", "N::CarPark", "Truck")], "qualified_name string")
    names = lambda q: sorted(r["qualified_name"] for r in R.resolve_tiered(df, q).collect())
    assert names("n::car") == ["N::Car"] and names("Car") == ["N::Car"] and names("N_Car") == ["N::Car"] and names("old_car") == ["N::Old_Car"] and names("park") == ["N::CarPark"] and names("N_Old") == ["N::Old_Car"] and names(" ") == [] and names("zzz") == []
    f = spark.createDataFrame([("a/x.h",), ("b/x.h",), ("b/yx.h",)], "file_path string")
    assert R.resolve_file(f, "x.h").count() == 2 and R.resolve_file(f, "b/x.h").count() == 1 and R.resolve_file(f, "y").first()["tier"] == 3


def test_fingerprints(spark):
    rows = [("B", "T", "t", "depends"), ("A", None, "ext", "inherits"), ("A", "", "ext2", "depends"), ("A", None, "ext", "inherits")]
    df = spark.createDataFrame(rows, "source_qname string, target_qname string, target_name string, kind string")
    lines = sorted(f"{s}|{q or n}|{k}" for s, q, n, k in rows)
    assert R.graph_fingerprint(df).first()[0] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    one, two = R.incremental_fingerprint(df).first()[0], R.incremental_fingerprint(df.repartition(5)).first()[0]
    assert one == two != R.incremental_fingerprint(df.limit(3)).first()[0]


def test_reports(spark):
    rel = spark.createDataFrame([("a", "b"), ("a", None)], "s string, target_qname string")
    r = R.unresolved_ratio(rel).first()
    assert (r["total"], r["unresolved"], r["pct"], r["caution"]) == (2, 1, 50.0, True) and R.unresolved_ratio(rel.limit(0)).first()["pct"] is None
    lines = R.source_lines(spark.createDataFrame([("f", "a\nb\nc"), ("g", None)], "f string, t string"), "t", 2, 9)
    assert [(x["f"], x["line_no"], x["line"]) for x in lines.orderBy("f", "line_no").collect()] == [("f", 2, "b"), ("f", 3, "c")]


def test_expressions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(text.last_segment(F.lit("a::b::c"))) == "c" and get(text.basename(F.lit("a/b"))) == "b" and get(text.dirname(F.lit("a/b/c"))) == "a/b" and get(text.dirname(F.lit("c"))) == ""
    assert get(text.evidence(F.lit("A"), F.lit("depends"), F.lit("B"), F.lit("x/y.h"), F.lit(3))) == "A --depends--> B (y.h:3)" and get(text.evidence(F.lit("A"), F.lit("k"), F.lit("B"), F.lit(""), F.lit(3))) == "A --k--> B"
    for sig, pure in (("void f() = 0;", True), ("void f() const = 0", True), ("void f(int x = 0);", False), ("void f() { x = 0; }", False), (None, False)):
        assert get(text.is_pure_virtual(F.lit(sig).cast("string"))) is pure
    for name, noise in (("JA_x", True), ("size_t", True), ("ABC", True), ("a<b>", True), ("Car", False), ("vector", True)):
        assert get(text.is_noise_external(F.lit(name))) is noise
    assert get(kinds.kinds_by_strength(F.array(F.lit("depends"), F.lit("inherits"), F.lit("composes")))) == ["inherits", "composes", "depends"]
    assert [(r["kind"], r["level"]) for r in kinds.kind_table(spark).orderBy("level").collect()][0] == ("depends", 0)
    assert get(text.decoded(F.lit(b"caf\xc3\xa9"))) == "café" and get(text.decoded(F.lit(b"caf\xe9"))) == "café"
    assert get(text.rescued_json(F.lit('x ```json\n{"a": 1}\n```'))) == '{"a": 1}' and get(text.rescued_json(F.lit('so {"a": 2} ok'))) == '{"a": 2}' and get(text.rescued_json(F.lit("none"))) is None
    assert get(text.template(F.lit("a {X} b"), {"X": F.lit("1")})) == "a 1 b" and get(text.line_text(F.lit("a\n  b \n"), F.lit(1))) == "b" and get(text.line_count(F.lit("a\nb"))) == 2
    for pattern, path, short, q, hit in (("*View", "p/x.h", "MyView", "N::MyView", True), ("ui/*", "src/ui/x.h", "X", "X", True), ("ui/*", "src/gui/x.h", "X", "X", False), ("[!a]?", "p", "bc", "q", True), ("a.b", "p", "axb", "q", False)):
        assert get(text.glob_match(pattern, F.lit(path), F.lit(short), F.lit(q))) is hit
    assert text.glob_regex("a*b?[!c]d.e") == "(?s)^a.*b.[^c]d\\.e$"


def test_unknown_kinds_are_refused(spark):
    import pytest

    with pytest.raises(Exception, match="unknown kind: odd"):
        spark.createDataFrame([("odd",)], "k string").select(kinds.checked_kind(F.col("k"), kinds.RELATION_KINDS)).collect()


def test_catalog_has_oracles():
    from codestrata.plans.catalog import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 60 and len(ORACLES) >= len(QUERIES) - 3


def test_catalog_equals_its_oracles(spark):
    """A few cheap queries against DuckDB on the smallest tables; the driver checks all of them."""
    import os

    import duckdb
    import pytest

    from codestrata.plans.catalog import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in os.listdir(d):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{d}/{t}'")
    for name in ("edge_collapse", "class_degree_utility", "module_kind_counts", "latest_event_per_user", "retag_inheritance", "sch_extract", "cpp_extract"):
        df = QUERIES[name](spark, d)
        found = c.execute(ORACLES[name])
        columns = [x[0] for x in found.description]
        want = sorted(repr(tuple(r[columns.index(k)] for k in sorted(columns))) for r in found.fetchall())
        assert sorted(df.columns) == sorted(columns) and sorted(repr(tuple(r[k] for k in sorted(columns))) for r in df.collect()) == want, name


def test_fingerprint_tree(spark):
    rows = [(f"N::C{i % 40}", f"N::C{i % 7}", "x", "depends", f"f{i % 9}.hxx", i) for i in range(300)] + [(None, None, "y", "depends", None, 300)] * 2
    rel = spark.createDataFrame(rows, "source_qname string, target_qname string, target_name string, kind string, evidence_file string, line int")
    tree = lambda df: {(r["level"], r["node"]): (r["n"], r["digest"]) for r in df.collect()}
    whole = tree(R.fingerprint_tree(rel, digits=2))
    assert whole == tree(R.fingerprint_tree(rel.repartition(5), digits=2)) and whole[0, ""][0] == 302
    assert sum(n for (level, _), (n, _) in whole.items() if level == 2) == 302
    for (level, node), (n, digest) in whole.items():
        if level < 2:
            below = sorted((k, v[1]) for (lv, k), v in whole.items() if lv == level + 1 and k[:level] == node)
            assert digest == hashlib.sha256(",".join(f"{k}:{v}" for k, v in below).encode()).hexdigest()
    # One changed file changes its leaf and the nodes above, and the update says the same as a new tree.
    old, new = rel.filter("evidence_file = 'f3.hxx' AND line < 100"), rel.filter("evidence_file = 'f3.hxx' AND line < 50").withColumn("kind", F.lit("inherits"))
    after = rel.exceptAll(old).unionByName(new)
    refreshed = R.refreshed_tree(R.fingerprint_tree(rel, digits=2), old, new, digits=2)
    assert tree(refreshed) == tree(R.fingerprint_tree(after, digits=2))
    leaf = hashlib.sha256(b"f3.hxx").hexdigest()[:2]
    assert {tuple(r) for r in R.changed_nodes(R.fingerprint_tree(rel, digits=2), refreshed).collect()} == {(2, leaf), (1, leaf[:1]), (0, "")}
    # All lines gone: no rows; lines of no file belong to the empty key.
    assert R.refreshed_tree(R.fingerprint_tree(rel, digits=2), rel, rel.limit(0), digits=2).count() == 0
    assert (2, hashlib.sha256(b"").hexdigest()[:2]) in whole and R.fingerprint_tree(rel.limit(0)).count() == 0


def test_fingerprint_makes_no_list_of_all_lines(spark):
    """Repeated lines are counted before they are digested, in blocks; no lines give the digest of nothing."""
    rows = [(f"s{i % 700}", None if i % 3 else f"t{i % 11}", f"é{i % 5}", "inherits") for i in range(9000)] + [("same", "t", "n", "depends")] * 40_000
    df = spark.createDataFrame(rows, "source_qname string, target_qname string, target_name string, kind string").repartition(7)
    lines = sorted("|".join((s, t or n, k)).encode() for s, t, n, k in rows)
    found = R.graph_fingerprint(df)
    assert found.first()[0] == hashlib.sha256(b"\n".join(lines)).hexdigest()
    assert "collect_list" not in found._jdf.queryExecution().toString()
    assert R.graph_fingerprint(df.limit(0)).first()[0] == hashlib.sha256(b"").hexdigest()
