import os

import pytest
from pyspark.sql import functions as F

from codestrata.session import Scratch
from codestrata.sources import cpp, scan
from codestrata.sources.types import classify_field, innermost_name
from tests import tree


@pytest.mark.parametrize(
    "expression,found",
    [
        ("std::unique_ptr<Pump>", ("composes", "Pump")), ("Valve", ("composes", "Valve")), ("std::vector<Pump*>", ("aggregates", "Pump")), ("std::shared_ptr<pipes::Pipe>", ("associates", "Pipe")),
        ("Pump*", ("associates", "Pump")), ("int", None), ("char*", None), ("std::function<void(X)>", None), ("std::vector<std::unique_ptr<X>>", ("composes", "X")), ("std::map<int, ns::Y>", ("aggregates", "Y")),
        ("occ::Handle<Shape>", ("associates", "Shape")), ("const ns::Z*", ("associates", "Z")), ("std::vector<int>", None),
    ],
)
def test_field_types(expression, found):
    assert classify_field(expression) == found


def test_type_helpers():
    assert innermost_name("std::pair<A, B>") == "B" and innermost_name("3") is None


def names(text, kind):
    return [e["qualified_name"] for e in cpp.parse(text).entities if e["kind"] == kind]


def edges(text):
    return {(r["source_qname"], r["kind"], r["target_name"], r["evidence_line"]) for r in cpp.parse(text).relationships}


def test_containers_and_members():
    assert names('R"x(class A{};)x"; // class B{}\n/* class C{}; */ struct D { };', "struct") == ["D"]
    assert names("class MYLIB_EXPORT Foo : public Bar { };", "class") == ["Foo"]
    assert names("class API_MACRO Foo { }; class FOO { };", "class") == ["Foo", "FOO"]
    assert names("class A; class A* p; class B { class C { }; };", "class") == ["B", "B::C"]
    assert names("namespace a::b { namespace { class C {}; } }", "class") == ["a::b::C"]
    assert names("template <class T, int N = (3 > 2)> class V { T* get(); T* m; };", "class") == ["V"]
    assert names("class A { A(); ~A(); A& operator=(const A&); bool operator()(int) const; X* p(); X** q(); X& r(); };", "method") == ["A::A", "A::~A", "A::operator=", "A::operator()", "A::p", "A::q", "A::r"]
    assert names("void f(int x) { } void A::g() const { if (x) { } } int B::C::h() { return 0; }", "method") == ["A::g", "B::C::h"]
    assert names("class A { int x = 3; int* y{nullptr}; int z[3]; int& r; static const int k = 4; X a, *b; int bits : 3; std::map<int, X> m; };", "field") == ["A::x", "A::y", "A::k", "A::a", "A::b", "A::bits", "A::m"]
    assert names("class A { A() : x(1), y{2} { Local l(x); } int x; };", "method") == ["A::A"]
    assert names("enum class E { a, b }; union U { int i; }; class A { enum { q }; int v; };", "field") == ["A::v"]
    assert names("#define X class M { \\\n };\nclass N { };", "class") == ["N"]
    assert names('extern "C" { struct S { int a; }; }', "struct") == ["S"]
    assert names("class A { friend class B; public: using T = int; typedef int U; int f; };", "field") == ["A::f"]


def test_broken_text_ends():
    for text in ("class A {", "class A : public", "}}} class B { int x; };", "void A::f( {", "template <", "class", "using X =", '"open', "a < b < c;", "/* open", "#if 1", "namespace {", "operator", "class A { void f() { if (a < b) { } } int x; };"):
        cpp.parse(text)
    assert names("}}} class B { int x; };", "class") == ["B"]
    cpp.parse("(" * 5000 + "class A { };")


def test_dependencies():
    assert ("A", "depends", "P", 1) in edges("class A { void f(const P& p, int n = Q::k); };")
    assert not {e for e in edges("class A { void f(const P& p, int n = Q::k); };") if e[2] in ("Q", "p", "k")}
    body = edges("void A::f() {\n  Local x;\n  auto p = new Made(1);\n  auto q = static_cast<Cast*>(p);\n  Scope::Call();\n  std::make_shared<Arg>();\n  m_x->Start();\n  y = z * w;\n  for (const Item& i : items) { }\n  std::vector<Elem> v;\n}")
    assert body == {("A", "depends", n, i) for n, i in (("Local", 2), ("Made", 3), ("Cast", 4), ("Scope", 5), ("Arg", 6), ("Item", 9), ("Elem", 10))}
    assert edges("B A::f(B b) { B c; }") == {("A", "depends", "B", 1)}
    assert edges("void A::f() { A a; }") == set()


def test_scan_of_a_tree(spark, tmp_path):
    g = scan.scan(spark, tree.make(tmp_path / "src"))
    ents = {(r["kind"], r["qualified_name"]): r for r in g.entities.collect()}
    classes = {q for k, q in ents if k in ("class", "struct", "interface")}
    assert classes == {"Ghost", "Shop::IPart", "Shop::Box", "Shop::Car", "Shop::Car::Seat", "Motor", "Boat", "Tank", "A::Handler", "B::Handler", "Latin"}
    assert ents["interface", "Shop::IPart"]["abstract"] and ents["class", "Ghost"]["phantom"] and ents["class", "Shop::Car"]["start_line"] == 12
    assert ents["method", "Shop::Car::engine"]["parent_qname"] == "Shop::Car" and ents["field", "Boat::m_tank"]["signature"] == "Tank"
    assert {(r["source_qname"], r["kind"], r["target_name"], r["target_qname"], r["evidence_line"]) for r in g.relationships.collect()} == tree.RELATIONS
    stats = g.statistics.first()
    assert (stats["merged_count"], stats["ambiguous_count"], stats["alias_expanded"], stats["alias_dropped"], stats["retagged_count"]) == (0, 1, 2, 0, 2)
    assert stats["class_count"] == 8 and stats["phantom_count"] == 1 and stats["resolved_count"] == 15
    assert scan.vendored_count(spark, str(tmp_path / "src")).first()["excluded"] == 1
    again = scan.scan(spark, str(tmp_path / "src"))
    assert sorted(map(str, again.relationships.collect())) == sorted(map(str, g.relationships.collect()))


def test_cache_parses_only_what_changed(spark, tmp_path):
    root, cache = tree.make(tmp_path / "src"), str(tmp_path / "cache")
    first = scan.scan(spark, root, cache)
    old, version = scan.load_cache(spark, cache)
    assert version == 1 and old.count() == 7 - 1
    from codestrata.operators.relational import cache_misses

    assert cache_misses(scan.files(spark, root), old, scan.FINGERPRINT).count() == 0
    second = scan.scan(spark, root, cache)
    assert sorted(map(str, second.entities.collect())) == sorted(map(str, first.entities.collect()))
    with open(f"{root}/a/Pump.hxx", "a") as f:
        f.write("class Added {};\n")
    os.remove(f"{root}/b/latin.c")
    assert [r["file_path"] for r in cache_misses(scan.files(spark, root), scan.load_cache(spark, cache)[0], scan.FINGERPRINT).collect()] == ["a/Pump.hxx"]
    last = scan.scan(spark, root, cache)
    counted = last.statistics.first()
    assert (counted["cache_hits"], counted["cache_misses"]) == (4, 1) and second.statistics.first()["cache_misses"] == 0
    third = {r["qualified_name"] for r in last.entities.collect()}
    assert "Added" in third and "Latin" not in third and "Boat" in third


def test_phantom_merges_into_its_namespaced_class(spark, tmp_path):
    files = {"s/w.cxx": "void Widget::draw() { }\n", "s/w.hxx": "namespace ui {\nclass Widget { void draw(); int x; };\n}\n", "s/other.cxx": "void Lone::f() { }\n"}
    g = scan.scan(spark, tree.make(tmp_path / "m", files))
    found = {(r["kind"], r["qualified_name"], r["phantom"]) for r in g.entities.collect()}
    assert ("class", "ui::Widget", False) in found and ("class", "Lone", True) in found
    assert not any(q == "Widget" for _, q, _ in found)
    assert {q for k, q, _ in found if k == "method"} == {"ui::Widget::draw", "Lone::f"} and g.entities.filter("name = 'draw'").first()["parent_qname"] == "ui::Widget"


def test_alias_chains(spark, tmp_path):
    files = {"s/a.hxx": "class T { };\nusing P = std::shared_ptr<T>;\nusing Q = P;\nusing R = Q;\nusing Loop = Pool;\nusing Pool = Loop;\nusing N = int;\nclass U { R r; std::vector<Q> v; Loop l; N n; };\n"}
    g = scan.scan(spark, tree.make(tmp_path / "al", files))
    got = {(r["kind"], r["target_name"], r["target_qname"]) for r in g.relationships.filter(F.col("source_qname") == "U").collect()}
    assert got == {("associates", "T", "T")}  # the wrapper behind an alias decides; aliases of no class and endless ones are dropped


def test_warm_scan_opens_no_unchanged_file(spark, tmp_path):
    """What a file holds does not count while its time and size stay."""
    root, cache = tree.make(tmp_path / "w"), str(tmp_path / "cache")
    before = scan.scan(spark, root, cache).entities.count()
    path = f"{root}/a/Pump.hxx"
    was = os.stat(path)
    with open(path, "r+") as f:
        f.write("#pragma ONCE")
    os.utime(path, ns=(was.st_atime_ns, was.st_mtime_ns))
    assert scan.scan(spark, root, cache).entities.count() == before
    plan = scan.files(spark, root, texts=False)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("text", ["int", "X", "ns::X*", "std::vector<X>", "std::vector<ns::X*>", "unique_ptr<X>", "Handle<X>", "std::map<int, X>", "std::function<X>", "const X&", "std::vector<const X*>", "string", "std::set<int>", "unsigned long", "weak_ptr<A, B> *"])
def test_sch_types_follow_the_same_rules(spark, text):
    got = spark.range(1).select(scan._field_type(F.lit(text)).alias("f")).first()["f"]
    assert (tuple(got) if got else None) == classify_field(text)


@pytest.mark.parametrize("text,pure", [("void f() = 0;", True), ("void f() const noexcept = 0", True), ("void f() & = 0", True), ("void f(int a = 0)", False), ("void f() = default", False), ("void f() { x = 0; }", False), ("int x = 0;", False), (None, False), ("void f() = 00", False)])
def test_pure_virtual(spark, text, pure):
    assert spark.range(1).select(scan.is_pure_virtual(F.lit(text).cast("string"))).first()[0] is pure


def test_assembly_follows_long_alias_chains(spark):
    """Twelve aliases on the way to a class, beside two that are each other's."""
    text = "".join(f"using a{i} = a{i + 1};\n" for i in range(11)) + "using a11 = End;\nusing l = m;\nusing m = l;\nclass End { };\nclass Holder {\n  a0 m_far;\n  l m_never;\n};\n"
    rows = scan.parse_cpp(spark.createDataFrame([("f.hxx", text)], "file_path string, text string"))
    found = scan.assemble(rows, Scratch(spark, "long-aliases"))
    assert [(r["source_qname"], r["target_qname"], r["kind"]) for r in found.relationships.collect()] == [("Holder", "End", "composes")]
    assert found.statistics.select("alias_expanded", "alias_dropped").first() == (1, 1)


def test_files_of_one_partition_are_parsed_in_many_tasks(spark):
    sources = spark.range(64).coalesce(1).selectExpr("concat('f', id, '.hxx') AS file_path", "concat('class C', id, ' { };') AS text")
    rows = scan.parse_cpp(sources).select("name", F.spark_partition_id().alias("p")).collect()
    assert sorted(r["name"] for r in rows) == sorted(f"C{i}" for i in range(64))
    assert len({r["p"] for r in rows}) >= 4


def test_entities_are_assembled_without_relationships(spark, monkeypatch):
    """The entities of a query are those of the whole assembly, and neither names of relationships nor aliases are resolved for them."""
    from codestrata.plans import source_queries

    d, shown = "/root/testdata/sf0.001", ["qualified_name", "kind", "parent_qname", "phantom"]
    whole = source_queries._assembled(spark, d).entities.select(*shown).collect()
    for step in ("resolve_names", "chase_aliases"):
        monkeypatch.setattr(scan.R, step, lambda *a, **k: pytest.fail("resolved for entities"))
    assert len(whole) > 200 and sorted(source_queries.assembled_entities(spark, d).collect(), key=str) == sorted(whole, key=str)
