import json
import os

import pytest
from pyspark.sql import functions as F

from codestrata.operators import modules
from codestrata.tools import review
from codestrata.tools.client import Client, Config, Offline, parse_args, prompt_hash
from codestrata.tools.host import MAX_STEPS, Host
from codestrata.tools.registry import TOOLS, Context, run_tool
from codestrata.tools.store import Store
from tests import tree


@pytest.fixture(scope="module")
def context(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("project")
    c = Context(spark, tree.make(at / "src"), Store(spark, str(at / "store")))
    assert "Scanned 6 files: 11 classes" in run_tool(c, "scan_source")
    return c


def test_dispatch_never_raises(spark, tmp_path):
    c = Context(spark, str(tmp_path), Store(spark, str(tmp_path / "s")))
    assert "Unknown tool" in run_tool(c, "nothing")
    assert "does not take" in run_tool(c, "list_classes", {"wrong": 1})
    assert "scan_source first" in run_tool(c, "get_overview")
    assert len(TOOLS) == 14
    for t in TOOLS.values():
        assert t.schema()["parameters"]["type"] == "object" and t.description


def test_tools_on_a_tree(context):
    assert "Already scanned" in run_tool(context, "scan_source")
    assert "unresolved 25.0 %" in run_tool(context, "get_overview")
    assert run_tool(context, "list_classes", {"limit": 2}).startswith("11 classes\nA::Handler")
    text = run_tool(context, "describe_class", {"name": "car"})
    assert text.startswith("Shop::Car\nmethods: Car, engine, fit") and "bases: Base, Shop::IPart" in text
    assert "Several classes" in run_tool(context, "describe_class", {"name": "Handler"}) and "No class" in run_tool(context, "describe_class", {"name": "zzz"})
    assert "Boat --implements--> Shop::IPart (Boat.sch:4)" in run_tool(context, "get_relationships", {"class_qname": "boat"})
    assert "Tank --associates--> Motor (Tank.hpp:3)" in run_tool(context, "get_relationships", {"class_qname": "Motor", "direction": "incoming"})
    source = run_tool(context, "get_source", {"name": "Shop::Box"})
    assert source.splitlines()[0] == "a/Car.hxx" and source.endswith("   11 struct Box { int n; };")
    assert "    3 class Boat {" in run_tool(context, "get_source", {"file": "boat.SCH", "start": 3, "end": 3})
    assert "   15     Motor& engine" in run_tool(context, "get_source", {"name": "car::engine"})
    assert "ambiguous" in run_tool(context, "get_source", {"name": "handler"}) and "Several files" in run_tool(context, "get_source", {"file": "a/"}) and "No source" in run_tool(context, "get_source", {"name": "zzz::q"})


def test_sql_is_read_only(context):
    assert run_tool(context, "query_db", {"sql": "SELECT count(*) AS n FROM entities WHERE kind = 'struct'"}) == "n\n2"
    assert run_tool(context, "query_db", {"sql": "select 1 where 1 = 0"}) == "No rows."
    for bad in ("DROP TABLE entities", "WITH x AS (SELECT 1) SELECT * FROM x", "select reflect/**/('java.lang.System','getProperty','user.name')", "select `java_method`('java.lang.Math', 'abs', 1)", "select 1 where exists (select try_reflect('java.lang.System','getProperty','user.name'))", "select transform(1) using 'cat' as (x)"):
        assert "allowed" in run_tool(context, "query_db", {"sql": bad})
    assert "failed" in run_tool(context, "query_db", {"sql": "select 1; drop table x"})
    for path in ("text.`/etc/hostname`", "binaryFile.`/etc/hostname`", "parquet.`/root/testdata/sf0.001/part.parquet`"):
        assert "failed" in run_tool(context, "query_db", {"sql": f"SELECT * FROM {path}"})
    assert len(run_tool(context, "query_db", {"sql": "select id from range(100)"}).splitlines()) == 52


def test_evidence_is_made_for_the_asked_modules_only(context, monkeypatch):
    """The matrix shows none, so none is made; between two modules only their own references are ranked."""
    ranked = []
    whole = modules.module_edges

    def seen(references, evidence=None, keep=12):
        if evidence is not None:
            ranked.extend(tuple(r) for r in references.select("src", "dst").distinct().collect())
        return whole(references, evidence, keep)

    monkeypatch.setattr(modules, "module_edges", seen)
    assert "b -> a: 3" in run_tool(context, "module_dependencies") and not ranked
    assert run_tool(context, "module_dependencies", {"from_module": "b", "to_module": "a"}).startswith("b -> a: 3\n    ")
    assert ranked == [("b", "a")]


def test_audit_plan_report(context, tmp_path):
    assert "Modules by folder" in run_tool(context, "architecture_audit")
    assert "b -> a: 3" in run_tool(context, "module_dependencies") and "Boat --" in run_tool(context, "module_dependencies", {"from_module": "b", "to_module": "a"})
    assert "Cycle a, b" in run_tool(context, "decoupling_plan")
    assert "Module cycle: a, b" in run_tool(context, "get_findings")
    path = str(tmp_path / "r.html")
    assert run_tool(context, "generate_report", {"path": path}) == f"Wrote {path}."
    page = open(path).read()
    payload = json.loads(page.split('type="application/json">')[1].split("</script>")[0])
    assert set(payload) == {"summary", "graph", "arch", "arch_graph", "review"} and payload["summary"]["classes"] == 10
    arch = {r["id"]: r for r in payload["arch"]}
    assert {n["id"] for n in payload["graph"]["nodes"]} == set(arch) | {"Boat"} and arch["Shop::IPart"]["impls"] == ["Boat"]  # Shop::Car is the orchestrator and stays
    assert arch["Motor"]["parent"] in arch and arch["Shop::Car"]["parent"] is None
    assert all(n["visible"] for n in payload["graph"]["nodes"])


class Fake(Offline):
    model = "fake"
    reply = '{"assessment": "fine", "priority": "low", "recommendations": [{"title": "b", "priority": "low"}, {"title": "a", "priority": "high"}]}'

    def generate(self, prompt, system=""):
        return self.reply


def test_reviews_resume(context):
    context.make_client = Fake
    try:
        first = run_tool(context, "design_review")
        assert "0 were current" in first
        assert run_tool(context, "design_review").startswith("0 reviews made")
        lines = run_tool(context, "get_findings").splitlines()
        assert lines[0].startswith("[high]")
        assert run_tool(context, "architecture_conclusion") == Fake.reply
        assert context.store.table("arch_module_review").count() == 2
        run_tool(context, "architecture_conclusion")
        assert context.store.table("arch_module_review").count() == 2
    finally:
        context.make_client = Offline


def test_verifier_fails_open(spark, context):
    found = spark.createDataFrame([("r", "k", "high", t, "d", ["m"], ["e"], []) for t in ("keep", "deny", "mute")], "rule_id string, kind string, severity string, title string, detail string, modules array<string>, evidence array<string>, subject array<string>")

    class Judge(Offline):
        def generate(self, prompt, system=""):
            return None if "mute" in prompt else json.dumps({"is_real": "deny" not in prompt})

    assert sorted(r["title"] for r in review.verify(found, Judge, context.store.table("llm_cache"), "m").collect()) == ["keep", "mute"]


def test_ask_uses_the_cache(spark, context):
    prompts = spark.createDataFrame([("a", "s", "p1"), ("b", "s", "p2")], "k string, system string, prompt string")
    cache = spark.createDataFrame([(prompt_hash("m", "s", "p1"), "m", "held")], "prompt_hash string, model string, response string")
    got = {r["k"]: (r["response"], r["fresh"]) for r in review.ask(prompts, Fake, cache, "m", ["k"]).collect()}
    assert got == {"a": ("held", False), "b": (Fake.reply, True)}
    assert review.to_cache(review.ask(prompts, Fake, cache, "m", ["k"]), "m").count() == 1


class Flaky(Offline):
    """Fails half-way: after three calls, wherever they are made, until the file says that it may go on."""

    model = "m"

    def __init__(self, folder):
        self.folder = folder

    def answer(self, prompt, system=""):
        import uuid

        if not os.path.exists(f"{self.folder}/on") and len(os.listdir(self.folder)) >= 3:
            raise RuntimeError("broken off")
        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        return f"answer to {prompt}", "other" if prompt == "p0" else "m"


def test_broken_off_runs_go_on(spark, tmp_path):
    from functools import partial

    from codestrata.tools.store import Store

    calls = tmp_path / "calls"
    calls.mkdir()
    store = Store(spark, str(tmp_path / "store"))
    prompts = spark.createDataFrame([(f"k{i}", "s", f"p{i % 8}") for i in range(10)], "k string, system string, prompt string")
    got = []
    go = lambda: review.ask_kept(prompts, partial(Flaky, str(calls)), store, "m", ["k"], workers=1, each=1, on_batch=got.extend)
    with pytest.raises(Exception, match="broken off"):
        go()
    first, kept = len(list(calls.iterdir())), store.table("llm_cache").count()
    assert first == 3 and 1 <= kept <= 3
    (calls / "on").touch()
    assert go() == 10 and {r["k"]: r["response"] for r in got} == {f"k{i}": f"answer to p{i % 8}" for i in range(10)}
    assert len(list(calls.iterdir())) - 1 == first + 8 - kept  # `on` is no call; what was kept is not sent again
    before = len(os.listdir(calls))
    assert go() == 10 and len(os.listdir(calls)) == before + 1  # p0 alone is sent once more
    assert store.table("llm_cache").filter("response LIKE '%p0'").count() == 0 and store.table("llm_cache").count() == 7


def test_segments(spark, tmp_path, monkeypatch):
    from codestrata.tools import store as S

    monkeypatch.setattr(S, "SEGMENTS", 3)
    store = S.Store(spark, str(tmp_path / "s"))
    for i in range(3):
        store.append("arch_module_review", [(f"m{i}", "{}", "h"), (f"m{i}", "{}", "h2")])
    folder = tmp_path / "s" / "arch_module_review"
    assert sorted(p.name for p in folder.iterdir()) == ["v0s1", "v0s2", "v0s3"]  # an append writes only its rows
    torn = folder / "v0s4"
    torn.mkdir()
    (torn / "part-0.parquet").write_bytes(b"half")
    assert [r["id"] for r in store.table("arch_module_review").orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]
    store.append("arch_module_review", [("m9", "{}", "h")])
    assert "v1" in {p.name for p in folder.iterdir()} and store.table("arch_module_review").count() == 7
    store.append("arch_module_review", [("m9", "{}", "h3")])
    assert (folder / "v1s1").exists() and {r["graph_hash"] for r in store.latest("arch_module_review", "module_name").filter("module_name = 'm9'").collect()} == {"h3"}
    answers = lambda *rows: spark.createDataFrame(rows, "prompt_hash string, model string, response string")
    store.put("llm_cache", answers(("a", "m", "1"), ("b", "m", "1")))
    store.put("llm_cache", answers(("a", "m", "2")))
    assert {r["prompt_hash"]: r["response"] for r in store.table("llm_cache").collect()} == {"a": "2", "b": "1"}


def test_json_rescue():
    assert review.safe_json('x ```json\n{"a": 1}\n``` y') == {"a": 1}
    assert review.safe_json('so {"a": "}{", "b": {"c": 2}} and {bad}') == {"a": "}{", "b": {"c": 2}}
    assert review.safe_json('{"q": "a \\" } b"}') == {"q": 'a " } b'} and review.safe_json("none") is None and review.safe_json(None) is None


def test_rules_from_prose():
    class Compiler(Offline):
        def generate(self, prompt, system=""):
            return '{"rules": [{"kind": "forbid_dependency", "params": {"from": "a", "to": "b"}}, {"kind": "unknown"}, 3]}'

    assert [(r.kind, r.params) for r in review.compile_rules(Compiler(), "x")] == [("forbid_dependency", {"from": "a", "to": "b"})]
    assert review.compile_rules(Offline(), "x") == []


OPENAI = {"choices": [{"message": {"content": "hi", "tool_calls": [{"id": "1", "function": {"name": "f", "arguments": '{"x": 1}'}}]}}]}
ANTHROPIC = {"content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "1", "name": "f", "input": {"x": 1}}]}


@pytest.mark.parametrize("provider,reply", [("openai", OPENAI), ("anthropic", ANTHROPIC)])
def test_wire_formats(provider, reply):
    sent = []
    c = Client(Config(provider, "http://h", "key", "m1", ("m2",)), lambda url, head, body, t: (sent.append((url, body)), (200, reply))[1])
    got = c.generate_with_tools([{"role": "user", "content": "q"}], [{"name": "f", "description": "d", "parameters": {}}], "sys")
    assert got.text == "hi" and got.calls[0].args == {"x": 1} and sent[0][1]["tools"]
    assert c.generate("p") == "hi" and c.generate("p") == "hi" and len(sent) == 2


def test_fallbacks_and_failures():
    def post(url, head, body, t):
        if body["model"] == "m1":
            return 429, {}
        if body["model"] == "m2":
            raise TimeoutError("slow")
        return 200, {"choices": [{"message": {"content": "third"}}]}

    c = Client(Config(model="m1", fallbacks=("m2", "m3")), post)
    assert c.generate("p") == "third" and c.cache == {}  # only the first model's answers are kept
    down = Client(Config(model="m1", fallbacks=("m2",)), post)
    assert down.generate("p") is None and down.generate_with_tools([], []).text
    assert parse_args("[1]") == {} and parse_args("{bad") == {} and parse_args({"a": 1}) == {"a": 1}


def test_host_stops(context):
    class Loop(Client):
        def generate_with_tools(self, messages, tools, system=""):
            from codestrata.tools.client import Reply, ToolCall

            return Reply("", [ToolCall("1", "nothing", {})], {"role": "assistant"})

    host = Host(context, Loop(Config()))
    assert str(MAX_STEPS) in host.ask("q") and len(host.history) == 1 + 2 * MAX_STEPS
    assert Host(context, Offline()).ask("q") == "No model is configured."


def test_store_versions_and_clearing(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.append("arch_audit", [("{}", "h")])
    s.append("arch_audit", [("{1}", "h"), ("{2}", None)])
    assert [r["id"] for r in s.table("arch_audit").orderBy("id").collect()] == [1, 2, 3]
    s.put("llm_cache", spark.createDataFrame([("a", "m", "1"), ("b", "m", "2")], "prompt_hash string, model string, response string"))
    s.put("llm_cache", spark.createDataFrame([("a", "m", "3")], "prompt_hash string, model string, response string"))
    assert sorted((r["prompt_hash"], r["response"]) for r in s.table("llm_cache").collect()) == [("a", "3"), ("b", "2")]
    s.clear_all()
    assert s.table("arch_audit").count() == 0 and s.table("llm_cache").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    from codestrata.sources import scan
    from codestrata.streaming import incremental

    root = tree.make(tmp_path / "src")
    run = lambda: incremental.watch(spark, root, str(tmp_path / "rows"), str(tmp_path / "check")).awaitTermination(120)
    run()
    with open(f"{root}/b/New.hxx", "w") as f:
        f.write("class New { Tank* t; };\n")
    run()
    key = lambda df: sorted((r["tag"], r["kind"], r["name"], r["source_qname"], r["target_name"], r["start_line"]) for r in df.filter("tag <> 'alias'").collect())
    got = sorted(map(str, key(incremental.current_rows(spark, str(tmp_path / "rows")))))
    assert got == sorted(map(str, key(scan.parse(scan.files(spark, root))))) and len(os.listdir(tmp_path / "rows")) >= 2
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "b", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["event_type"], r["n"], r["total"]) for r in incremental.event_counts(events).collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_prompts_of_the_class_review(spark, context, tmp_path):
    from codestrata.tools import design, skills
    from codestrata.tools.registry import show_status

    e, r = context.graph()
    inside = spark.createDataFrame([("Boat", "Boat"), ("Boat", "Tank"), ("Boat", "Motor"), ("Latin", "Latin")], "subtree_root string, id string")
    got = {x["subtree_root"]: x["prompt"] for x in design.subtree_prompts(inside, e, r).collect()}
    assert "  - class Boat  (b/Boat.sch:3-3)" in got["Boat"] and "  - Motor::Start  ::  void Start();" in got["Boat"] and "  - Boat  --composes-->  Tank" in got["Boat"]
    assert "IPart" not in got["Boat"].split("Relations:")[1] and "Relations:\n  (none)" in got["Latin"]
    os.makedirs(tmp_path / "deep")
    (tmp_path / "deep" / "design_critic.md").write_text("{SCOPE} of {ROOT}: {FIELDS}{SUBTREES}")
    (tmp_path / "design_critic.example.md").write_text("no")
    mine = skills.find(str(tmp_path), skills.REVIEW)
    assert {x["prompt"] for x in design.subtree_prompts(inside.filter("subtree_root = 'Latin'"), e, r, mine).collect()} == {"subtree of Latin:   - Latin::x  ::  int  (none)"}
    assert design.module_prompt([("A", "fine")], [], mine) == "module of :   - A: fine" and skills.find(str(tmp_path), skills.RULES) is None
    assert show_status(context).splitlines()[1].startswith("Shop::Car")


def test_top_k(spark):
    from codestrata.operators.relational import top_k

    df = spark.createDataFrame([("a", i) for i in range(200)] + [("b", 1)], "k string, n int")
    assert sorted((r["k"], r["n"]) for r in top_k(df, ["k"], [F.desc("n")], 3).collect()) == [("a", 197), ("a", 198), ("a", 199), ("b", 1)]


def test_responsibility_tree(spark):
    from codestrata.operators.graph import responsibility_tree

    tree = spark.createDataFrame([("r", "a", "r"), ("r", "b", "r"), ("r", "c", "b"), ("r", "d", "c"), ("r", "e", "d")], "root string, id string, parent string")
    got = {r["id"]: (r["depth"], r["place"], r["weight"], r["truncated"]) for r in responsibility_tree(tree, 2).collect()}
    assert got == {"b": (1, 1, 4, False), "a": (1, 2, 1, False), "c": (2, 1, 3, True)}
