"""The tools: a fixed list of named queries over a project, with schemas, that never raise."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions.kinds import CLASS_KINDS
from codestrata.functions.text import evidence, last_segment
from codestrata.operators import decouple, graph, modules, relational, rules
from codestrata.session import Scratch
from codestrata.sources import scan
from codestrata.tools import design, report, review, skills
from codestrata.tools.client import Offline
from codestrata.tools.sql import NotReadOnly, as_text, run_select
from codestrata.tools.store import Store

# How much a tool shows.
MAX_CLASSES, MAX_RELATIONSHIPS, MAX_METHODS, MAX_FIELDS, MAX_LINES, MAX_EDGES = 200, 200, 60, 40, 300, 12


@dataclass
class Context:
    """A project: where its sources are, where its tables are, and who answers prompts."""

    spark: SparkSession
    root: str
    store: Store
    make_client: Callable = Offline
    skills: str = ""  # a folder with the project's own rules and review method
    groups: list = field(default_factory=list)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        e, r = self.store.read("entities"), self.store.read("relationships")
        if e is None or r is None:
            raise LookupError("Nothing is scanned yet; call scan_source first.")
        return e, r

    def classes(self) -> DataFrame:
        return self.graph()[0].filter(F.col("kind").isin(*CLASS_KINDS))

    def graph_hash(self) -> str:
        return relational.incremental_fingerprint(self.graph()[1]).first()[0]


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    handler: Callable

    @property
    def parameters(self) -> dict:
        """JSON schema of the arguments, from the handler's signature."""
        kinds = {"str": "string", "int": "integer", "bool": "boolean"}
        args = list(inspect.signature(self.handler).parameters.values())[1:]
        return {"type": "object", "properties": {a.name: {"type": kinds[str(a.annotation)]} for a in args}, "required": [a.name for a in args if a.default is a.empty]}

    def schema(self) -> dict:
        return {"name": self.name, "description": self.description, "parameters": self.parameters}


TOOLS: dict[str, Tool] = {}


def tool(f: Callable) -> Callable:
    TOOLS[f.__name__] = Tool(f.__name__, " ".join((f.__doc__ or "").split()), f)
    return f


def run_tool(context: Context, name: str, args: dict | None = None) -> str:
    """The tool's text; an unknown tool, wrong arguments and failures are texts as well."""
    if name not in TOOLS:
        return f"Unknown tool: {name}. Tools: {', '.join(sorted(TOOLS))}"
    given = {k: v for k, v in (args or {}).items() if v is not None}
    try:
        inspect.signature(TOOLS[name].handler).bind(context, **given)
    except TypeError as e:
        return f"{name} does not take these arguments: {e}"
    try:
        return TOOLS[name].handler(context, **given)
    except Exception as e:  # a tool never raises
        return f"{name} failed: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


@tool
def scan_source(c: Context, directory: str = "", force: bool = False) -> str:
    """Scan the source tree into entities and relationships; does nothing if that is done, unless forced."""
    held = c.store.read("entities")
    if held is not None and not force and not held.isEmpty():
        return "Already scanned; use force to scan again."
    found = scan.scan(c.spark, directory or c.root, f"{c.store.path}/parse_cache")
    c.store.write("entities", found.entities)
    c.store.write("relationships", found.relationships)
    s = found.statistics.first().asDict()
    nodes = report.class_nodes(found.entities)
    edges = graph.build_graph(nodes, found.relationships.select(F.col("source_qname").alias("src"), F.col("target_qname").alias("dst"), "kind"))
    style = graph.style(found.entities, edges).first()["style"]
    scored = graph.crtp_scores(nodes, edges) if style == "crtp" else graph.oop_scores(nodes, edges)
    top = scored.orderBy(F.desc("score"), "id").first()
    classes = s["class_count"] + s["struct_count"] + s["interface_count"]
    c.store.append("module_info", [((directory or c.root).rstrip("/").split("/")[-1], directory or c.root, top["id"] if top else None, s["file_count"], classes, style)])
    return f"Scanned {s['file_count']} files: {classes} classes, {s['relationship_count']} relationships, {s['resolved_count']} resolved; style {style}; orchestrator {top['id'] if top else 'none'}."


@tool
def get_overview(c: Context) -> str:
    """Counts, the share of unresolved relationships, style and orchestrator."""
    e, r = c.graph()
    kinds = {x["kind"]: x["count"] for x in e.groupBy("kind").count().collect()}
    u = relational.unresolved_ratio(r).first()
    info = c.store.latest("module_info", "module_name").orderBy(F.desc("id")).first()
    lines = [f"{k}: {n}" for k, n in sorted(kinds.items())] + [f"relationships: {u['total']}, unresolved {u['pct'] or 0:.1f} %{' (read with caution)' if u['caution'] else ''}"]
    return "\n".join([*lines, *([f"style: {info['style']}, orchestrator: {info['orchestrator']}"] if info else [])])


def show_status(c: Context, rows: int = 50) -> str:
    """The console dashboard: the classes of most members with their counts."""
    counts = relational.member_counts(c.graph()[0]).orderBy(F.desc(F.col("methods") + F.col("fields")), "qualified_name").limit(rows).collect()
    return "\n".join([f"{'class':50} methods fields", *[f"{r['qualified_name']:50} {r['methods']:7d} {r['fields']:6d}" for r in counts]])


@tool
def list_classes(c: Context, limit: int = MAX_CLASSES) -> str:
    """Classes by name with their kinds and files."""
    found = c.classes()
    rows = found.orderBy("qualified_name", "kind").limit(min(limit, MAX_CLASSES)).collect()
    return "\n".join([f"{found.count()} classes", *[f"{r['qualified_name']} ({r['kind']}) {r['file_path']}:{r['start_line']}" for r in rows]])


def _resolve(c: Context, name: str) -> list[str]:
    names = c.classes().select("qualified_name").distinct()
    return sorted(r["qualified_name"] for r in relational.resolve_tiered(names, name).orderBy("qualified_name").limit(50).collect())


@tool
def get_relationships(c: Context, class_qname: str = "", limit: int = MAX_RELATIONSHIPS, direction: str = "outgoing") -> str:
    """Relationships of a class, outgoing, incoming or both; of all classes without a name. Strongest first."""
    r = c.graph()[1]
    if class_qname:
        names = _resolve(c, class_qname)
        if not names:
            return f"No class matches {class_qname}."
        out, into = r.filter(F.col("source_qname").isin(names)), r.filter(F.col("target_qname").isin(names))
        r = out if direction == "outgoing" else into if direction == "incoming" else out.unionByName(into)
    target = F.coalesce(F.nullif("target_qname", F.lit("")), "target_name")
    text = evidence(F.col("source_qname"), F.col("kind"), target, F.col("evidence_file"), F.col("evidence_line"))
    rows = r.orderBy(F.desc("level"), "source_qname", target, "evidence_file", "evidence_line").limit(min(limit, MAX_RELATIONSHIPS)).select(text.alias("t")).collect()
    return "\n".join(x["t"] for x in rows) or "No relationships."


@tool
def describe_class(c: Context, name: str) -> str:
    """A class's members, what it uses and what uses it."""
    e, r = c.graph()
    names = _resolve(c, name)
    if not names:
        return f"No class matches {name}."
    if len(names) > 1:
        return "Several classes match: " + ", ".join(names)
    p = relational.profile(e, r, names[0]).first()
    cut = {"methods": MAX_METHODS, "fields": MAX_FIELDS}
    return "\n".join([names[0], *[f"{k}: {', '.join(p[k][: cut.get(k, MAX_RELATIONSHIPS)]) or '-'}" for k in ("methods", "fields", "bases", "uses", "subclasses", "users")]])


@tool
def get_source(c: Context, name: str = "", file: str = "", start: int = 0, end: int = 0) -> str:
    """Numbered source lines of a class, of a method (its longest form), or of a file or a part of it; at most 300."""
    e = c.graph()[0]
    if name:
        owner, _, member = name.rpartition("::")
        found = _resolve(c, name)
        rows = e.filter(F.col("kind").isin(*CLASS_KINDS) & F.col("qualified_name").isin(found[:1]))
        if not found and owner:
            found = _resolve(c, owner)
            rows = e.filter((F.col("kind") == "method") & F.col("parent_qname").isin(found[:1]) & (F.lower("name") == member.lower()))
        if len(found) > 1:
            return f"{name} is ambiguous: " + ", ".join(found)
        span = rows.filter("start_line > 0").orderBy(F.desc(F.col("end_line") - F.col("start_line")), "qualified_name", "file_path").first() if found else None
        if span is None:
            return f"No source of {name} is in scope."
        path, start, end = span["file_path"], start or span["start_line"], end or span["end_line"]
    elif file:
        paths = sorted(r["file_path"] for r in relational.resolve_file(e.select("file_path").distinct(), file).orderBy("file_path").limit(50).collect())
        if len(paths) != 1:
            return "Several files match: " + ", ".join(paths) if paths else f"No scanned file matches {file}."
        path = paths[0]
    else:
        return "Give a name or a file."
    start = max(1, start)
    end = min(end if end >= start else start + MAX_LINES - 1, start + MAX_LINES - 1)
    text = scan.files(c.spark, c.root, False).filter(F.col("file_path") == path).select("file_path", "text")
    lines = relational.source_lines(text, "text", start, end).orderBy("line_no").collect()
    return "\n".join([path, *[f"{r['line_no']:5d} {r['line']}" for r in lines]])


def _members(c: Context, strategy: str, groups: list | None) -> tuple[DataFrame, DataFrame, str]:
    """Resolved relationships (src, dst, kind, evidence_file, evidence_line), the classes' (id, module, name), and the strategy used."""
    e, r = c.graph()
    classes = e.filter(F.col("kind").isin(*CLASS_KINDS)).groupBy("qualified_name").agg(F.min("file_path").alias("file_path"))
    rel = r.filter("target_qname IS NOT NULL").select(F.col("source_qname").alias("src"), F.col("target_qname").alias("dst"), "kind", "evidence_file", "evidence_line")
    member, used = modules.assign(classes, rel.select("src", "dst"), strategy, groups)
    return rel, Scratch(c.spark, "modules").write(member.select(F.col("qualified_name").alias("id"), "module", last_segment(F.col("qualified_name")).alias("name"))), used


def _with_evidence(references: DataFrame) -> DataFrame:
    """Edges between modules with their first evidence."""
    return modules.module_edges(references, evidence(F.col("from_class"), F.col("kind"), F.col("to_class"), F.col("evidence_file"), F.col("evidence_line")))


def _module_graph(c: Context, strategy: str, groups: list | None) -> tuple[rules.ModuleGraph, DataFrame, str]:
    rel, member, used = _members(c, strategy, groups)
    edges = Scratch(c.spark, "module-edges").write(_with_evidence(modules.module_references(rel, member)))
    return rules.ModuleGraph(member.select(F.col("module").alias("id")).distinct(), edges), member, used


def audit_payload(c: Context, strategy: str = "auto", verified: bool = False) -> dict:
    """nodes, edges, findings, plans and the share of unresolved relationships."""
    mg, member, used = _module_graph(c, strategy, c.groups)
    contract = list(rules.UNIVERSAL) + (review.compile_rules(c.make_client(), text) if c.skills and (text := skills.find(c.skills, skills.RULES)) else [])
    found = Scratch(c.spark, "audit").write(rules.audit(mg, tuple(contract)).coalesce(1))
    if verified:
        found = review.verify(found, c.make_client, c.store.table("llm_cache"), c.make_client().model)
    plans = decouple.plans(mg.nodes, mg.edges)
    listed = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    ordered = found.orderBy(rules.severity_rank(F.col("severity")), -F.size("modules"), "rule_id", "title")
    return {
        "strategy": used, "nodes": listed(rules.audit_nodes(mg, found, member).orderBy("id")), "edges": listed(rules.audit_edges(mg, found).orderBy("src", "dst")), "findings": listed(ordered),
        "plans": listed(plans), "unresolved_pct": relational.unresolved_ratio(c.graph()[1]).first()["pct"],
    }


def format_findings(findings: list[dict], keep: int = 5) -> str:
    return "\n".join(line for f in findings for line in (f"[{f['severity']}] {f['title']}: {f['detail']}", *[f"    {e}" for e in f["evidence"][:keep]])) or "No findings."


def format_plans(plans: list[dict]) -> str:
    return "\n".join(line for p in plans for line in (f"Cycle {', '.join(p['members'])}: effort {p['effort']}, order {', '.join(p['order'])}", *[f"    cut {x['src']} -> {x['dst']} ({x['weight']} references): {x['prescription']}" for x in p["cuts"]])) or "No cycles."


@tool
def architecture_audit(c: Context, strategy: str = "auto", verify: bool = False) -> str:
    """Check the architecture rules over the module graph and keep the result."""
    p = audit_payload(c, strategy, verify)
    c.store.append("arch_audit", [(json.dumps(p, sort_keys=True), c.graph_hash())])
    return f"Modules by {p['strategy']}, {p['unresolved_pct'] or 0:.1f} % unresolved.\n" + format_findings(p["findings"])


@tool
def module_dependencies(c: Context, from_module: str = "", to_module: str = "", strategy: str = "auto") -> str:
    """The module dependency matrix, or the evidence between two modules."""
    rel, member, _ = _members(c, strategy, c.groups)
    if not from_module and not to_module:  # no evidence is shown, so equal references travel once
        counted = rel.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))
        rows = modules.module_edges(modules.module_references(counted, member)).orderBy(F.desc("weight"), "src", "dst").limit(MAX_RELATIONSHIPS).collect()
        return "\n".join(f"{r['src']} -> {r['dst']}: {r['weight']} ({', '.join(r['kinds'])})" for r in rows) or "No dependencies."
    names = [r["module"] for r in member.select("module").distinct().collect()]

    def pick(q: str) -> list[str]:
        low = q.lower()
        tiers = ([n for n in names if n.lower() == low], [n for n in names if n.lower().endswith(low) or low.endswith(n.lower())], [n for n in names if low in n.lower()])
        return next((t for t in tiers if t), []) if q else names

    part = lambda q: member.filter(F.col("module").isin(pick(q)))
    between = Scratch(c.spark, "between").write(modules.module_references(rel, part(from_module), part(to_module)))
    rows = _with_evidence(between).orderBy(F.desc("weight"), "src", "dst").limit(MAX_EDGES).collect()
    return "\n".join(line for r in rows for line in (f"{r['src']} -> {r['dst']}: {r['weight']}", *[f"    {e}" for e in r["evidence"]])) or "No such dependency."


def _workers(client) -> int:
    """How many calls a client's configuration allows at once."""
    return max(1, getattr(getattr(client, "config", None), "workers", 6))


@tool
def architecture_conclusion(c: Context) -> str:
    """Review each module by a model, then conclude; reviews of the current graph are used again."""
    p = c.store.table("arch_audit").orderBy(F.desc("id")).first()
    payload = json.loads(p["payload_json"]) if p else audit_payload(c)
    if not payload["nodes"]:
        return "No modules."
    now, client = c.graph_hash(), c.make_client()
    nodes = c.spark.createDataFrame([(n["id"], n["members"] or []) for n in payload["nodes"]], "id string, members array<string>")
    edges = c.spark.createDataFrame([(e["src"], e["dst"], e["weight"]) for e in payload["edges"]], "src string, dst string, weight long")
    found = c.spark.createDataFrame([(f["modules"], f["severity"], f["title"]) for f in payload["findings"]], "modules array<string>, severity string, title string")
    todo = review.pending(review.module_prompts(nodes, edges, found), c.store.latest("arch_module_review", "module_name"), now, "module")

    def keep(answers: list) -> None:
        parsed = [(a["module"], json.dumps(j), now) for a in answers if (j := review.safe_json(a["response"]))]
        if parsed:
            c.store.append("arch_module_review", parsed)

    review.ask_kept(todo, c.make_client, c.store, client.model, ["module"], _workers(client), on_batch=keep)
    held = {r["module_name"]: r["parsed_json"] for r in c.store.latest("arch_module_review", "module_name").filter(F.col("graph_hash") == now).collect()}
    order = sorted(payload["nodes"], key=lambda n: (0 if n["is_god"] else 1 if n["in_cycle"] else 2, -n["in_degree"], n["id"]))
    out = review.synthesize(client, [(n["id"], held[n["id"]]) for n in order if n["id"] in held])
    return out or "No model is configured, or none of the reviews succeeded."


@tool
def decoupling_plan(c: Context, strategy: str = "auto") -> str:
    """Which dependencies to cut so that no module cycle is left; user groups are not used here."""
    mg, _, _ = _module_graph(c, strategy, None)
    return format_plans([r.asDict(recursive=True) for r in decouple.plans(mg.nodes, mg.edges).collect()])


@tool
def design_review(c: Context, force: bool = False) -> str:
    """Review the classes below each root by a model; done once for each state of the graph."""
    e, r = c.graph()
    now, client = c.graph_hash(), c.make_client()
    done = c.store.latest("design_critic_subtree", "subtree_root").filter(F.col("raw_response").isNotNull() & (F.col("graph_hash").isNull() | (F.col("graph_hash") == now)))
    nodes = report.class_nodes(e)
    edges = graph.build_graph(nodes, r.select(F.col("source_qname").alias("src"), F.col("target_qname").alias("dst"), "kind"))
    comp = Scratch(c.spark, "review").write(graph.components(nodes, edges))
    cond = graph.condensed_edges(comp, edges)
    roots = graph.roots(comp.select(F.col("component").alias("id")).distinct(), cond)
    inside = graph.subtree_members(comp, cond, roots).withColumnRenamed("root", "subtree_root")
    todo = inside if force else inside.join(done.select("subtree_root"), "subtree_root", "left_anti")
    override = skills.find(c.skills, skills.REVIEW) if c.skills else None
    prompts = design.subtree_prompts(todo, e, r, override)
    current = done.count()
    parsed = lambda t: json.dumps(j) if (j := review.safe_json(t)) else None
    keep = lambda answers: c.store.append("design_critic_subtree", [(a["subtree_root"], None, a["response"], parsed(a["response"]), now) for a in answers])
    made = review.ask_kept(prompts, c.make_client, c.store, client.model, ["subtree_root"], _workers(client), on_batch=keep)
    if made:
        rows = c.store.latest("design_critic_subtree", "subtree_root").orderBy("subtree_root").collect()
        prompt = design.module_prompt([(x["subtree_root"], x["parsed_json"] or x["raw_response"]) for x in rows], design.cross_relations(r, comp), override)
        conclusion = client.generate(prompt, design.SYSTEM)
        if conclusion:
            c.store.append("design_critic_module", [("project", prompt, conclusion, parsed(conclusion), now)])
    return f"{made} reviews made, {current} were current."


@tool
def get_findings(c: Context) -> str:
    """The latest reviews' recommendations, by priority, and the latest audit's findings."""
    recs = []
    for r in c.store.latest("design_critic_subtree", "subtree_root").filter("parsed_json IS NOT NULL").orderBy("subtree_root").collect():
        recs += [{**x, "root": r["subtree_root"]} for x in json.loads(r["parsed_json"]).get("recommendations") or [] if isinstance(x, dict)]
    lines = [f"[{x.get('priority', '?')}] {x['root']}: {x.get('title', '')}" for x in review.by_priority(recs)]
    audit = c.store.table("arch_audit").orderBy(F.desc("id")).first()
    return "\n".join([*lines, *([format_findings(json.loads(audit["payload_json"])["findings"])] if audit else [])]) or "No findings."


@tool
def query_db(c: Context, sql: str) -> str:
    """A read-only SELECT over entities, relationships and the logs; at most 50 rows are shown."""
    e, r = c.graph()
    from codestrata.tools.store import LOGS

    try:
        return as_text(run_select(c.spark, sql, {"entities": e, "relationships": r, **{n: c.store.table(n) for n in LOGS}}))
    except NotReadOnly as err:
        return str(err)


@tool
def generate_report(c: Context, path: str = "report.html") -> str:
    """Write the report page."""
    e, r = c.graph()
    audit = c.store.table("arch_audit").orderBy(F.desc("id")).first()
    reviews = {x["module_name"]: x["parsed_json"] for x in c.store.latest("arch_module_review", "module_name").collect()}
    info = c.store.latest("module_info", "module_name").orderBy(F.desc("id")).first()
    page = report.render(report.build_payload(e, r, json.loads(audit["payload_json"]) if audit else audit_payload(c), reviews, info["orchestrator"] if info else None))
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
    return f"Wrote {path}."
