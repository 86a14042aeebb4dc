"""Queries for the tools, the audit, names and logs, each with its oracle.

The tools run on a project whose tables are the adapter's graph, with orders as the
classes' members; a tool's text comes back line by line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import kinds as K
from codestrata.functions import text as X
from codestrata.operators import decouple, graph, modules, names, rules
from codestrata.operators import relational as R
from codestrata.plans import adapter as A
from codestrata.plans.graph_queries import CEDGE, COMP, DEGREE, DOM_ROOTS, EVIDENCE, MODDEG, MODEDGE, MODGRAPH, REACH, REACHED, _edges, _module_graph
from codestrata.plans.registry import ORACLES, query
from codestrata.session import Scratch
from codestrata.session import read_table as read
from codestrata.tools import design, report, review
from codestrata.tools.registry import Context, run_tool
from codestrata.tools.sql import run_select
from codestrata.tools.store import Store

MEMBER = """member AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'field' ELSE 'method' END AS kind, concat('m', o_orderkey % 100) AS name, e.qualified_name AS parent,
    e.file_path, CASE WHEN o_orderkey % 5 = 0 THEN 'double m() const = 0;' ELSE 'void m(int n);' END AS signature FROM orders JOIN ent e ON e.id = o_custkey)"""
SAID = f"""said AS (SELECT a.qualified_name AS source, coalesce(b.qualified_name, 'external') AS target, b.qualified_name AS target_q, r.kind, {A.LEVEL.format(k="r.kind")} AS level, a.file_path, concat('C', r.src, '.hxx') AS file, r.evidence_line AS line
  FROM rel r JOIN ent a ON a.id = r.src LEFT JOIN ent b ON b.id = r.dst)"""
LINE = "concat(source, ' --', kind, '--> ', target, ' (', file, ':', line, ')')"
FULL = f"{A.ENT}, {A.REL}, {MEMBER}, {SAID}"


class AdapterContext(Context):
    """A project whose graph is the adapter's."""

    def __init__(self, spark: SparkSession, d: str):
        super().__init__(spark, d, Store(spark, Scratch(spark, "tools").path("store")))
        self.d = d

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return project(self.spark, self.d)


def project(spark: SparkSession, d: str, rels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """entities and relationships with all columns of a scanned project; of the relationships those given, as the adapter has them."""
    ents, rels = A.code_graph(spark, d, rels)
    none = F.lit(None).cast("string")
    start = (F.col("id") % 50 + 1).cast("int")
    classes = ents.select("kind", "name", "qualified_name", none.alias("parent_qname"), "file_path", start.alias("start_line"), (start + 10).alias("end_line"), none.alias("signature"), (F.col("id") % 7 == 0).alias("phantom"), (F.col("kind") == "interface").alias("abstract"))
    key, name = F.col("o_orderkey"), F.concat(F.lit("m"), (F.col("o_orderkey") % 100).cast("string"))
    of = read(spark, d, "orders").join(ents.select(F.col("id").alias("o_custkey"), F.col("qualified_name").alias("owner"), "file_path"), "o_custkey")
    members = of.select(
        F.when(key % 3 == 0, "field").otherwise("method").alias("kind"), name.alias("name"), F.concat("owner", F.lit("::"), name).alias("qualified_name"), F.col("owner").alias("parent_qname"), "file_path",
        F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), F.when(key % 5 == 0, "double m() const = 0;").otherwise("void m(int n);").alias("signature"), F.lit(False).alias("phantom"), F.lit(False).alias("abstract"),
    )
    return classes.unionByName(members), rels.withColumn("level", K.level_of(F.col("kind")))


def _tool(spark, d, tool, **args) -> DataFrame:
    lines = run_tool(AdapterContext(spark, d), tool, args).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


# -- tools -----------------------------------------------------------------------
@query(f"WITH {A.ENT}, t AS (SELECT row_number() OVER (ORDER BY qualified_name, kind) AS line_no, concat(qualified_name, ' (', kind, ') ', file_path, ':', id % 50 + 1) AS line FROM ent) SELECT 0 AS line_no, concat(count(*), ' classes') AS line FROM ent UNION ALL SELECT line_no, line FROM t WHERE line_no <= 200")
def tool_list_classes(spark, d):
    return _tool(spark, d, "list_classes")


@query(
    f"""WITH {FULL}, t AS (SELECT kind AS k, concat(kind, ': ', count(*)) AS line FROM (SELECT kind FROM ent UNION ALL SELECT kind FROM member) GROUP BY kind
  UNION ALL SELECT '~', (SELECT concat('relationships: ', count(*), ', unresolved ', printf('%.1f', avg(CASE WHEN target_q IS NULL THEN 100.0 ELSE 0.0 END)), ' %', CASE WHEN avg(CASE WHEN target_q IS NULL THEN 100.0 ELSE 0.0 END) > 25 THEN ' (read with caution)' ELSE '' END) FROM said))
SELECT row_number() OVER (ORDER BY k) - 1 AS line_no, line FROM t"""
)
def tool_overview(spark, d):
    return _tool(spark, d, "get_overview")


@query(
    f"""WITH {FULL}, own AS (SELECT qualified_name AS q FROM ent WHERE name = 'C12'), hit AS (SELECT * FROM said WHERE source IN (FROM own) UNION ALL SELECT * FROM said WHERE target_q IN (FROM own)),
  o AS (SELECT *, row_number() OVER (ORDER BY level DESC, source, target, file_path, line) AS r FROM hit) SELECT r - 1 AS line_no, {LINE} AS line FROM o WHERE r <= 200"""
)
def tool_relationships(spark, d):
    """Both directions of one class, strongest first."""
    return _tool(spark, d, "get_relationships", class_qname="c12", direction="both")


@query(f"WITH {FULL}, o AS (SELECT *, row_number() OVER (ORDER BY level DESC, source, target, file_path, line) AS r FROM said WHERE target_q = (SELECT qualified_name FROM ent WHERE name = 'C13')) SELECT r - 1 AS line_no, {LINE} AS line FROM o WHERE r <= 7")
def tool_relationships_incoming(spark, d):
    return _tool(spark, d, "get_relationships", class_qname="c13", direction="incoming", limit=7)


def _names(what: str, where: str, source: str, keep: int) -> str:
    return f"coalesce((SELECT array_to_string(list_sort(list(DISTINCT {what}))[:{keep}], ', ') FROM {source} WHERE {where}), '-')"


def _profiles(q: str) -> dict[str, str]:
    is_a = "kind IN ('inherits', 'implements')"
    return {
        "methods": _names("name", f"parent = {q} AND kind = 'method'", "member", 60), "fields": _names("name", f"parent = {q} AND kind = 'field'", "member", 40), "bases": _names("target", f"source = {q} AND {is_a}", "said", 200),
        "uses": _names("target", f"source = {q} AND NOT {is_a}", "said", 200), "subclasses": _names("source", f"target_q = {q} AND {is_a}", "said", 200), "users": _names("source", f"target_q = {q} AND NOT {is_a}", "said", 200),
    }


@query(f"WITH {FULL}, own AS (SELECT qualified_name AS q FROM ent WHERE name = 'C12') " + " UNION ALL ".join(["SELECT 0 AS line_no, q AS line FROM own", *[f"SELECT {i}, concat('{k}: ', {v}) FROM own" for i, (k, v) in enumerate(_profiles("q").items(), 1)]]))
def tool_describe_class(spark, d):
    return _tool(spark, d, "describe_class", name="c12")


@query(f"WITH {MODGRAPH}, e AS (SELECT src, dst, count(*) AS w, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS kinds FROM modref GROUP BY src, dst), o AS (SELECT *, row_number() OVER (ORDER BY w DESC, src, dst) AS r FROM e) SELECT r - 1 AS line_no, concat(src, ' -> ', dst, ': ', w, ' (', kinds, ')') AS line FROM o WHERE r <= 200")
def tool_module_matrix(spark, d):
    return _tool(spark, d, "module_dependencies", strategy="namespace")


@query(
    f"""WITH {FULL}, {A.MODULE}, two AS (SELECT s.e FROM (SELECT *, {LINE} AS e FROM said) s JOIN ent a ON a.qualified_name = s.source JOIN module m ON m.id = a.id AND m.module = 'Brand1' JOIN ent b ON b.qualified_name = s.target_q JOIN module n ON n.id = b.id AND n.module = 'Brand2'),
  o AS (SELECT row_number() OVER (ORDER BY e) AS r, e FROM (SELECT DISTINCT e FROM two))
SELECT 0 AS line_no, concat('Brand1 -> Brand2: ', (SELECT count(*) FROM two)) AS line UNION ALL SELECT r, concat('    ', e) FROM o WHERE r <= 12"""
)
def tool_module_evidence(spark, d):
    return _tool(spark, d, "module_dependencies", from_module="brand1", to_module="Brand2", strategy="namespace")


@query(f"WITH {FULL}, k AS (SELECT kind, count(*) AS n FROM (SELECT kind FROM ent UNION ALL SELECT kind FROM member) GROUP BY kind) SELECT 0 AS line_no, 'kind | n' AS line UNION ALL SELECT row_number() OVER (ORDER BY kind), concat(kind, ' | ', n) FROM k")
def tool_query_db(spark, d):
    return _tool(spark, d, "query_db", sql="SELECT kind, count(*) AS n FROM entities GROUP BY kind ORDER BY kind;")


# -- classes and their members ----------------------------------------------------
@query(f"WITH {A.ENT} SELECT qualified_name AS id, name, kind, file_path FROM ent WHERE id % 7 <> 0")
def real_classes(spark, d):
    return report.class_nodes(project(spark, d)[0])


PROFILED = ("C5", "C12", "C100")


@query(f"WITH {FULL} SELECT q.qualified_name, " + ", ".join(f"{v.replace(chr(44) + ' ' + chr(39) + '-' + chr(39) + ')', ', ' + chr(39) * 2 + ')')} AS {k}" for k, v in _profiles("q.qualified_name").items()).replace("[:60]", "").replace("[:40]", "").replace("[:200]", "") + f" FROM ent q WHERE q.name IN {PROFILED}")
def class_profiles(spark, d):
    e, r = project(spark, d)
    names = [x[0] for x in e.filter(F.col("name").isin(*PROFILED) & F.col("kind").isin(*K.CLASS_KINDS)).select("qualified_name").collect()]
    out = [R.profile(e, r, q) for q in sorted(names)]
    full = out[0]
    for o in out[1:]:
        full = full.unionByName(o)
    return full.select("qualified_name", *[F.array_join(c, ", ").alias(c) for c in _profiles("")])


SIGNATURE = "CASE o_orderkey % 6 WHEN 0 THEN 'double m() const = 0;' WHEN 1 THEN 'void m() { x = 0; }' WHEN 2 THEN 'virtual int f(int a = 0);' WHEN 3 THEN 'virtual void g() noexcept override = 0' WHEN 4 THEN 'int m_x = 0;' ELSE '~C() = default;' END"


def _signed(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", F.expr(SIGNATURE).alias("signature"))


@query("SELECT o_orderkey, o_orderkey % 6 IN (0, 3) AS pure FROM orders")
def pure_virtual(spark, d):
    return _signed(spark, d).select("o_orderkey", X.is_pure_virtual(F.col("signature")).alias("pure"))


@query(
    """WITH m AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 11 = 0 THEN 'field' ELSE 'method' END AS kind, o_orderkey % 6 IN (0, 3) AS pure, o_orderkey % 6 = 5 AS gone FROM orders),
  a AS (SELECT c, bool_or(pure) AS pure, bool_or(kind = 'field') AS fields, bool_or(kind = 'method' AND NOT pure AND NOT gone) AS other FROM m GROUP BY c)
SELECT concat('U', c_custkey) AS qualified_name, coalesce(pure, false) AS abstract, CASE WHEN coalesce(pure AND NOT fields AND NOT other, false) THEN 'interface' ELSE 'class' END AS kind FROM customer LEFT JOIN a ON c = c_custkey"""
)
def class_kinds_refined(spark, d):
    """Abstract classes and interfaces by their members, file by file."""
    key, file = F.col("o_orderkey"), F.lit("f.hxx").alias("file_path")
    owner = lambda c: F.concat(F.lit("U"), F.col(c).cast("string"))
    classes = read(spark, d, "customer").select(F.lit("class").alias("kind"), owner("c_custkey").alias("name"), owner("c_custkey").alias("qualified_name"), F.lit(None).cast("string").alias("parent_qname"), file, F.lit(False).alias("pure"))
    name = F.when(key % 6 == 5, "~U").otherwise("m")
    members = _signed(spark, d).select(F.when(key % 11 == 0, "field").otherwise("method").alias("kind"), name.alias("name"), F.concat(F.lit("m"), key.cast("string")).alias("qualified_name"), owner("o_custkey").alias("parent_qname"), file, X.is_pure_virtual(F.col("signature")).alias("pure"))
    return R.refine_class_kinds(classes.unionByName(members)).filter("parent_qname IS NULL").select("qualified_name", "abstract", "kind")


# -- names -------------------------------------------------------------------------
@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS target FROM documents")
def effective_targets(spark, d):
    key = F.col("doc_id")
    full = F.when(key % 3 == 0, F.col("source")).when(key % 3 == 1, "")
    return read(spark, d, "documents").select("doc_id", X.effective_target(full, F.when(key % 7 != 0, F.col("lang"))).alias("target"))


NOISE = "CASE p_partkey % 10 WHEN 0 THEN p_name WHEN 1 THEN 'vector' WHEN 2 THEN concat('JA_', p_type) WHEN 3 THEN concat('Part', p_partkey) WHEN 4 THEN p_type WHEN 5 THEN concat('part', p_partkey, '_t') WHEN 6 THEN concat('Box<', p_type, '>') WHEN 7 THEN '' WHEN 8 THEN concat('sub_', lower(p_type), '_type') ELSE concat('m', lower(p_type)) END"


@query(f"WITH n AS (SELECT p_partkey, {NOISE} AS name FROM part) SELECT p_partkey, name = '' OR regexp_matches(name, '[<>*, ]') OR starts_with(name, 'JA_') OR regexp_matches(name, '(_t|_type)$') OR (upper(name) = name AND regexp_matches(name, '[A-Z]')) OR name = 'vector' AS noise FROM n")
def external_noise(spark, d):
    return read(spark, d, "part").select("p_partkey", F.expr(NOISE).alias("name")).select("p_partkey", X.is_noise_external(F.col("name")).alias("noise"))


@query(
    """WITH e AS (SELECT concat('T', p_partkey // 10) AS name, concat('NS::', replace(p_brand, '#', ''), '::T', p_partkey // 10) AS q, concat('f', p_partkey % 7) AS file FROM part),
  u AS (SELECT name, file, min(q) AS q FROM e GROUP BY name, file HAVING count(DISTINCT q) = 1)
SELECT l_orderkey, l_linenumber, count(*) AS n, min(u.q) AS target_qname FROM lineitem LEFT JOIN u ON u.name = concat('T', l_partkey // 10) AND u.file = concat('f', l_suppkey % 7) GROUP BY l_orderkey, l_linenumber, l_partkey // 10, l_suppkey % 7"""
)
def same_file_resolve(spark, d):
    """Names that are unique in the file that uses them."""
    tens = lambda c: F.concat(F.lit("T"), F.floor(F.col(c) / 10).cast("string"))
    ents = read(spark, d, "part").select(F.lit("class").alias("kind"), tens("p_partkey").alias("name"), F.concat(F.lit("NS::"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("::"), tens("p_partkey")).alias("qualified_name"), F.concat(F.lit("f"), (F.col("p_partkey") % 7).cast("string")).alias("file_path"))
    rels = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tens("l_partkey").alias("target_name"), F.lit(None).cast("string").alias("target_qname"), F.concat(F.lit("f"), (F.col("l_suppkey") % 7).cast("string")).alias("evidence_file"))
    found = R.resolve_names(rels, ents, {"evidence_file": "file_path"})
    return found.groupBy("l_orderkey", "l_linenumber", "target_name", "evidence_file").agg(F.count(F.lit(1)).alias("n"), F.min("target_qname").alias("target_qname")).drop("target_name", "evidence_file")


@query(
    f"""WITH {A.ENT}, q(query, low, tier) AS (VALUES ('C12.HXX', 'c12.hxx', 1), ('y/c12.hxx', 'y/c12.hxx', 2), ('Y/c19', 'y/c19', 3), ('nothing', 'nothing', 0))
SELECT query, tier, file_path FROM q JOIN ent ON CASE tier WHEN 1 THEN lower(file_path).split('/')[-1] = low WHEN 2 THEN ends_with(lower(file_path), low) AND lower(file_path).split('/')[-1] <> low WHEN 3 THEN contains(lower(file_path), low) AND NOT EXISTS (SELECT 1 FROM ent e WHERE ends_with(lower(e.file_path), low)) END"""
)
def file_resolver(spark, d):
    """Files by base name, by the end of the path, by a part of it."""
    files = A.entities(spark, d).select("file_path").distinct()
    out = None
    for q in ("C12.HXX", "y/c12.hxx", "Y/c19", "nothing"):
        found = R.resolve_file(files, q).select(F.lit(q).alias("query"), "tier", "file_path")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    f"""WITH {A.ENT}, one AS (SELECT lower(qualified_name) AS q FROM ent WHERE name = 'C12') SELECT 'whole' AS query, 1 AS tier, qualified_name FROM ent WHERE lower(qualified_name) IN (FROM one)
UNION ALL SELECT 'tail', 2, qualified_name FROM ent WHERE EXISTS (SELECT 1 FROM one WHERE ends_with(lower(qualified_name), q[4:])) UNION ALL SELECT 'part', 3, qualified_name FROM ent WHERE contains(replace(lower(qualified_name), '::', '_'), 'nd1_c1')"""
)
def class_resolver_tiers(spark, d):
    """A whole name in other case, its last segments parted by an underscore, a part of names."""
    ents = A.entities(spark, d)
    whole = ents.filter("name = 'C12'").first()["qualified_name"].lower()
    out = None
    for label, q in (("whole", whole), ("tail", "_".join(whole.split("::")[1:])), ("part", "nd1::c1")):
        found = R.resolve_tiered(ents, q).select(F.lit(label).alias("query"), "tier", "qualified_name")
        out = found if out is None else out.unionByName(found)
    return out


def _indexed(spark, names_, col):
    path = Scratch(spark, "names").path(col)
    names.store_index(names.name_index(names_, col), path)
    return names.open_index(spark, path)


@query(ORACLES["class_resolver_tiers"])
def class_resolver_index(spark, d):
    """The same look-ups from stored postings."""
    ents = A.entities(spark, d)
    whole = ents.filter("name = 'C12'").first()["qualified_name"].lower()
    index = _indexed(spark, ents, "qualified_name")
    asked = (("whole", whole), ("tail", "_".join(whole.split("::")[1:])), ("part", "nd1::c1"))
    return reduce(DataFrame.unionByName, [names.resolve_class(index, q).select(F.lit(label).alias("query"), "tier", "qualified_name") for label, q in asked])


@query(ORACLES["file_resolver"])
def file_resolver_index(spark, d):
    index = _indexed(spark, A.entities(spark, d), "file_path")
    return reduce(DataFrame.unionByName, [names.resolve_path(index, q).select(F.lit(q).alias("query"), "tier", "file_path") for q in ("C12.HXX", "y/c12.hxx", "Y/c19", "nothing")])


# -- modules, rules and cuts --------------------------------------------------------
@query("SELECT CASE WHEN p_partkey % 10 = 0 THEN '(root)' ELSE replace(p_brand, '#', '') END AS module, count(*) AS n FROM part GROUP BY 1")
def namespace_modules(spark, d):
    q = F.when(F.col("id") % 10 == 0, F.col("name")).otherwise(F.col("qualified_name"))
    return modules.by_namespace(A.entities(spark, d).withColumn("qualified_name", q)).groupBy("module").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'folder' AS strategy, count(DISTINCT lower(p_type)) AS modules, count(*) AS classes FROM part UNION ALL SELECT 'namespace', count(DISTINCT p_brand), count(*) FROM part UNION ALL SELECT 'explicit', 1, count(*) FROM part")
def module_strategies(spark, d):
    """The strategy that `auto` takes: folders, namespaces where there is one folder, groups where they are given."""
    ents = A.entities(spark, d)
    none = ents.select(F.col("qualified_name").alias("src"), F.col("qualified_name").alias("dst")).limit(0)
    out = None
    for classes, groups in ((ents, None), (ents.withColumn("file_path", F.lit("src/a.hxx")), None), (ents, [("all", ["C*"])])):
        found, used = modules.assign(classes, none, "auto", groups)
        row = found.agg(F.lit(used).alias("strategy"), F.countDistinct("module").alias("modules"), F.count(F.lit(1)).alias("classes"))
        out = row if out is None else out.unionByName(row)
    return out


CYCLIC = "cyclic AS (SELECT DISTINCT a.src AS id FROM reach a WHERE a.src = a.dst)"


@query(
    f"""WITH RECURSIVE {MODGRAPH}, {MODEDGE}, {MODDEG}, {REACH.format(e="modedge")}, {CYCLIC}, names2 AS (SELECT m.module, e.name FROM module m JOIN ent e USING (id))
SELECT id, in_n AS in_degree, out_n AS out_degree, (SELECT count(*) FROM module WHERE module = deg.id) AS size, (SELECT array_to_string(list_sort(list(name))[:20], ',') FROM names2 WHERE module = deg.id) AS members,
  id IN (FROM cyclic) AS in_cycle, in_n >= greatest(3, ceil(0.6 * ((SELECT count(*) FROM names) - 1))) AS is_god FROM deg"""
)
def audit_nodes(spark, d):
    mg = _module_graph(spark, d, kept=True)
    found = Scratch(spark, "audit").write(rules.audit(mg))
    member = A.entities(spark, d).select("id", "name").join(A.modules(spark, d), "id")
    return rules.audit_nodes(mg, found, member).withColumn("members", F.array_join("members", ","))


@query(f"WITH RECURSIVE {MODGRAPH}, {MODEDGE}, {REACH.format(e='modedge')}, {CYCLIC} SELECT src, dst, count(*) AS weight, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, src IN (FROM cyclic) AND dst IN (FROM cyclic) AS in_cycle, least(8, count(DISTINCT {EVIDENCE})) AS shown FROM modref GROUP BY src, dst")
def audit_edges(spark, d):
    mg = _module_graph(spark, d, kept=True)
    found = Scratch(spark, "audit").write(rules.audit(mg))
    return rules.audit_edges(mg, found).select("src", "dst", "weight", F.array_join("kinds", ",").alias("kinds"), "in_cycle", F.size("evidence").cast("long").alias("shown"))


@query(
    f"""WITH RECURSIVE {MODGRAPH}, {MODEDGE}, {MODDEG}, {REACH.format(e="modedge")}, comp AS (SELECT id, least(id, coalesce((SELECT min(a.dst) FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src = names.id), id)) AS component FROM names)
SELECT 'U1' AS rule_id, 'high' AS severity, concat('Module cycle: ', string_agg(id, ', ' ORDER BY id)) AS title, concat(count(*), ' modules depend on one another') AS detail FROM comp GROUP BY component HAVING count(*) > 1
UNION ALL SELECT 'U2', 'high', concat('God module: ', id), concat(in_n, ' of ', (SELECT count(*) FROM names) - 1, ' other modules depend on it') FROM deg WHERE in_n >= greatest(3, ceil(0.6 * ((SELECT count(*) FROM names) - 1))) AND (SELECT count(*) FROM names) >= 4
UNION ALL SELECT 'U3', 'medium', concat('Stable module ', e.src, ' depends on unstable ', e.dst), printf('instability %.2f and %.2f', a.instability, b.instability) FROM modedge e JOIN deg a ON a.id = e.src JOIN deg b ON b.id = e.dst WHERE a.in_n >= 2 AND b.instability - a.instability >= 0.3"""
)
def universal_contract(spark, d):
    """All findings of the rules that hold for every project."""
    return rules.audit(_module_graph(spark, d, kept=True)).select("rule_id", "severity", "title", "detail")


@query(f"WITH {MODGRAPH}, {MODEDGE} SELECT 'W1' AS rule_id, 'low' AS severity, concat(src, ' leans on ', dst) AS title FROM modedge WHERE weight >= 30")
def rule_added_kind(spark, d):
    """A rule kind of one's own, in a contract with one that nobody knows."""
    def leaning(rule, mg):
        found = mg.edges.filter(F.col("weight") >= rule.params["least"])
        none = F.array().cast("array<string>")
        return found.select(F.lit(rule.id).alias("rule_id"), F.lit(rule.kind).alias("kind"), F.lit("low").alias("severity"), F.concat("src", F.lit(" leans on "), "dst").alias("title"), F.lit("").alias("detail"), F.array("src", "dst").alias("modules"), none.alias("evidence"), none.alias("subject"))

    rules.register("leaning", leaning)
    try:
        return rules.audit(_module_graph(spark, d), (rules.Rule("W1", "leaning", {"least": 30}), rules.Rule("W2", "unheard_of"))).select("rule_id", "severity", "title")
    finally:
        del rules.CHECKERS["leaning"]


#: A small cyclic module graph for each supplier: even ones a ring of three, odd ones two pairs that share a module.
SMALL = """s AS (SELECT s_suppkey AS k, s_suppkey % 5 + 1 AS w1, s_suppkey % 7 + 1 AS w2, s_suppkey % 3 + 1 AS w3, concat('g', s_suppkey, 'a') AS a, concat('g', s_suppkey, 'b') AS b, concat('g', s_suppkey, 'c') AS c FROM supplier),
  ring AS (SELECT k, a AS src, b AS dst, w1 AS w FROM s WHERE k % 2 = 0 UNION ALL SELECT k, b, c, w2 FROM s WHERE k % 2 = 0 UNION ALL SELECT k, c, a, w3 FROM s WHERE k % 2 = 0),
  pairs AS (SELECT k, 1 AS pair, a AS src, b AS dst, w1 AS w, 1.0 AS price FROM s WHERE k % 2 = 1 UNION ALL SELECT k, 1, b, a, w2, 1.0 FROM s WHERE k % 2 = 1 UNION ALL SELECT k, 2, b, c, w3, 3.0 FROM s WHERE k % 2 = 1 UNION ALL SELECT k, 2, c, b, w1 + 1, 3.0 FROM s WHERE k % 2 = 1),
  cut AS (SELECT k, arg_min(struct_pack(src := src, dst := dst, w := w), struct_pack(w := w, src := src, dst := dst)) AS e, 1.0 AS price FROM ring GROUP BY k
    UNION ALL SELECT k, arg_min(struct_pack(src := src, dst := dst, w := w), struct_pack(w := w, src := src, dst := dst)), price FROM pairs GROUP BY k, pair, price)"""


def _small(spark, d) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    node = lambda x: F.concat(F.lit("g"), k.cast("string"), F.lit(x))
    edge = lambda a, b, w, kind: F.struct(node(a).alias("src"), node(b).alias("dst"), w.cast("long").alias("weight"), F.lit(kind).alias("kind"))
    w1, w2, w3 = k % 5 + 1, k % 7 + 1, k % 3 + 1
    ring = F.array(edge("a", "b", w1, "depends"), edge("b", "c", w2, "depends"), edge("c", "a", w3, "depends"))
    pairs = F.array(edge("a", "b", w1, "depends"), edge("b", "a", w2, "depends"), edge("b", "c", w3, "inherits"), edge("c", "b", w1 + 1, "inherits"))
    s = read(spark, d, "supplier")
    edges = s.select(F.explode(F.when(k % 2 == 0, ring).otherwise(pairs)).alias("e")).select("e.*")
    full = edges.select("src", "dst", "weight", F.array("kind").alias("kinds"), F.create_map("kind", "weight").alias("kind_counts"), F.array(F.lit("here")).alias("evidence"))
    return s.select(F.explode(F.array(node("a"), node("b"), node("c"))).alias("id")), full


@query(f"WITH {SMALL} SELECT concat('g', k, 'a') AS component, e.src, e.dst, CAST(e.w AS BIGINT) AS weight, CAST(e.w * price AS DOUBLE) AS cost, CASE WHEN price = 3 THEN 'extract shared base' ELSE 'dependency inversion' END AS prescription FROM cut")
def decouple_small_cuts(spark, d):
    """Exact cuts of many small cyclic components."""
    return decouple.cuts(*_small(spark, d)).select("component", "src", "dst", "weight", "cost", "prescription")


@query(f"WITH {SMALL} SELECT concat('g', k, 'a') AS component, concat('g', k, 'a,g', k, 'b,g', k, 'c') AS members, CAST(sum(e.w) AS BIGINT) AS effort, count(*) AS cuts FROM cut GROUP BY k")
def decouple_plans(spark, d):
    return decouple.plans(*_small(spark, d)).select("component", F.array_join("members", ",").alias("members"), "effort", F.size("cuts").cast("long").alias("cuts"))


@query(
    f"""WITH {SMALL}, left_ AS (SELECT r.k, r.src, r.dst FROM ring r JOIN cut c ON c.k = r.k WHERE NOT (c.e.src = r.src AND c.e.dst = r.dst))
SELECT concat('g', c.k, 'a') AS component, concat(c.e.src, ' ', l.src, ' ', c.e.dst) AS dependencies_first FROM cut c JOIN left_ l ON l.k = c.k AND l.dst = c.e.src"""
)
def decouple_order(spark, d):
    """The members of the rings in an order in which dependencies come first."""
    nodes, edges = _small(spark, d)
    ring = F.regexp_extract("id", r"\d+", 0).cast("long") % 2 == 0
    inner = edges.filter(F.regexp_extract("src", r"\d+", 0).cast("long") % 2 == 0)
    return decouple.plans(nodes.filter(ring), inner).select("component", F.array_join("order", " ").alias("dependencies_first"))


# -- graph ---------------------------------------------------------------------------
@query(f"WITH {A.GRAPH} SELECT src, dst, string_agg(concat(kind, ':', evidence_line), ' ' ORDER BY kind, evidence_line) AS evidence FROM internal GROUP BY src, dst")
def pair_evidence(spark, d):
    """All evidence of each pair, in order."""
    e = graph.pair_edges(graph.internal_edges(A.relationships(spark, d), A.entities(spark, d)))
    return e.select("src", "dst", F.array_join(F.transform("evidence", lambda x: F.concat(x["kind"], F.lit(":"), x["evidence_line"].cast("string"))), " ").alias("evidence"))


@query(
    f"""WITH RECURSIVE {A.GRAPH}, {REACH.format(e="edge")}, {COMP}, {CEDGE}, creach AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM reach r JOIN comp a ON a.id = r.src JOIN comp b ON b.id = r.dst WHERE a.component <> b.component),
  r AS (SELECT c.id, count(dst) AS reach FROM (SELECT DISTINCT component AS id FROM comp WHERE component NOT IN (SELECT dst FROM cedge)) c LEFT JOIN creach ON src = c.id GROUP BY c.id)
SELECT id, reach, row_number() OVER (ORDER BY reach DESC, id) AS place FROM r"""
)
def roots_by_reach(spark, d):
    e = _edges(spark, d)
    comp = Scratch(spark, "roots").write(graph.components(A.entities(spark, d), e))
    return graph.roots_by_reach(comp.select(F.col("component").alias("id")).distinct(), graph.condensed_edges(comp, e))


@query(f"WITH RECURSIVE {A.GRAPH}, {DEGREE}, {REACH.format(e='edge')}, {REACHED} SELECT id, round(out_w + 0.5 * reach - 0.8 * in_w, 6) AS score FROM deg JOIN cnt USING (id) ORDER BY round(out_w + 0.5 * reach - 0.8 * in_w, 6) DESC, id LIMIT 1")
def orchestrator(spark, d):
    """The class of the highest score."""
    s = graph.oop_scores(A.entities(spark, d), _edges(spark, d, kept=True)).select("id", F.round("score", 6).alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(1)


@query(
    f"""WITH RECURSIVE {A.GRAPH}, {REACH.format(e="edge")} SELECT 'classes' AS graph, EXISTS (SELECT 1 FROM reach WHERE src = dst) AS cyclic UNION ALL SELECT 'is-a', false UNION ALL SELECT 'loop', true"""
)
def cyclic_graphs(spark, d):
    """Whether there is a cycle: among all classes, among each class's first base, with an edge to itself."""
    ents, e = A.entities(spark, d), _edges(spark, d)
    up = e.filter("src > dst AND array_contains(kinds, 'inherits')")
    loop = up.limit(0).unionByName(e.limit(1).withColumn("dst", F.col("src")))
    found = [(n, graph.has_cycle(ents, x)) for n, x in (("classes", e), ("is-a", up), ("loop", loop))]
    return spark.createDataFrame(found, "graph string, cyclic boolean")


@query(
    f"""WITH RECURSIVE {A.GRAPH}, roots(root) AS (VALUES {", ".join(f"(CAST({r} AS BIGINT))" for r in DOM_ROOTS)}),
  hit(root, id) AS (SELECT root, root FROM roots UNION SELECT h.root, e.dst FROM hit h JOIN edge e ON e.src = h.id),
  cutoff(root, x, id) AS (SELECT root, id, root FROM hit WHERE id <> root UNION SELECT c.root, c.x, e.dst FROM cutoff c JOIN edge e ON e.src = c.id WHERE e.dst <> c.x),
  dom AS (SELECT h.root, h.id, x.id AS dominator FROM hit h JOIN hit x ON h.root = x.root AND h.id <> x.id AND h.id <> h.root WHERE x.id = h.root OR NOT EXISTS (SELECT 1 FROM cutoff c WHERE c.root = h.root AND c.x = x.id AND c.id = h.id)),
  depth AS (SELECT root, id, count(*) AS k FROM dom GROUP BY root, id), weight AS (SELECT root, dominator AS id, count(*) + 1 AS w FROM dom GROUP BY root, dominator),
  tree AS (SELECT d.root, d.id, arg_max(d.dominator, coalesce(p.k, 0)) AS parent FROM dom d LEFT JOIN depth p ON p.root = d.root AND p.id = d.dominator GROUP BY d.root, d.id)
SELECT t.root, t.id, t.parent, k AS depth, coalesce(w, 1) AS weight, row_number() OVER (PARTITION BY t.root, t.parent ORDER BY coalesce(w, 1) DESC, t.id) AS place, k = 3 AND coalesce(w, 1) > 1 AS truncated
FROM tree t JOIN depth d ON d.root = t.root AND d.id = t.id LEFT JOIN weight w ON w.root = t.root AND w.id = t.id WHERE k <= 3"""
)
def responsibility_tree(spark, d):
    """The dominator trees of two roots to the third level, brothers by what hangs below them."""
    ids = spark.range(1).select(F.explode(F.array(*[F.lit(r).cast("long") for r in DOM_ROOTS])).alias("id"))
    tree = graph.responsibility_tree(Scratch(spark, "tree").write(graph.immediate_dominators(_edges(spark, d), ids)))
    return tree.select("root", "id", "parent", "depth", "weight", F.col("place").cast("long").alias("place"), "truncated")


# -- prompts and reviews -----------------------------------------------------------
@query(
    f"""WITH {FULL}, {A.MODULE}, w AS (SELECT m.module AS subtree_root, s.*, row_number() OVER (PARTITION BY m.module ORDER BY source, line, s.kind, target) AS r FROM said s JOIN ent a ON a.qualified_name = s.source JOIN module m ON m.id = a.id JOIN ent b ON b.qualified_name = s.target_q JOIN module n ON n.id = b.id AND n.module = m.module),
  f AS (SELECT subtree_root, concat('  - ', source, '  --', kind, '-->  ', target) AS t, min(r) AS r FROM w WHERE r <= 80 GROUP BY ALL) SELECT subtree_root, string_agg(t, chr(10) ORDER BY r) AS relations FROM f GROUP BY subtree_root"""
)
def prompt_relations(spark, d):
    """The relations inside each namespace that a prompt shows: the first 80, repeated lines left out."""
    inside = A.entities(spark, d).select(F.col("qualified_name").alias("id"), "id").toDF("id", "n").join(A.modules(spark, d).withColumnRenamed("id", "n"), "n").select(F.col("module").alias("subtree_root"), "id")
    # Keys decide what is inside, so only that is given names.
    return design.relation_lines(project(spark, d, A.within_modules(spark, d))[1], inside).withColumnRenamed("RELATIONS", "relations")


@query("SELECT concat('n', n_nationkey) AS module, n_name AS prompt FROM nation WHERE NOT (n_nationkey % 3 = 0 AND n_nationkey % 4 <> 0 AND n_nationkey % 5 <> 1)")
def reviews_pending(spark, d):
    """Prompts without a parsed review of the current graph."""
    n = read(spark, d, "nation")
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    key = F.col("n_nationkey")
    done = n.filter(key % 3 == 0).select(name.alias("module_name"), F.when(key % 4 != 0, "{}").alias("parsed_json"), F.when(key % 5 == 1, "old").when(key % 5 == 2, "now").alias("graph_hash"))
    return review.pending(n.select(name.alias("module"), F.col("n_name").alias("prompt")), done, "now", "module")


@query("SELECT n_nationkey AS id, row_number() OVER (ORDER BY CASE WHEN n_nationkey % 7 = 0 THEN 0 WHEN n_nationkey % 3 = 0 THEN 1 ELSE 2 END, n_regionkey DESC, n_nationkey) AS place FROM nation")
def synthesis_order(spark, d):
    """God modules, then those in cycles, then the rest, by in-degree."""
    from pyspark.sql import Window

    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 7 == 0).alias("is_god"), (F.col("n_nationkey") % 3 == 0).alias("in_cycle"), F.col("n_regionkey").alias("in_degree"))
    return n.select("id", F.row_number().over(Window.orderBy(*review.synthesis_rank(n))).cast("long").alias("place"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 4) THEN doc_id END AS found FROM documents")
def json_rescue(spark, d):
    """The object in a reply: fenced, between words, none, broken, bare."""
    key = F.col("doc_id").cast("string")
    body = F.concat(F.lit('{"a": '), key, F.lit("}"))
    form = F.col("doc_id") % 5
    reply = F.when(form == 0, F.concat(F.lit("so ```json\n"), body, F.lit("\n``` there"))).when(form == 1, F.concat(F.lit("I say "), body, F.lit(" to that"))).when(form == 2, "none").when(form == 3, F.concat(F.lit('{"a": '), key)).otherwise(body)
    return read(spark, d, "documents").select("doc_id", F.from_json(X.rescued_json(reply), "a BIGINT")["a"].alias("found"))


@query("SELECT n_nationkey, concat(n_name, ' of ', r_name, ': ', n_name, ' {C}') AS text FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, concat(n_name, ' of : ', n_name, ' {C}') FROM nation WHERE n_nationkey % 2 = 1")
def prompt_template(spark, d):
    """Tokens replaced, a null by nothing; tokens without a value stay."""
    both = read(spark, d, "nation").join(read(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return both.select("n_nationkey", X.template(F.lit("{A} of {B}: {A} {C}"), {"A": F.col("n_name"), "B": F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name"))}).alias("text"))


# -- keyed tables and logs -----------------------------------------------------------
@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def first_of_each(spark, d):
    """A cap for each key, ranked in salted parts."""
    return R.top_k(read(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 3)


@query("SELECT count(*) AS rows, count(*) AS ids, count(*) FILTER (event_id % 2 = 1) AS above FROM events")
def log_append(spark, d):
    """New rows are numbered on: all ids differ, and those of new rows are above the old."""
    e = read(spark, d, "events")
    old, new = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("id"), "event_type", F.lit(False).alias("fresh")), e.filter("event_id % 2 = 1").select("event_type", F.lit(True).alias("fresh"))
    top = old.agg(F.max("id")).first()[0]
    out = R.append_log(old, new)
    return out.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), F.count_if(F.col("fresh") & (F.col("id") > top)).alias("above"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'O' OR o_totalprice < 100000 OR o_orderstatus IS NULL")
def filtered_delete(spark, d):
    return R.without(read(spark, d, "orders"), (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") >= 100000)).select("o_orderkey", "o_orderstatus")


@query("SELECT user_id AS prompt_hash, event_type AS model, CASE WHEN max(event_id) FILTER (event_id % 3 = 0) IS NULL THEN 'first' ELSE 'second' END AS response FROM events GROUP BY user_id, event_type")
def answer_cache(spark, d):
    """Answers put into a stored cache twice; the second answer to a prompt replaces the first."""
    store = Store(spark, Scratch(spark, "cache").path("store"))
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("prompt_hash"), F.col("event_type").alias("model"), "event_id")
    store.put("llm_cache", e.dropDuplicates(["prompt_hash", "model"]).select("prompt_hash", "model", F.lit("first").alias("response")))
    store.put("llm_cache", e.filter("event_id % 3 = 0").dropDuplicates(["prompt_hash", "model"]).select("prompt_hash", "model", F.lit("second").alias("response")))
    return store.table("llm_cache").select(F.col("prompt_hash").cast("long").alias("prompt_hash"), "model", "response")


# -- plain SQL -----------------------------------------------------------------------
def _sql(text: str):
    """A query of the guarded SQL that runs as it is in both engines."""
    tables = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if f" {t}" in text]
    return lambda spark, d: run_select(spark, text, {t: read(spark, d, t) for t in tables})


for _name, _text in {
    "sql_joins": "SELECT n.n_name, r.r_name, count(c.c_custkey) AS customers, count(s.s_suppkey) AS suppliers FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey FULL JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_suppkey = c.c_custkey GROUP BY n.n_name, r.r_name",
    "sql_self_join": "SELECT a.o_custkey, count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey GROUP BY a.o_custkey",
    "sql_semi_anti": "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "sql_unions": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation",
    "sql_functions": "SELECT c_custkey, upper(c_mktsegment) AS u, length(c_name) AS l, substr(c_name, 10, 5) AS s, round(abs(c_acctbal), 2) AS b, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS m, CASE WHEN c_acctbal < 0 THEN 'low' ELSE 'ok' END AS state, concat(trim(c_name), '/', lower(c_mktsegment)) AS both FROM customer",
    "sql_grouping": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(min(o_totalprice), 2) AS least, round(max(o_totalprice), 2) AS most FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ()) HAVING count(*) > 1",
}.items():
    _run = _sql(_text)
    _run.__name__ = _name
    query(_text)(_run)
