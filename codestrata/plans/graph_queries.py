"""Queries on the adapter's code graph, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata.functions import kinds as K
from codestrata.functions import text as X
from codestrata.operators import communities, decouple, dominators, graph, modules, rules
from codestrata.plans import adapter as A
from codestrata.plans.registry import query
from codestrata.session import Scratch, merged_joins
from codestrata.tools import report

REACH = "reach(src, dst) AS (SELECT src, dst FROM {e} UNION SELECT r.src, e.dst FROM reach r JOIN {e} e ON r.dst = e.src)"
DEGREE = """deg AS (SELECT id, coalesce(o.w, 0.0) AS out_w, coalesce(i.w, 0.0) AS in_w, coalesce(o.n, 0) AS out_n, coalesce(i.n, 0) AS in_n FROM ent
  LEFT JOIN (SELECT src, sum(weight) AS w, count(*) AS n FROM edge GROUP BY src) o ON o.src = ent.id
  LEFT JOIN (SELECT dst, sum(weight) AS w, count(*) AS n FROM edge GROUP BY dst) i ON i.dst = ent.id)"""
MODEDGE = "modedge AS (SELECT src, dst, count(*) AS weight FROM modref GROUP BY src, dst)"
MODDEG = """names AS (SELECT DISTINCT module AS id FROM module), deg AS (SELECT id, coalesce(o.n, 0) AS out_n, coalesce(i.n, 0) AS in_n,
  CASE WHEN coalesce(o.n, 0) + coalesce(i.n, 0) = 0 THEN 0.0 ELSE coalesce(o.n, 0) * 1.0 / (coalesce(o.n, 0) + coalesce(i.n, 0)) END AS instability FROM names
  LEFT JOIN (SELECT src, count(*) AS n FROM modedge GROUP BY src) o ON o.src = names.id LEFT JOIN (SELECT dst, count(*) AS n FROM modedge GROUP BY dst) i ON i.dst = names.id)"""
MODGRAPH = f"{A.GRAPH}, {A.MODULE}, {A.MODREF}"


def _edges(spark, d, kept: bool = False):
    """The collapsed edges; `kept`: written once, for queries that use them several times."""
    found = graph.build_graph(A.entities(spark, d), A.relationships(spark, d))
    return Scratch(spark, "edges").write(found) if kept else found


def _internal(spark, d):
    return graph.internal_edges(A.relationships(spark, d), A.entities(spark, d))


def _references(spark, d):
    """References between modules. Every entity has a module, so what meets the modules at both ends is internal."""
    return modules.module_references(A.relationships(spark, d).filter("src <> dst"), A.modules(spark, d))


def _module_graph(spark, d, kept: bool = False) -> rules.ModuleGraph:
    """All references between modules. Where the edges are used several times they are `kept`: written once, not worked out again from all references."""
    refs = _references(spark, d)
    place = F.concat(F.col("from_class").cast("string"), F.lit(" --"), "kind", F.lit("--> "), F.col("to_class").cast("string"), F.lit(":"), F.lpad(F.col("evidence_line").cast("string"), 4, "0"))
    nodes, edges = A.modules(spark, d).select(F.col("module").alias("id")).distinct(), modules.module_edges(refs, place)
    if kept:
        scratch = Scratch(spark, "module-graph")
        nodes, edges = scratch.write(nodes), scratch.write(edges)
    return rules.ModuleGraph(nodes, edges)


EVIDENCE = "concat(CAST(s AS VARCHAR), ' --', kind, '--> ', CAST(d AS VARCHAR), ':', lpad(CAST(evidence_line AS VARCHAR), 4, '0'))"


@query(f"WITH {A.GRAPH} SELECT src, dst, weight, max_level, n, array_to_string(kinds, ',') AS kinds FROM edge")
def edge_collapse(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).withColumn("kinds", F.array_join("kinds", ","))


@query(f"WITH {A.GRAPH} SELECT src, dst, arg_max(kind, {A.PRIMARY.format(k='kind')}) AS primary_kind, max({A.LEVEL.format(k='kind')}) AS level, bool_or(kind IN ('inherits', 'implements', 'composes', 'aggregates')) AS structural, count(*) AS evidence_count, min(evidence_line) AS first_line FROM internal GROUP BY src, dst")
def edge_kinds_primary(spark, d):
    return graph.pair_edges(_internal(spark, d)).select("src", "dst", "primary_kind", "level", "structural", F.size("evidence").cast("long").alias("evidence_count"), F.array_min(F.transform("evidence", lambda e: e["evidence_line"])).alias("first_line"))


@query(f"WITH {A.GRAPH}, {DEGREE} SELECT id, round(out_w, 6) AS out_w, round(in_w, 6) AS in_w, out_n, in_n, in_n >= 2 AND out_n = 0 AS utility FROM deg")
def class_degree_utility(spark, d):
    return graph.degrees(A.entities(spark, d), _edges(spark, d)).select("id", F.round("out_w", 6).alias("out_w"), F.round("in_w", 6).alias("in_w"), "out_n", "in_n", graph.is_utility().alias("utility"))


@query(f"WITH {MODGRAPH} SELECT src, dst, count(*) AS weight, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM modref GROUP BY src, dst")
def module_matrix_namespace(spark, d):
    return modules.module_edges(_references(spark, d)).select("src", "dst", "weight", F.array_join("kinds", ",").alias("kinds"))


@query(
    f"WITH {A.GRAPH}, folder AS (SELECT id, split_part(file_path, '/', 2) AS module FROM ent) SELECT a.module AS src, b.module AS dst, count(*) AS weight FROM internal r JOIN folder a ON a.id = r.src JOIN folder b ON b.id = r.dst WHERE a.module <> b.module GROUP BY a.module, b.module"
)
def module_matrix_folder(spark, d):
    member = modules.by_folder(A.entities(spark, d)).select("id", "module")
    return modules.module_edges(modules.module_references(_internal(spark, d), member)).select("src", "dst", "weight")


@query(f"WITH {MODGRAPH} SELECT src, dst, kind, count(*) AS n FROM modref GROUP BY src, dst, kind")
def module_kind_counts(spark, d):
    return modules.module_edges(_references(spark, d)).select("src", "dst", F.explode("kind_counts").alias("kind", "n"))


@query(f"WITH {MODGRAPH} SELECT src, dst, string_agg(e, '|' ORDER BY e) AS evidence FROM (SELECT src, dst, {EVIDENCE} AS e, row_number() OVER (PARTITION BY src, dst ORDER BY {EVIDENCE}) AS r FROM (SELECT DISTINCT src, dst, s, d, kind, evidence_line FROM modref)) WHERE r <= 12 GROUP BY src, dst")
def module_evidence(spark, d):
    return _module_graph(spark, d).edges.select("src", "dst", F.array_join("evidence", "|").alias("evidence"))


@query(f"WITH {MODGRAPH}, {MODEDGE}, {MODDEG} SELECT id, out_n, in_n, round(instability, 9) AS instability FROM deg")
def module_instability(spark, d):
    return rules.degrees(_module_graph(spark, d)).withColumn("instability", F.round("instability", 9)).orderBy("id")


@query(f"WITH {MODGRAPH}, {MODEDGE}, {MODDEG} SELECT id AS subject, in_n FROM deg WHERE in_n >= greatest(3, ceil(0.6 * ((SELECT count(*) FROM names) - 1))) AND (SELECT count(*) FROM names) >= 4")
def rule_god_module(spark, d):
    mg = _module_graph(spark, d)
    found = rules.god_module(rules.Rule("G", "god_module", {"ratio": 0.6, "min_dependents": 3}), mg)
    return found.select(F.get("subject", F.lit(0)).alias("subject"), (F.size("modules") - 1).cast("long").alias("in_n"))


@query(f"WITH {MODGRAPH}, {MODEDGE}, {MODDEG} SELECT e.src, e.dst FROM modedge e JOIN deg a ON a.id = e.src JOIN deg b ON b.id = e.dst WHERE a.in_n >= 2 AND b.instability - a.instability >= 0.3")
def rule_inverted_core(spark, d):
    found = rules.inverted_core(rules.Rule("I", "inverted_core", {"margin": 0.3}), _module_graph(spark, d))
    return found.select(F.get("modules", F.lit(0)).alias("src"), F.get("modules", F.lit(1)).alias("dst"))


@query(f"WITH {MODGRAPH}, {MODEDGE} SELECT src, dst, concat(weight, ' references') AS detail FROM modedge WHERE src = 'Brand1' AND dst = 'Brand2' OR src = 'Brand11' AND dst = 'Brand22'")
def rule_forbid_dependency(spark, d):
    mg = _module_graph(spark, d)
    out = [rules.forbid_dependency(rules.Rule("F", "forbid_dependency", {"from": a, "to": b}), mg) for a, b in (("Brand1", "Brand2"), ("Brand11", "Brand22"))]
    return out[0].unionByName(out[1]).select(F.get("modules", F.lit(0)).alias("src"), F.get("modules", F.lit(1)).alias("dst"), "detail")


@query(f"WITH RECURSIVE {MODGRAPH}, {MODEDGE}, {REACH.format(e='modedge')} SELECT a.src, a.dst FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def module_cycle_pairs(spark, d):
    mg = _module_graph(spark, d)
    c = graph.components(mg.nodes, mg.edges)
    return c.select(F.col("id").alias("src"), "component").join(c.select(F.col("id").alias("dst"), "component"), "component").filter("src < dst").select("src", "dst")


@query(
    f"""WITH RECURSIVE {MODGRAPH}, {MODEDGE}, {REACH.format(e="modedge")}, names AS (SELECT DISTINCT module AS id FROM module),
  comp AS (SELECT id, least(id, coalesce((SELECT min(a.dst) FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src = names.id), id)) AS component FROM names)
SELECT 'no_module_cycle' AS kind, 'high' AS severity, string_agg(id, ',' ORDER BY id) AS modules FROM comp GROUP BY component HAVING count(*) > 1"""
)
def rule_module_cycle(spark, d):
    mg = _module_graph(spark, d)
    return rules.no_module_cycle(rules.Rule("C", "no_module_cycle"), mg).select("kind", "severity", F.array_join("modules", ",").alias("modules"))


@query(f"WITH RECURSIVE {A.GRAPH}, {REACH.format(e='edge')} SELECT id, count(r.dst) AS reach FROM ent LEFT JOIN reach r ON r.src = ent.id AND r.dst <> r.src GROUP BY id")
def reach_counts(spark, d):
    return graph.reach_counts(A.entities(spark, d), _edges(spark, d))


REACHED = "cnt AS (SELECT id, count(r.dst) AS reach FROM ent LEFT JOIN reach r ON r.src = ent.id AND r.dst <> r.src GROUP BY id)"


@query(f"WITH RECURSIVE {A.GRAPH}, {DEGREE}, {REACH.format(e='edge')}, {REACHED} SELECT id, reach, round(out_w + 0.5 * reach - 0.8 * in_w, 6) AS score FROM deg JOIN cnt USING (id)")
def orchestrator_scores(spark, d):
    return graph.oop_scores(A.entities(spark, d), _edges(spark, d)).select("id", "reach", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {A.GRAPH}, {DEGREE}, turned AS (SELECT dst AS src, src AS dst FROM edge), {REACH.format(e='turned')}, {REACHED} SELECT id, reach, round(in_w + 0.5 * reach - 0.8 * out_w, 6) AS score FROM deg JOIN cnt USING (id)")
def crtp_scores(spark, d):
    return graph.crtp_scores(A.entities(spark, d), _edges(spark, d)).select("id", "reach", F.round("score", 6).alias("score"))


COMP = "comp AS (SELECT ent.id, least(ent.id, coalesce(m.c, ent.id)) AS component FROM ent LEFT JOIN (SELECT a.src AS id, min(a.dst) AS c FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src) m ON m.id = ent.id)"
CEDGE = "cedge AS (SELECT a.component AS src, b.component AS dst, max(weight) AS weight, count(*) AS n FROM edge e JOIN comp a ON a.id = e.src JOIN comp b ON b.id = e.dst WHERE a.component <> b.component GROUP BY a.component, b.component)"


@query(f"WITH RECURSIVE {A.GRAPH}, {REACH.format(e='edge')}, {COMP} SELECT * FROM comp")
def scc_components(spark, d):
    return graph.components(A.entities(spark, d), _edges(spark, d))


@query(f"WITH RECURSIVE {A.GRAPH}, {REACH.format(e='edge')}, {COMP}, {CEDGE} SELECT * FROM cedge")
def condensed_edges(spark, d):
    e = _edges(spark, d)
    return graph.condensed_edges(graph.components(A.entities(spark, d), e), e)


@query(f"WITH RECURSIVE {A.GRAPH}, {REACH.format(e='edge')}, {COMP}, {CEDGE} SELECT DISTINCT component AS id FROM comp WHERE component NOT IN (SELECT dst FROM cedge)")
def condensed_roots(spark, d):
    e = _edges(spark, d, kept=True)
    c = graph.components(A.entities(spark, d), e)
    return graph.roots(c.select(F.col("component").alias("id")).distinct(), graph.condensed_edges(c, e))


@query(
    f"""WITH RECURSIVE {A.GRAPH}, {REACH.format(e="edge")}, {COMP}, lab AS (SELECT component, list(name ORDER BY name) AS m FROM comp JOIN ent USING (id) GROUP BY component),
  based AS (SELECT component, len(m) AS size, CASE WHEN len(m) = 1 THEN m[1] ELSE concat('cluster(', m[1], ', ', m[2], ')') END AS base FROM lab)
SELECT component, size, CASE WHEN k > 0 THEN concat(base, '#', k) ELSE base END AS label FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY component) - 1 AS k FROM based)"""
)
def condensed_labels(spark, d):
    e = A.entities(spark, d)
    return graph.labels(graph.components(e, _edges(spark, d)), e).select("component", F.size("members").cast("long").alias("size"), "label")


@query(
    f"WITH {A.GRAPH} SELECT (SELECT count(*) FROM ent) AS classes, (SELECT count(*) FROM ent WHERE kind = 'interface') AS abstractions, (SELECT count(*) FROM edge WHERE list_has_any(kinds, ['inherits', 'implements'])) AS is_a, (SELECT round(avg(CASE WHEN kind = 'interface' THEN 1.0 ELSE 0.0 END), 9) FROM ent) AS ratio, 'oop' AS style"
)
def style_detect(spark, d):
    return graph.style(A.entities(spark, d), _edges(spark, d)).withColumn("ratio", F.round("ratio", 9))


PARENT = "par AS (SELECT src AS id, min(struct_pack(l := evidence_line, p := dst)).p AS parent FROM internal WHERE kind IN ('inherits', 'implements') GROUP BY src)"


def _parents(spark, d):
    return graph.parents(_internal(spark, d), [F.col("evidence_line")])


@query(f"WITH {A.GRAPH}, {PARENT} SELECT parent, count(*) AS children FROM par GROUP BY parent HAVING count(*) >= 2")
def family_sizes(spark, d):
    return graph.families(_parents(spark, d))


FOLD = f"{PARENT}, rep AS (SELECT ent.id, CASE WHEN par.parent IS NOT NULL AND ent.id NOT IN (SELECT parent FROM par) AND par.parent IN (SELECT parent FROM par GROUP BY parent HAVING count(*) >= 2) THEN par.parent ELSE ent.id END AS rep FROM ent LEFT JOIN par ON par.id = ent.id)"


@query(f"WITH {A.GRAPH}, {FOLD} SELECT a.rep AS src, b.rep AS dst, max(weight) AS weight, max(max_level) AS max_level, CAST(sum(n) AS BIGINT) AS n FROM edge e JOIN rep a ON a.id = e.src JOIN rep b ON b.id = e.dst WHERE a.rep <> b.rep GROUP BY a.rep, b.rep")
def fold_leaves(spark, d):
    _, folded = graph.fold(_edges(spark, d), graph.representatives(A.entities(spark, d), _parents(spark, d), "leaves"))
    return folded.drop("kinds")


@query(
    f"WITH RECURSIVE {A.GRAPH}, {PARENT}, up(id, top) AS (SELECT id, parent FROM par UNION SELECT up.id, par.parent FROM up JOIN par ON par.id = up.top) SELECT ent.id, coalesce((SELECT max(top) FROM up WHERE up.id = ent.id AND up.top NOT IN (SELECT id FROM par)), ent.id) AS rep FROM ent"
)
def fold_topmost(spark, d):
    return graph.representatives(A.entities(spark, d), _parents(spark, d), "all")


DOM_ROOTS = (1999, 1500)


@query(
    f"""WITH RECURSIVE {A.GRAPH}, roots(root) AS (VALUES {", ".join(f"(CAST({r} AS BIGINT))" for r in DOM_ROOTS)}),
  hit(root, id) AS (SELECT root, root FROM roots UNION SELECT h.root, e.dst FROM hit h JOIN edge e ON e.src = h.id),
  cutoff(root, x, id) AS (SELECT root, id, root FROM hit WHERE id <> root UNION SELECT c.root, c.x, e.dst FROM cutoff c JOIN edge e ON e.src = c.id WHERE e.dst <> c.x),
  dom AS (SELECT h.root, h.id, x.id AS dominator FROM hit h JOIN hit x ON h.root = x.root AND h.id <> x.id AND h.id <> h.root WHERE x.id = h.root OR NOT EXISTS (SELECT 1 FROM cutoff c WHERE c.root = h.root AND c.x = x.id AND c.id = h.id)),
  depth AS (SELECT root, id, count(*) AS k FROM dom GROUP BY root, id)
SELECT d.root, d.id, arg_max(d.dominator, coalesce(p.k, 0)) AS parent FROM dom d LEFT JOIN depth p ON p.root = d.root AND p.id = d.dominator GROUP BY d.root, d.id"""
)
def dominator_parents(spark, d):
    ids = spark.range(1).select(F.explode(F.array(*[F.lit(r).cast("long") for r in DOM_ROOTS])).alias("id"))
    return graph.immediate_dominators(_edges(spark, d), ids)


CUT_OFF = """cutoff(root, x, id) AS (SELECT root, id, root FROM hit WHERE id <> root UNION SELECT c.root, c.x, e.dst FROM cutoff c JOIN cedge e ON e.src = c.id WHERE e.dst <> c.x),
  dom AS (SELECT h.root, h.id, x.id AS dominator FROM hit h JOIN hit x ON h.root = x.root AND h.id <> x.id AND h.id <> h.root WHERE x.id = h.root OR NOT EXISTS (SELECT 1 FROM cutoff c WHERE c.root = h.root AND c.x = x.id AND c.id = h.id)),
  deep AS (SELECT root, id, count(*) AS k FROM dom GROUP BY root, id),
  tree AS (SELECT d.root, d.id, arg_max(d.dominator, coalesce(p.k, 0)) AS parent, CAST(count(*) AS INTEGER) AS depth FROM dom d LEFT JOIN deep p ON p.root = d.root AND p.id = d.dominator GROUP BY d.root, d.id)"""
STARTS = "starts AS (SELECT DISTINCT component AS root FROM comp WHERE component NOT IN (SELECT dst FROM cedge)), hit(root, id) AS (SELECT root, root FROM starts UNION SELECT h.root, e.dst FROM hit h JOIN cedge e ON e.src = h.id)"


def _condensed(spark, d):
    e = _edges(spark, d, kept=True)
    scratch = Scratch(spark, "condensed")
    comp = scratch.write(graph.components(A.entities(spark, d), e))
    return comp, scratch.write(graph.condensed_edges(comp, e))


@query(f"WITH RECURSIVE {A.GRAPH}, {REACH.format(e='edge')}, {COMP}, {CEDGE}, {STARTS}, {CUT_OFF} SELECT root, id, parent, depth FROM tree")
def dominator_trees(spark, d):
    """The dominator tree of every root of the condensed graph."""
    comp, cond = _condensed(spark, d)
    starts = graph.roots(comp.select(F.col("component").alias("id")).distinct(), cond)
    return dominators.root_trees(cond, starts)


@query(
    f"""WITH RECURSIVE {A.GRAPH}, {REACH.format(e="edge")}, {COMP}, {CEDGE}, {STARTS}, {CUT_OFF}, own AS (SELECT id, min(root) AS root FROM hit GROUP BY id),
  direct AS (SELECT a.component AS parent, b.component AS id, max_by(kind, struct_pack(l := {A.LEVEL.format(k="kind")}, k := kind)) AS kind FROM internal r JOIN comp a ON a.id = r.src JOIN comp b ON b.id = r.dst GROUP BY a.component, b.component)
SELECT o.root, o.id, t.parent, coalesce(t.depth, 0) AS depth, CASE WHEN t.parent IS NOT NULL THEN coalesce(k.kind, 'dominates') END AS kind FROM own o LEFT JOIN tree t ON t.root = o.root AND t.id = o.id LEFT JOIN direct k ON k.parent = t.parent AND k.id = o.id"""
)
def arch_forest(spark, d):
    """The report's forest: each component below the first root that reaches it, with its depth and the kind of the direct relationship."""
    return report.forest(A.entities(spark, d), _edges(spark, d, kept=True))


@query(
    f"""WITH RECURSIVE {A.GRAPH}, {REACH.format(e="edge")}, {COMP}, {CEDGE}, top AS (SELECT DISTINCT component AS id FROM comp WHERE component NOT IN (SELECT dst FROM cedge)), inner_ AS (SELECT src AS id FROM cedge UNION SELECT dst FROM cedge),
  cutoff(x, id) AS (SELECT i.id, t.id FROM inner_ i JOIN top t ON t.id <> i.id UNION SELECT c.x, e.dst FROM cutoff c JOIN cedge e ON e.src = c.id WHERE e.dst <> c.x),
  dom AS (SELECT h.src AS x, h.dst AS id FROM reach h JOIN inner_ a ON a.id = h.src JOIN inner_ b ON b.id = h.dst WHERE h.src <> h.dst AND NOT EXISTS (SELECT 1 FROM cutoff c WHERE c.x = h.src AND c.id = h.dst)),
  deep AS (SELECT id, count(*) AS k FROM dom GROUP BY id)
SELECT i.id, m.parent, CAST(coalesce(d.k, 0) AS INTEGER) AS depth FROM inner_ i LEFT JOIN deep d ON d.id = i.id LEFT JOIN (SELECT dom.id, arg_max(x, coalesce(p.k, 0)) AS parent FROM dom LEFT JOIN deep p ON p.id = dom.x GROUP BY dom.id) m ON m.id = i.id"""
)
def dominators_of_all_roots(spark, d):
    """One tree of the condensed graph below a virtual root over all roots."""
    return dominators.dominator_tree(_condensed(spark, d)[1])


@query(
    f"""WITH RECURSIVE {A.GRAPH}, {REACH.format(e="edge")}, {COMP}, {CEDGE}, lev(id, level) AS (SELECT DISTINCT component, 0 FROM comp WHERE component NOT IN (SELECT dst FROM cedge) UNION SELECT e.dst, level + 1 FROM lev JOIN cedge e ON e.src = lev.id)
SELECT id, max(level) AS level FROM lev GROUP BY id"""
)
def topo_levels(spark, d):
    e = _edges(spark, d, kept=True)
    c = graph.components(A.entities(spark, d), e)
    return graph.topological_levels(c.select(F.col("component").alias("id")), graph.condensed_edges(c, e))


@query(
    f"""WITH {A.GRAPH} SELECT 'above' AS side, 'base' AS relation, dst AS id FROM edge WHERE src = 200 AND (list_contains(kinds, 'inherits') OR list_contains(kinds, 'implements'))
UNION ALL SELECT 'above', 'user', src FROM edge WHERE dst = 200 AND len(list_filter(kinds, lambda k: k NOT IN ('inherits', 'implements'))) > 0
UNION ALL SELECT 'below', 'subclass', src FROM edge WHERE dst = 200 AND (list_contains(kinds, 'inherits') OR list_contains(kinds, 'implements'))
UNION ALL SELECT 'below', 'used', dst FROM edge WHERE src = 200 AND len(list_filter(kinds, lambda k: k NOT IN ('inherits', 'implements'))) > 0"""
)
def ego_above_below(spark, d):
    return graph.ego(_edges(spark, d), 200)


@query(f"WITH {A.GRAPH} SELECT round(sum({A.COST.format(k='kind')}), 6) AS cost, src, dst FROM internal GROUP BY src, dst")
def edge_cut_cost(spark, d):
    return _internal(spark, d).groupBy("src", "dst").agg(F.round(F.sum(K.cut_cost_of(F.col("kind"))), 6).alias("cost"))


@query(f"WITH {MODGRAPH} SELECT src, dst, round(sum({A.COST.format(k='kind')}), 6) AS cost FROM modref GROUP BY src, dst")
def decouple_cut_cost(spark, d):
    return decouple.edge_costs(modules.module_edges(_references(spark, d))).select("src", "dst", F.round("cost", 6).alias("cost"))


@query(
    f"""WITH RECURSIVE {A.GRAPH}, {REACH.format(e='edge')}, {COMP}, price AS (SELECT src, dst, sum({A.COST.format(k='kind')}) AS cost FROM internal GROUP BY src, dst),
  many AS (SELECT component, count(*) AS classes FROM comp GROUP BY component HAVING count(*) > 1)
SELECT a.component, any_value(classes) AS classes, count(*) AS edges, round(sum(cost), 6) AS cost, 0 AS on_cycles, true AS at_most_half
FROM price JOIN comp a ON a.id = src JOIN comp b ON b.id = dst AND a.component = b.component JOIN many ON many.component = a.component GROUP BY a.component"""
)
def class_cuts(spark, d):
    """Cyclic components of classes, their edges and what these cost, and two checks of the cuts: how many classes are on a cycle without them, and whether they cost at most half of all edges."""
    with merged_joins(spark):
        return _class_cuts(spark, d)


def _class_cuts(spark, d):
    scratch = Scratch(spark, "class-cuts")
    nodes = scratch.write(A.entities(spark, d).select("id"))
    # Collapsed before they meet the entities.
    pairs = A.relationships(spark, d).filter("dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.sum(K.cut_cost_of(F.col("kind"))).alias("cost"))
    priced = scratch.write(pairs.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    comp = scratch.write(graph.components(nodes, priced))
    cut = scratch.write(decouple.chosen_cuts(comp, priced))
    left = graph.components(nodes, priced.join(cut.select("src", "dst"), ["src", "dst"], "left_anti"))
    still = left.join(left.groupBy(F.col("component")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component"), "component", "left_semi").select("id", F.lit(1).alias("cyclic"))
    per = comp.join(still, "id", "left").groupBy("component").agg(F.count(F.lit(1)).alias("classes"), F.count("cyclic").alias("on_cycles")).filter("classes > 1")
    a, b = comp.select(F.col("id").alias("src"), "component"), comp.select(F.col("id").alias("dst"), F.col("component").alias("other"))
    inside = priced.join(a, "src").join(b, "dst").filter("component = other").join(cut.select("src", "dst", F.lit(True).alias("gone")), ["src", "dst"], "left")
    sums = inside.groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.sum("cost").alias("cost"), F.coalesce(F.sum(F.when(F.col("gone"), F.col("cost"))), F.lit(0.0)).alias("spent"))
    return scratch.write(per.join(sums, "component").select("component", "classes", "edges", F.round("cost", 6).alias("cost"), "on_cycles", (2 * F.col("spent") <= F.col("cost")).alias("at_most_half")))


@query()
def decouple_cuts(spark, d):
    """NP-hard per component; tests/test_graph.py compares small ones with a search over all cuts, tests/test_ordering.py large ones with a greedy search."""
    mg = _module_graph(spark, d, kept=True)
    return decouple.cuts(mg.nodes, mg.edges).select("component", "src", "dst", "weight", "cost", "prescription")


@query(
    f"""WITH {MODGRAPH}, {MODEDGE}, {MODDEG}, f AS (SELECT 1 AS o, 'inverted_core' AS kind, 'medium' AS severity, concat('Stable module ', e.src, ' depends on unstable ', e.dst) AS title, 2 AS size
  FROM modedge e JOIN deg a ON a.id = e.src JOIN deg b ON b.id = e.dst WHERE a.in_n >= 2 AND b.instability - a.instability >= 0.3
  UNION ALL SELECT 0, 'god_module', 'high', concat('God module: ', id), in_n + 1 FROM deg WHERE in_n >= greatest(3, ceil(0.6 * ((SELECT count(*) FROM names) - 1))))
SELECT kind, severity, title, CAST(size AS BIGINT) AS size, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, -size, o, title) AS place FROM f"""
)
def findings_order(spark, d):
    """The audit's order; the place is given within its few findings."""
    found = rules.audit(_module_graph(spark, d), (rules.Rule("G", "god_module", {"ratio": 0.6}), rules.Rule("I", "inverted_core", {"margin": 0.3})))
    order = Window.orderBy(rules.severity_rank(F.col("severity")), -F.size("modules"), F.when(F.col("kind") == "god_module", 0).otherwise(1), "title")
    return found.select("kind", "severity", "title", F.size("modules").cast("long").alias("size"), F.row_number().over(order).cast("long").alias("place"))


@query(
    f"""WITH {A.GRAPH}, g AS (SELECT id, CASE WHEN regexp_matches(file_path, '(?s)^.*src/eco.*$') THEN 'eco' WHEN regexp_matches(name, '(?s)^C1.*$') THEN 'ones' WHEN regexp_matches(qualified_name, '(?s)^NS::Brand[2-3].::.*$') THEN 'brands' ELSE '(unassigned)' END AS module FROM ent)
SELECT module, count(*) AS n FROM g GROUP BY module"""
)
def glob_groups(spark, d):
    groups = [("eco", ["*src/eco*"]), ("ones", ["C1*"]), ("brands", ["NS::Brand[2-3]?::*"])]
    return modules.by_groups(A.entities(spark, d), groups).groupBy("module").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.ENT} SELECT qualified_name, CASE WHEN lower(name) = 'c12' THEN 2 ELSE 3 END AS tier FROM ent WHERE lower(name) = 'c12'")
def resolver_tiers(spark, d):
    from codestrata.operators.relational import resolve_tiered

    return resolve_tiered(A.entities(spark, d), "c12").select("qualified_name", "tier")


@query(f"WITH {A.GRAPH} SELECT src, dst, kind, concat('C', src, ' --', kind, '--> C', dst, ' (C', src, '.hxx:', evidence_line, ')') AS evidence FROM internal")
def evidence_text(spark, d):
    name = lambda c: F.concat(F.lit("C"), F.col(c).cast("string"))
    path = F.concat(F.lit("src/x/C"), F.col("src").cast("string"), F.lit(".hxx"))
    return _internal(spark, d).select("src", "dst", "kind", X.evidence(name("src"), F.col("kind"), name("dst"), path, F.col("evidence_line")).alias("evidence"))


@query()
def community_modules(spark, d):
    """Label propagation; tests/test_graph_queries.py checks its fixpoint."""
    ents = A.entities(spark, d)
    name = lambda c: ents.select(F.col("id").alias(c), F.col("qualified_name").alias(f"{c}_q"))
    pairs = A.relationships(spark, d).filter("src <> dst").select("src", "dst").distinct()
    edges = pairs.join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_q").alias("src"), F.col("dst_q").alias("dst"))
    return modules.by_community(ents.select("qualified_name"), edges).groupBy("module").agg(F.count(F.lit(1)).alias("n"))


@query()
def modularity_communities(spark, d):
    """Communities by modularity, with their number, inner edges and modularity; tests/test_communities.py checks them."""
    ents, edges = A.entities(spark, d).select("id"), _edges(spark, d)
    found = Scratch(spark, "found").write(communities.communities(ents, edges))
    return found.crossJoin(F.broadcast(communities.modularity(edges, found)))


@query(
    f"""WITH {A.GRAPH}, {A.MODULE}, pair AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edge),
  ends AS (SELECT a.module AS a, b.module AS b FROM pair JOIN module a ON a.id = u JOIN module b ON b.id = v),
  per AS (SELECT a AS module, count(*) AS n FROM (SELECT a FROM ends UNION ALL SELECT b FROM ends) GROUP BY a),
  total AS (SELECT count(*) AS m, count(*) FILTER (a = b) AS i FROM ends)
SELECT (SELECT count(DISTINCT module) FROM module) AS communities, m AS edges, i AS inside, round(i / m - (SELECT sum((n / (2.0 * m)) * (n / (2.0 * m))) FROM per), 9) AS modularity FROM total"""
)
def module_modularity(spark, d):
    """The modularity of the modules by namespace."""
    return communities.modularity(_edges(spark, d), A.modules(spark, d).select("id", F.col("module").alias("community"))).withColumn("modularity", F.round("modularity", 9))


@query(f"WITH RECURSIVE {A.GRAPH}, {REACH.format(e='edge')}, {COMP}, {CEDGE}, outs AS (SELECT src, count(*) AS n FROM edge GROUP BY src) SELECT arg_min(c.id, struct_pack(n := -coalesce(o.n, 0), id := c.id)) AS id FROM comp c LEFT JOIN outs o ON o.src = c.id WHERE c.component NOT IN (SELECT dst FROM cedge) GROUP BY c.component")
def visible_roots(spark, d):
    return graph.visible_roots(A.entities(spark, d), _edges(spark, d, kept=True))


@query(
    f"""WITH RECURSIVE {A.GRAPH}, {REACH.format(e="edge")}, {COMP}, {CEDGE}, up AS (SELECT dst AS id, min(src) AS p FROM cedge GROUP BY dst),
  walk(id, spot) AS (SELECT DISTINCT component, component FROM comp UNION SELECT w.id, up.p FROM walk w JOIN up ON up.id = w.spot) SELECT id, spot AS root FROM walk WHERE spot NOT IN (SELECT id FROM up)"""
)
def root_of(spark, d):
    e = _edges(spark, d, kept=True)
    c = graph.components(A.entities(spark, d), e)
    return graph.root_of(graph.condensed_edges(c, e), c.select(F.col("component").alias("id")))


@query(
    f"""WITH RECURSIVE {A.GRAPH}, {REACH.format(e="edge")}, {COMP}, {CEDGE}, below(root, c) AS (SELECT * FROM (VALUES (CAST(1999 AS BIGINT), CAST(1999 AS BIGINT)), (1500, 1500)) UNION SELECT b.root, e.dst FROM below b JOIN cedge e ON e.src = b.c)
SELECT root, id FROM below JOIN comp ON component = c"""
)
def subtree_members(spark, d):
    e = _edges(spark, d, kept=True)
    c = graph.components(A.entities(spark, d), e)
    ids = spark.range(1).select(F.explode(F.array(*[F.lit(r).cast("long") for r in DOM_ROOTS])).alias("id"))
    return graph.subtree_members(c, graph.condensed_edges(c, e), ids)
