"""Architecture rules over the module graph; each gives findings of one shape.

A finding is (rule_id, kind, severity, title, detail, modules, evidence, subject).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.operators import graph

FINDING = "rule_id string, kind string, severity string, title string, detail string, modules array<string>, evidence array<string>, subject array<string>"
KEEP = 12


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    params: dict = field(default_factory=dict)


UNIVERSAL = (Rule("U1", "no_module_cycle"), Rule("U2", "god_module", {"ratio": 0.6, "min_dependents": 3}), Rule("U3", "inverted_core", {"margin": 0.3}))


@dataclass
class ModuleGraph:
    """nodes (id), edges (src, dst, weight, kinds, kind_counts, evidence)."""

    nodes: DataFrame
    edges: DataFrame


def _finding(df: DataFrame, rule: Rule, severity: str, title, detail, modules, evidence, subject) -> DataFrame:
    texts = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return df.select(
        F.lit(rule.id).alias("rule_id"), F.lit(rule.kind).alias("kind"), F.lit(severity).alias("severity"), title.alias("title"), detail.alias("detail"),
        texts(modules).alias("modules"), texts(evidence).alias("evidence"), texts(subject).alias("subject"),
    )


def degrees(mg: ModuleGraph) -> DataFrame:
    """(id, out_n, in_n, instability): out / (in + out), 0 for an isolated module."""
    d = graph.degrees(mg.nodes, mg.edges.select("src", "dst", F.lit(1.0).alias("weight")))
    return d.select("id", "out_n", "in_n", F.coalesce(F.col("out_n") / F.nullif(F.col("in_n") + F.col("out_n"), F.lit(0)), F.lit(0.0)).alias("instability"))


def no_module_cycle(rule: Rule, mg: ModuleGraph) -> DataFrame:
    """One finding for each component of two modules or more, with the evidence of its inner edges."""
    comp = graph.components(mg.nodes, mg.edges)
    many = comp.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("modules")).filter("size(modules) > 1")
    inner = mg.edges.join(comp.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(comp.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").filter("a = b")
    lines = inner.groupBy(F.col("a").alias("component")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("evidence"))), 1, KEEP).alias("evidence"))
    found = many.join(lines, "component")
    title = F.concat(F.lit("Module cycle: "), F.array_join("modules", ", "))
    return _finding(found, rule, "high", title, F.format_string("%d modules depend on one another", F.size("modules")), F.col("modules"), F.col("evidence"), F.array().cast("array<string>"))


def god_module(rule: Rule, mg: ModuleGraph) -> DataFrame:
    """A module on which at least max(min_dependents, ceil(ratio * others)) modules depend, among four modules or more."""
    n = mg.nodes.count()
    least = max(int(rule.params.get("min_dependents", 3)), math.ceil(float(rule.params.get("ratio", 0.6)) * (n - 1)))
    d = degrees(mg).filter(F.lit(n >= 4) & (F.col("in_n") >= least))
    into = mg.edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("users"), F.slice(F.array_sort(F.flatten(F.collect_list("evidence"))), 1, KEEP).alias("evidence"))
    found = d.join(into, "id")
    return _finding(found, rule, "high", F.concat(F.lit("God module: "), F.col("id")), F.format_string("%d of %d other modules depend on it", "in_n", F.lit(n - 1)), F.concat(F.array("id"), F.col("users")), F.col("evidence"), F.array("id"))


def inverted_core(rule: Rule, mg: ModuleGraph) -> DataFrame:
    """An edge from a module that others rest on to a less stable one: instability higher by `margin`, among three modules or more."""
    margin = float(rule.params.get("margin", 0.3))
    d = degrees(mg)
    a = d.select(F.col("id").alias("src"), F.col("in_n").alias("a_in"), F.col("instability").alias("a_i"))
    b = d.select(F.col("id").alias("dst"), F.col("instability").alias("b_i"))
    found = mg.edges.join(a, "src").join(b, "dst").filter((F.col("a_in") >= 2) & (F.col("b_i") - F.col("a_i") >= margin) & F.lit(mg.nodes.count() >= 3))
    title = F.concat(F.lit("Stable module "), F.col("src"), F.lit(" depends on unstable "), F.col("dst"))
    return _finding(found, rule, "medium", title, F.format_string("instability %.2f and %.2f", "a_i", "b_i"), F.array("src", "dst"), F.slice("evidence", 1, KEEP), F.array().cast("array<string>"))


def forbid_dependency(rule: Rule, mg: ModuleGraph) -> DataFrame:
    """An edge that the rule's `from` and `to` forbid."""
    found = mg.edges.filter((F.col("src") == rule.params.get("from")) & (F.col("dst") == rule.params.get("to")))
    return _finding(found, rule, "high", F.concat(F.lit("Forbidden dependency "), F.col("src"), F.lit(" -> "), F.col("dst")), F.format_string("%d references", "weight"), F.array("src", "dst"), F.slice("evidence", 1, KEEP), F.array().cast("array<string>"))


CHECKERS: dict[str, Callable[[Rule, ModuleGraph], DataFrame]] = {"no_module_cycle": no_module_cycle, "god_module": god_module, "inverted_core": inverted_core, "forbid_dependency": forbid_dependency}


def register(kind: str, checker: Callable[[Rule, ModuleGraph], DataFrame]) -> None:
    """Add a rule kind."""
    CHECKERS[kind] = checker


def severity_rank(severity):
    return F.when(severity == "high", 0).when(severity == "low", 2).otherwise(1)


def ordered(findings: DataFrame) -> DataFrame:
    """Most severe first, then most modules, then in the order of the rules."""
    return findings.orderBy(severity_rank(F.col("severity")), -F.size("modules"), "rule_ord", "title").drop("rule_ord")


def audit(mg: ModuleGraph, rules: tuple[Rule, ...] = UNIVERSAL) -> DataFrame:
    """All findings of all rules of a known kind, in order."""
    out = None
    for i, r in enumerate(rules):
        if r.kind in CHECKERS:
            found = CHECKERS[r.kind](r, mg).withColumn("rule_ord", F.lit(i))
            out = found if out is None else out.unionByName(found)
    return ordered(out if out is not None else mg.nodes.sparkSession.createDataFrame([], FINDING + ", rule_ord int"))


def audit_nodes(mg: ModuleGraph, findings: DataFrame, membership: DataFrame, keep: int = 20) -> DataFrame:
    """(id, size, members, in_degree, out_degree, in_cycle, is_god) of every module."""
    cyclic = findings.filter("kind = 'no_module_cycle'").select(F.explode("modules").alias("id")).distinct().withColumn("in_cycle", F.lit(True))
    god = findings.filter("kind = 'god_module'").select(F.explode("subject").alias("id")).distinct().withColumn("is_god", F.lit(True))
    members = membership.groupBy(F.col("module").alias("id")).agg(F.count(F.lit(1)).alias("size"), F.slice(F.array_sort(F.collect_list("name")), 1, keep).alias("members"))
    d = degrees(mg).select("id", F.col("in_n").alias("in_degree"), F.col("out_n").alias("out_degree"))
    return d.join(members, "id", "left").join(cyclic, "id", "left").join(god, "id", "left").fillna(False, ["in_cycle", "is_god"]).fillna(0, ["size"])


def audit_edges(mg: ModuleGraph, findings: DataFrame, keep: int = 8) -> DataFrame:
    """(src, dst, weight, kinds, evidence, in_cycle): an edge is in a cycle if both its ends are in any."""
    cyclic = findings.filter("kind = 'no_module_cycle'").select(F.explode("modules").alias("m")).distinct()
    e = mg.edges.join(cyclic.select(F.col("m").alias("src"), F.lit(True).alias("a")), "src", "left").join(cyclic.select(F.col("m").alias("dst"), F.lit(True).alias("b")), "dst", "left")
    return e.select("src", "dst", "weight", "kinds", F.slice("evidence", 1, keep).alias("evidence"), F.coalesce(F.col("a") & F.col("b"), F.lit(False)).alias("in_cycle"))
