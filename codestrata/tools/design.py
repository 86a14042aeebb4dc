"""Prompts of the class review: one for each subtree, then one over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.kinds import CLASS_KINDS
from codestrata.functions.text import template
from codestrata.operators.relational import top_k

# How much of a subtree a prompt shows, and the tokens of a template.
METHODS, FIELDS, RELATIONS = 60, 40, 80
TOKENS = ("SCOPE", "ROOT", "CLASSES", "METHODS", "FIELDS", "RELATIONS", "SUBTREES", "CROSS_RELATIONS")
SYSTEM = "You review the design of C++ classes."
DEFAULT = """Pass: {SCOPE}. Root: {ROOT}
Classes:
{CLASSES}
Methods:
{METHODS}
Fields:
{FIELDS}
Relations:
{RELATIONS}
Subtrees reviewed:
{SUBTREES}
Relations between subtrees:
{CROSS_RELATIONS}
Reply with JSON {"assessment": text, "recommendations": [{"title": text, "priority": "high", "medium" or "low"}]}."""


def _listed(df: DataFrame, key: str, text: Column, order: list[str], name: str, keep: int | None = None) -> DataFrame:
    """(key, name): the rows' texts as lines, the first `keep` and how many more."""
    counted = keep and name != "RELATIONS"
    some = top_k(df, [key], [F.col(c) for c in order], keep) if keep else df
    rows = some.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("__t")))).alias("__l"))
    lines = F.array_join(F.array_distinct(F.transform("__l", lambda x: x["__t"])), "\n")
    if not counted:
        return rows.select(key, lines.alias(name))
    rows = rows.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key)
    more = F.when(F.col("__n") > keep, F.format_string("\n  ... and %d more", F.col("__n") - keep)).otherwise("")
    return rows.select(key, F.concat(lines, more).alias(name))


def relation_lines(relationships: DataFrame, inside: DataFrame) -> DataFrame:
    """(subtree_root, RELATIONS): relations with both ends among a subtree's classes; the first 80, then repeated lines left out."""
    a, b = inside.select("subtree_root", F.col("id").alias("source_qname")), inside.select("subtree_root", F.col("id").alias("target_qname"))
    within = relationships.join(a, "source_qname").join(b, ["subtree_root", "target_qname"])
    text = F.concat(F.lit("  - "), "source_qname", F.lit("  --"), "kind", F.lit("-->  "), "target_qname")
    return _listed(within.select("subtree_root", "source_qname", "target_qname", "kind", "evidence_line"), "subtree_root", text, ["source_qname", "evidence_line", "kind", "target_qname"], "RELATIONS", RELATIONS)


def subtree_prompts(inside: DataFrame, entities: DataFrame, relationships: DataFrame, override: str | None = None) -> DataFrame:
    """(subtree_root, system, prompt) for subtrees (subtree_root, id); the template is the override, or the default."""
    classes = entities.filter(F.col("kind").isin(*CLASS_KINDS)).select(F.col("qualified_name").alias("id"), "kind", "file_path", "start_line", "end_line")
    members = entities.filter(F.col("kind").isin("method", "field")).select(F.col("parent_qname").alias("id"), "kind", "qualified_name", "signature")
    at = F.format_string("  - %s %s  (%s:%d-%d)", "kind", "id", "file_path", "start_line", "end_line")
    line = F.concat(F.lit("  - "), "qualified_name", F.lit("  ::  "), F.coalesce("signature", F.lit("")))
    own = inside.join(members, "id")
    parts = [
        _listed(inside.join(classes, "id"), "subtree_root", at, ["id", "kind", "file_path", "start_line", "end_line"], "CLASSES"),
        _listed(own.filter("kind = 'method'"), "subtree_root", line, ["qualified_name", "signature"], "METHODS", METHODS),
        _listed(own.filter("kind = 'field'"), "subtree_root", line, ["qualified_name", "signature"], "FIELDS", FIELDS),
        relation_lines(relationships, inside),
    ]
    out = inside.select("subtree_root").distinct()
    for p in parts:
        out = out.join(p, "subtree_root", "left")
    none = lambda c: F.coalesce(c, F.lit("  (none)"))
    values = {"SCOPE": F.lit("subtree"), "ROOT": F.col("subtree_root"), **{n: none(F.col(n)) for n in ("CLASSES", "METHODS", "FIELDS", "RELATIONS")}, "SUBTREES": F.lit("  (none)"), "CROSS_RELATIONS": F.lit("  (none)")}
    return out.select("subtree_root", F.lit(SYSTEM).alias("system"), template(F.lit(override or DEFAULT), values).alias("prompt"))


def cross_relations(relationships: DataFrame, comp: DataFrame) -> list[str]:
    """Lines of the first relations between different condensed nodes, as the second pass shows them."""
    a, b = comp.select(F.col("id").alias("source_qname"), F.col("component").alias("a")), comp.select(F.col("id").alias("target_qname"), F.col("component").alias("b"))
    rows = relationships.join(a, "source_qname").join(b, "target_qname").filter("a <> b").orderBy("source_qname", "target_qname", "kind", "evidence_file", "evidence_line").limit(RELATIONS).collect()
    return list(dict.fromkeys(f"  - {r['source_qname']}  --{r['kind']}-->  {r['target_qname']}" for r in rows))


def module_prompt(reviews: list[tuple[str, str]], cross: list[str], override: str | None = None) -> str:
    """The second pass's prompt, on the reviews of the first."""
    text = override or DEFAULT
    values = {t: "" for t in TOKENS} | {"SCOPE": "module", "SUBTREES": "\n".join(f"  - {r}: {t}" for r, t in reviews) or "  (none)", "CROSS_RELATIONS": "\n".join(cross) or "  (none)"}
    for token, value in values.items():
        text = text.replace("{" + token + "}", value)
    return text
