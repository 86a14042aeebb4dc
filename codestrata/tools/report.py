"""The report: one JSON payload and a page that shows it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.kinds import CLASS_KINDS, level_of
from codestrata.operators import dominators, graph
from codestrata.session import Scratch
from codestrata.tools.review import by_priority, safe_json

def class_nodes(entities: DataFrame) -> DataFrame:
    """(id, name, kind, file_path) of the classes that are no phantoms."""
    real = entities.filter(F.col("kind").isin(*CLASS_KINDS) & ~F.coalesce("phantom", F.lit(False)))
    return real.groupBy(F.col("qualified_name").alias("id")).agg(F.min("name").alias("name"), F.min("kind").alias("kind"), F.min("file_path").alias("file_path"))


def forest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, id, parent, kind, depth): the dominator tree below every root of the condensed graph; the first root that reaches a node, by name, has it. The kind is the strongest between parent and node, else `dominates`."""
    scratch = Scratch(nodes.sparkSession, "forest")
    comp = scratch.write(graph.components(nodes, edges))
    cond = scratch.write(graph.condensed_edges(comp, edges))
    tree = scratch.write(dominators.forest(cond))
    strongest = edges.join(comp.select(F.col("id").alias("src"), F.col("component").alias("parent")), "src").join(comp.select(F.col("id").alias("dst"), F.col("component").alias("child")), "dst").filter("parent <> child")
    kinds = strongest.select("parent", "child", F.explode("kinds").alias("k")).groupBy("parent", F.col("child").alias("id")).agg(F.max_by("k", F.struct(level_of(F.col("k")), "k")).alias("kind"))
    alone = comp.select(F.col("component").alias("id")).distinct().join(tree.select("id"), "id", "left_anti")
    every = tree.unionByName(alone.select(F.col("id").alias("root"), "id", F.lit(None).cast(tree.schema["parent"].dataType).alias("parent"), F.lit(0).alias("depth")))
    return every.join(kinds, ["parent", "id"], "left").select("root", "id", "parent", F.when(F.col("parent").isNotNull(), F.coalesce("kind", F.lit("dominates"))).alias("kind"), "depth")


def pair_payload(relationships: DataFrame, nodes: DataFrame, keep: int = 8) -> DataFrame:
    """(src, dst, primary_kind, kinds, level, structural, evidence) of class pairs, evidence as text."""
    edges = graph.internal_edges(relationships.select(F.col("source_qname").alias("src"), F.col("target_qname").alias("dst"), "kind", "evidence_file", "evidence_line"), nodes)
    place = F.concat("evidence_file", F.lit(":"), F.col("evidence_line").cast("string"))
    pairs = graph.pair_edges(edges.withColumn("evidence_line", place))
    return pairs.withColumn("evidence", F.slice(F.transform("evidence", lambda e: F.concat(e["kind"], F.lit(" "), e["evidence_line"])), 1, keep))


def folded_forest(nodes: DataFrame, edges: DataFrame, relationships: DataFrame, orchestrator: str | None = None) -> DataFrame:
    """The forest after leaf subclasses of families are folded into their base, the orchestrator kept apart; `impls` names what a node stands for besides itself."""
    rel = relationships.select(F.col("source_qname").alias("src"), F.col("target_qname").alias("dst"), "kind", "evidence_file", "evidence_line")
    parent = graph.parents(graph.internal_edges(rel, nodes), [F.col("evidence_file"), F.col("evidence_line"), F.col("dst")])
    rep = Scratch(nodes.sparkSession, "fold").write(graph.representatives(nodes, parent, "leaves", (orchestrator,) if orchestrator else ()))
    members, folded = graph.fold(edges, rep)
    impls = members.select("id", F.transform(F.array_except("members", F.array("id")), lambda m: F.element_at(F.split(m, "::"), -1)).alias("impls"))
    return forest(members.select("id"), folded).join(impls, "id").select("root", "id", "parent", "kind", "depth", "impls")


def build_payload(entities: DataFrame, relationships: DataFrame, audit: dict | None = None, reviews: dict[str, str] | None = None, orchestrator: str | None = None) -> dict:
    """summary, graph, arch, arch_graph and review, with all classes: the page is one document, so its size is that of the code base's graph."""
    nodes = class_nodes(entities)
    pairs = pair_payload(relationships, nodes)
    edges = graph.build_graph(nodes, relationships.select(F.col("source_qname").alias("src"), F.col("target_qname").alias("dst"), "kind"))
    fan_in = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    visible = {r["id"] for r in graph.visible_roots(nodes, edges).collect()}
    util = graph.degrees(nodes, edges).select("id", (graph.is_utility() & ~F.col("id").eqNullSafe(F.lit(orchestrator).cast("string"))).alias("utility"))
    shown = nodes.join(fan_in, "id", "left").join(util, "id").fillna(0, ["fan_in"]).orderBy(F.desc("fan_in"), "id").collect()
    links = [r.asDict(recursive=True) for r in pairs.orderBy("src", "dst").collect()]
    tree = [r.asDict() for r in folded_forest(nodes, edges, relationships, orchestrator).orderBy("root", "id").collect()]
    review = [{"module": m, **(safe_json(t) or {"assessment": t})} for m, t in sorted((reviews or {}).items())]
    return {
        "summary": {"classes": nodes.count(), "relationships": relationships.count(), "shown": len(shown)},
        "graph": {"nodes": [{**r.asDict(), "visible": r["id"] in visible} for r in shown], "edges": links},
        "arch": tree, "arch_graph": audit or {"nodes": [], "edges": [], "findings": [], "plans": []}, "review": by_priority(review),
    }


PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>Architecture</title>
<style>body{font:14px sans-serif;margin:1.5em;max-width:75em}nav button{margin-right:.5em}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:.2em .5em;text-align:left}ul{list-style:none}.high{color:#a00}.medium{color:#a60}</style></head><body>
<h1>Architecture</h1><p id="summary"></p><p><input id="q" placeholder="class"> <span id="hits"></span></p>
<nav></nav><main></main>
<script id="data" type="application/json">__PAYLOAD__</script>
<script>
const D = JSON.parse(document.getElementById('data').textContent), $ = s => document.querySelector(s)
const el = (tag, text, cls) => { const e = document.createElement(tag); if (text != null) e.textContent = text; if (cls) e.className = cls; return e }
const table = (head, rows) => { const t = el('table'), h = el('tr'); head.forEach(x => h.append(el('th', x))); t.append(h); rows.forEach(r => { const row = el('tr'); r.forEach(x => row.append(x instanceof Node ? x : el('td', x))); t.append(row) }); return t }
const glyph = {inherits: '\\u25B7', implements: '\\u25B7 (dashed)', composes: '\\u25C6', aggregates: '\\u25C7', associates: '\\u2192', depends: '\\u21E2', dominates: '\\u2026'}
$('#summary').textContent = Object.entries(D.summary).map(x => x.join(': ')).join(', ')
const focus = id => { const out = D.graph.edges.filter(e => e.src === id), into = D.graph.edges.filter(e => e.dst === id), m = $('main'); m.replaceChildren(el('h2', id)); const rows = (l, end) => l.map(e => [e[end], e.kinds.map(k => glyph[k] + ' ' + k).join(', '), e.evidence.join('; ')]); m.append(el('h3', 'uses'), table(['class', 'kinds', 'evidence'], rows(out, 'dst')), el('h3', 'used by'), table(['class', 'kinds', 'evidence'], rows(into, 'src'))) }
const link = id => { const td = el('td'), a = el('a', id); a.href = '#'; a.onclick = () => { focus(id); return false }; td.append(a); return td }
const views = {
  Classes: () => table(['class', 'kind', 'file', 'fan-in', 'utility'], D.graph.nodes.map(n => [link(n.id), n.kind, n.file_path, n.fan_in, n.utility ? 'yes' : ''])),
  Workflow: () => { const kids = {}; D.arch.forEach(r => (kids[r.parent || ''] ||= []).push(r)); const grow = (p, seen) => { const u = el('ul'); (kids[p] || []).forEach(r => { if (seen.has(r.id)) return; const li = el('li', (r.kind ? glyph[r.kind] + ' ' : '') + r.id + (r.impls.length ? ' (+' + r.impls.join(', ') + ')' : '')); li.append(grow(r.id, new Set([...seen, r.id]))); u.append(li) }); return u }; return grow('', new Set()) },
  Modules: () => { const d = el('div'); d.append(table(['module', 'size', 'in', 'out', 'in cycle', 'god'], D.arch_graph.nodes.map(n => [n.id, n.size, n.in_degree, n.out_degree, n.in_cycle ? 'yes' : '', n.is_god ? 'yes' : ''])), el('h3', 'dependencies'), table(['from', 'to', 'references', 'kinds'], D.arch_graph.edges.map(e => [e.src, e.dst, e.weight, e.kinds.join(', ')]))); return d },
  Findings: () => { const d = el('div'); D.arch_graph.findings.forEach(f => { d.append(el('h3', f.title, f.severity), el('p', f.detail), el('pre', f.evidence.join('\\n'))) }); D.arch_graph.plans.forEach(p => d.append(el('h3', 'Plan: ' + p.members.join(', ')), el('pre', p.cuts.map(c => c.src + ' -> ' + c.dst + ': ' + c.prescription).join('\\n')))); return d },
  Review: () => { const d = el('div'); D.review.forEach(r => d.append(el('h3', r.module, r.priority), el('p', r.assessment), el('p', r.recommendation))); return d },
}
for (const name in views) { const b = el('button', name); b.onclick = () => $('main').replaceChildren(views[name]()); $('nav').append(b) }
$('#q').oninput = e => { const q = e.target.value.toLowerCase(), all = D.graph.nodes.map(n => n.id), tiers = [x => x.toLowerCase() === q, x => x.toLowerCase().split('::').pop() === q, x => x.toLowerCase().includes(q)]; const hits = q ? tiers.map(t => all.filter(t)).find(h => h.length) || [] : []; $('#hits').textContent = hits.slice(0, 10).join(', '); if (hits.length === 1) focus(hits[0]) }
$('main').replaceChildren(views.Classes())
</script></body></html>
"""


def render(payload: dict) -> str:
    """The page with its data; `<` is escaped, so no text can end the script."""
    return PAGE.replace("__PAYLOAD__", json.dumps(payload, sort_keys=True).replace("<", "\\u003c"))
