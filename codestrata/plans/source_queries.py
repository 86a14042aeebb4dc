"""Queries that run the extractors on sources made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.plans import adapter as A
from codestrata.plans.registry import query
from codestrata.session import Scratch
from codestrata.session import read_table as read
from codestrata.sources import scan


def _cpp_files(spark, d):
    """A C++ file for each part: a class that inherits, holds and uses other parts' classes."""
    key = F.col("p_partkey")
    other = lambda n: F.concat(F.lit("C"), F.floor(key / n).cast("string"))
    text = F.concat(
        F.lit("// class Fake { };\nnamespace "), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" {\nclass C"), key.cast("string"), F.lit(" : public "), other(2), F.lit(" {\n  std::vector<"), other(3), F.lit("*> m_many;\n  "),
        other(5), F.lit("* m_one;\n  void run(const "), other(7), F.lit("& x) { "), other(11), F.lit(" y; }\n};\n}\n"),
    )
    return read(spark, d, "part").select(F.concat(F.lit("p"), key.cast("string"), F.lit(".hxx")).alias("file_path"), text.alias("text"))


PARTS = """SELECT concat('p', p_partkey, '.hxx') AS file_path, concat(replace(p_brand, '#', ''), '::C', p_partkey) AS source, p_partkey AS k FROM part"""


@query(
    f"""SELECT file_path, source AS source_qname, 'inherits' AS kind, concat('C', k // 2) AS target_name, 3 AS line FROM ({PARTS})
UNION ALL SELECT file_path, source, 'aggregates', concat('C', k // 3), 4 FROM ({PARTS}) UNION ALL SELECT file_path, source, 'associates', concat('C', k // 5), 5 FROM ({PARTS})
UNION ALL SELECT file_path, source, 'depends', concat('C', k // 7), 6 FROM ({PARTS}) UNION ALL SELECT file_path, source, 'depends', concat('C', k // 11), 6 FROM ({PARTS}) WHERE k // 11 <> k // 7"""
)
def cpp_extract(spark, d):
    rows = scan.parse_cpp(_cpp_files(spark, d)).filter("tag = 'relationship'")
    return rows.select("file_path", "source_qname", "kind", "target_name", F.col("start_line").alias("line"))


@query(
    f"""SELECT kind, count(*) AS n, min(qualified_name) AS first FROM (SELECT 'namespace' AS kind, replace(p_brand, '#', '') AS qualified_name FROM part
UNION ALL SELECT 'class', source FROM ({PARTS}) UNION ALL SELECT 'method', concat(source, '::run') FROM ({PARTS}) UNION ALL SELECT 'field', concat(source, '::m_many') FROM ({PARTS}) UNION ALL SELECT 'field', concat(source, '::m_one') FROM ({PARTS})) GROUP BY kind"""
)
def cpp_entities(spark, d):
    rows = scan.parse_cpp(_cpp_files(spark, d)).filter("tag = 'entity'")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("first"))


@query(
    """SELECT concat('s', s_suppkey, '.sch') AS file_path, concat('S', s_suppkey) AS source_qname, 'inherits' AS kind, concat('N', s_nationkey) AS target_name, 4 AS line FROM supplier
UNION ALL SELECT concat('s', s_suppkey, '.sch'), concat('S', s_suppkey), 'associates', concat('S', s_suppkey // 2), 6 FROM supplier UNION ALL SELECT concat('s', s_suppkey, '.sch'), concat('S', s_suppkey), 'composes', concat('N', s_nationkey), 7 FROM supplier"""
)
def sch_extract(spark, d):
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.concat(F.lit("forward_declare class X;\n\nclass S"), key, F.lit(" {\n  superclass N"), nation, F.lit("\n  void run();\n  S"), F.floor(F.col("s_suppkey") / 2).cast("string"), F.lit("* m_half;\n  N"), nation, F.lit(" m_nation;\n  int m_n;\n};\n"))
    rows = scan.parse_sch(read(spark, d, "supplier").select(F.concat(F.lit("s"), key, F.lit(".sch")).alias("file_path"), text.alias("text"))).filter("tag = 'relationship'")
    return rows.select("file_path", "source_qname", "kind", "target_name", F.col("start_line").alias("line"))


@query("SELECT item_id, sha256(concat('offline', chr(0), 'Judge.', chr(0), text)) AS prompt_hash, CASE WHEN item_id % 3 = 0 THEN 'held' END AS response FROM benchmark")
def llm_review_stub(spark, d):
    """Answers from the cache where it has them; the offline client gives none."""
    from codestrata.functions.text import prompt_hash
    from codestrata.tools.client import Offline
    from codestrata.tools.review import ask

    prompts = read(spark, d, "benchmark").select("item_id", F.lit("Judge.").alias("system"), F.col("text").alias("prompt"))
    cache = prompts.filter("item_id % 3 = 0").select(prompt_hash(F.lit("offline"), F.col("system"), F.col("prompt")).alias("prompt_hash"), F.lit("offline").alias("model"), F.lit("held").alias("response")).distinct()
    return ask(prompts, Offline, cache, "offline", ["item_id"]).select("item_id", "prompt_hash", "response")


@query(
    """WITH RECURSIVE a AS (SELECT concat('A', p_partkey) AS alias, CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 23 = 0 THEN concat('Class', p_partkey) ELSE concat('A', p_partkey + 1) END AS target, CASE WHEN p_partkey % 4 = 0 THEN 'associates' END AS kind FROM part),
  c(alias, target, kind, depth) AS (SELECT alias, target, kind, 1 FROM a UNION ALL SELECT c.alias, a.target, coalesce(c.kind, a.kind), depth + 1 FROM c JOIN a ON a.alias = c.target WHERE depth < 9)
SELECT alias, target, kind, depth FROM c WHERE target NOT IN (SELECT alias FROM a)"""
)
def alias_chains(spark, d):
    """Chains of up to 23 aliases, of which those longer than the bound are left out; some end in nothing."""
    from codestrata.operators.relational import chase_aliases

    key = F.col("p_partkey")
    target = F.when(key % 97 == 0, None).when(key % 23 == 0, F.concat(F.lit("Class"), key.cast("string"))).otherwise(F.concat(F.lit("A"), (key + 1).cast("string")))
    return chase_aliases(read(spark, d, "part").select(F.concat(F.lit("A"), key.cast("string")).alias("alias"), target.alias("target"), F.when(key % 4 == 0, "associates").alias("kind")))


@query(
    f"WITH {A.GRAPH}, p AS (SELECT *, id % 7 = 0 AS phantom, id % 50 AS span FROM ent), k AS (SELECT kind, split_part(file_path, '/', 2) AS q, id, phantom, row_number() OVER (PARTITION BY kind, split_part(file_path, '/', 2) ORDER BY phantom, -span, id) AS r, bool_and(phantom) OVER (PARTITION BY kind, split_part(file_path, '/', 2)) AS every FROM p) SELECT kind, q AS qualified_name, id, every AS phantom FROM k WHERE r = 1"
)
def entity_dedup(spark, d):
    from codestrata.operators.relational import dedup_entities

    e = A.entities(spark, d).select("kind", F.get(F.split("file_path", "/"), F.lit(1)).alias("qualified_name"), "id", (F.col("id") % 7 == 0).alias("phantom"), F.lit(0).cast("long").alias("start_line"), (F.col("id") % 50).alias("end_line"))
    return dedup_entities(e, [F.col("id")]).select("kind", "qualified_name", "id", "phantom")


@query(f"WITH {A.ENT}, {A.REL} SELECT src AS source_qname, dst AS target_qname, kind, min(evidence_line) AS first_line FROM rel GROUP BY src, dst, kind")
def edge_dedup(spark, d):
    from codestrata.operators.relational import dedup_edges

    r = A.relationships(spark, d).select(F.col("src").alias("source_qname"), F.col("dst").alias("target_qname"), F.lit(None).cast("long").alias("target_name"), "kind", F.lit("f").alias("evidence_file"), F.lit(0).alias("evidence_line"), F.col("evidence_line").alias("at"))
    return dedup_edges(r, [F.col("at")]).select("source_qname", "target_qname", "kind", F.col("at").alias("first_line"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """The batch side of the streaming aggregation."""
    from codestrata.streaming.incremental import event_counts

    return event_counts(read(spark, d, "events")).withColumn("total", F.round("total", 6))


# -- assembly -------------------------------------------------------------------
#: A file for each part: a class with a base; some with a pure method, a field as well, a member of a class that no file defines, a class written with and without its scope, an alias that others may pass on. The alias of part 0 is its own and so has no end.
PLANTED = """p AS (SELECT p_partkey AS k, concat('src/f', p_partkey, '.hxx') AS file, p_partkey // 2 AS half FROM part),
  chain(k, link) AS (SELECT k, k FROM p WHERE k % 4 = 0 AND k > 0 UNION ALL SELECT chain.k, chain.link // 4 FROM chain WHERE chain.link % 16 = 0),
  ends AS (SELECT k, min(link) // 2 AS box FROM chain GROUP BY k),
  found AS (SELECT concat('N::Box', p.k) AS source_qname, CASE WHEN b.k IS NOT NULL THEN concat('N::Box', p.half) END AS target_qname, concat('Box', p.half) AS target_name, CASE WHEN b.k % 3 = 0 THEN 'implements' ELSE 'inherits' END AS kind FROM p LEFT JOIN p b ON b.k = p.half
    UNION ALL SELECT concat('N::Box', e.k), CASE WHEN b.k IS NOT NULL THEN concat('N::Box', box) END, concat('Box', box), CASE WHEN e.k % 8 = 0 THEN 'aggregates' ELSE 'composes' END FROM ends e LEFT JOIN p b ON b.k = e.box
    UNION ALL SELECT concat('Z::Solo', k), NULL, concat('Missing', k), 'depends' FROM p WHERE k % 5 = 0)"""


def _planted(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    named = lambda prefix, n=k: F.concat(F.lit(prefix), n.cast("string"))
    types = dict(x.split(" ", 1) for x in scan.ROW.split(", ")[:-1])

    def row(tag, seq, **given):
        cells = {"file_path": F.concat(F.lit("src/f"), k.cast("string"), F.lit(".hxx")), "tag": F.lit(tag), "seq": F.lit(seq), "start_line": F.lit(seq), "end_line": F.lit(seq), **given}
        return F.struct(*[cells.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()], F.lit(None).cast(scan.ATTRS).alias("attrs"))

    entity = lambda seq, kind, name, qname, parent, signature=None: row("entity", seq, kind=F.lit(kind), name=name, qualified_name=qname, parent_qname=parent, signature=F.lit(signature))
    points = lambda seq, kind, source, target: row("relationship", seq, kind=F.lit(kind), source_qname=source, target_name=target)
    box, none = named("N::Box"), F.lit(None)
    passed_on = F.when(k % 16 == 0, named("A", F.floor(k / 4))).otherwise(named("Box", F.floor(k / 2)))
    rows = F.array(
        entity(1, "class", named("Box"), box, F.lit("N")),
        F.when(k % 3 == 0, entity(2, "method", F.lit("run"), F.concat(box, F.lit("::run")), box, "virtual void run() = 0;")),
        F.when(k % 6 == 0, entity(3, "field", F.lit("f"), F.concat(box, F.lit("::f")), box, "int f;")),
        F.when(k % 7 == 0, entity(4, "method", F.lit("go"), F.concat(named("Ghost::G"), F.lit("::go")), named("Ghost::G"), "void go();")),
        F.when(k % 5 == 0, entity(5, "class", named("Solo"), named("Solo"), none)),
        F.when(k % 5 == 0, entity(6, "class", named("Solo"), named("Z::Solo"), F.lit("Z"))),
        points(7, "inherits", box, named("Box", F.floor(k / 2))),
        F.when(k % 4 == 0, row("alias", 8, name=named("A"), qualified_name=passed_on, kind=F.when(k % 8 == 0, "aggregates"))),
        F.when(k % 4 == 0, points(9, "composes", box, named("A"))),
        F.when(k % 5 == 0, points(10, "depends", named("Solo"), named("Missing"))),
    )
    return read(spark, d, "part").select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")


def _assembled(spark, d) -> scan.CodeGraph:
    return scan.assemble(_planted(spark, d), Scratch(spark, "assembled"))


@query(
    f"""WITH RECURSIVE {PLANTED} SELECT concat('N::Box', k) AS qualified_name, CASE WHEN k % 6 = 3 THEN 'interface' ELSE 'class' END AS kind, concat('N') AS parent_qname, false AS phantom FROM p
UNION ALL SELECT concat('N::Box', k, '::run'), 'method', concat('N::Box', k), false FROM p WHERE k % 3 = 0 UNION ALL SELECT concat('N::Box', k, '::f'), 'field', concat('N::Box', k), false FROM p WHERE k % 6 = 0
UNION ALL SELECT concat('Ghost::G', k), 'class', 'Ghost', true FROM p WHERE k % 7 = 0 UNION ALL SELECT concat('Ghost::G', k, '::go'), 'method', concat('Ghost::G', k), false FROM p WHERE k % 7 = 0
UNION ALL SELECT concat('Z::Solo', k), 'class', NULL, false FROM p WHERE k % 5 = 0"""
)
def assembled_entities(spark, d):
    """Kinds refined, phantoms made, bare names merged: the first written of merged rows stays."""
    scratch = Scratch(spark, "assembled")
    rows = scratch.write(_planted(spark, d).filter("tag = 'entity'"))
    return scan.assemble_entities(rows, scratch).final.select("qualified_name", "kind", "parent_qname", "phantom")


@query(f"WITH RECURSIVE {PLANTED} SELECT * FROM found")
def assembled_relationships(spark, d):
    """Names resolved over files, aliases followed to their ends, inheritance of abstract bases re-tagged, merged sources renamed."""
    return _assembled(spark, d).relationships.select("source_qname", "target_qname", "target_name", "kind")


@query(
    f"""WITH RECURSIVE {PLANTED} SELECT (SELECT count(*) FROM p WHERE k % 5 = 0) AS merged_count, (SELECT count(*) FROM p WHERE k % 7 = 0) AS phantom_count, (SELECT count(*) FROM p WHERE k % 4 = 0 AND k > 0) AS alias_expanded,
  (SELECT count(*) FROM p WHERE k % 6 = 3) AS interface_count, (SELECT count(*) FROM found) AS relationship_count, (SELECT count(target_qname) FROM found) AS resolved_count, (SELECT count(*) FROM found WHERE kind = 'implements') AS retagged_count"""
)
def assembled_counts(spark, d):
    return _assembled(spark, d).statistics.select("merged_count", "phantom_count", "alias_expanded", "interface_count", "relationship_count", "resolved_count", "retagged_count")
