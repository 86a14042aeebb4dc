"""Queries on the driver's tables: keyed tables, names, text, JSON, plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions import text as X
from codestrata.operators import relational as R
from codestrata.plans import adapter as A
from codestrata.plans.registry import query
from codestrata.session import Scratch
from codestrata.session import read_table as read


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event_per_user(spark, d):
    return R.latest_per_key(read(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query(
    "SELECT user_id, event_type, value, gen FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY gen DESC, event_id DESC) AS r FROM (SELECT user_id, event_type, value, event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS gen FROM events)) WHERE r = 1"
)
def upsert_last_wins(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "value", "event_id", F.when(F.col("event_id") % 3 == 0, 1).otherwise(0).alias("gen"))
    return R.upsert(e.filter("gen = 0"), e.filter("gen = 1"), ["user_id", "event_type"], [F.col("event_id")]).drop("event_id")


CACHE = "cache AS (SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 4 = 0)"


@query(f"WITH {CACHE} SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM cache c WHERE c.event_type = e.event_type AND c.user_id = e.user_id)")
def cache_hits(spark, d):
    e = read(spark, d, "events")
    return R.cache_hits(e, e.filter("event_id % 4 = 0"), ["event_type", "user_id"]).select("event_id")


@query(f"WITH {CACHE} SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.event_type = e.event_type AND c.user_id = e.user_id)")
def cache_misses(spark, d):
    e = read(spark, d, "events")
    return R.cache_misses(e, e.filter("event_id % 4 = 0"), ["event_type", "user_id"]).select("event_id")


#: Classes whose short names meet: the number of the part without its last digit.
NAMED = "named AS (SELECT 'class' AS kind, concat('T', p_partkey // 10 + CASE WHEN p_partkey % 10 < 2 THEN 0 ELSE p_partkey * 100 END) AS name, concat('NS::', replace(p_brand, '#', ''), '::T', p_partkey // 10 + CASE WHEN p_partkey % 10 < 2 THEN 0 ELSE p_partkey * 100 END) AS qualified_name FROM part)"


def _named(spark, d):
    key = F.col("p_partkey")
    name = F.concat(F.lit("T"), (F.floor(key / 10).cast("long") + F.when(key % 10 < 2, F.lit(0)).otherwise(key * 100)).cast("string"))
    return read(spark, d, "part").select(F.lit("class").alias("kind"), name.alias("name"), F.concat(F.lit("NS::"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("::"), name).alias("qualified_name"))


@query(
    f"WITH {NAMED}, uniq AS (SELECT name, min(qualified_name) AS q FROM named GROUP BY name HAVING count(DISTINCT qualified_name) = 1) SELECT l_orderkey, l_linenumber, concat('T', l_partkey // 10) AS target_name, uniq.q AS target_qname FROM lineitem LEFT JOIN uniq ON uniq.name = concat('T', l_partkey // 10)"
)
def unique_name_resolve(spark, d):
    rel = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("T"), F.floor(F.col("l_partkey") / 10).cast("string")).alias("target_name"), F.lit(None).cast("string").alias("target_qname"))
    return R.resolve_names(rel, _named(spark, d))


@query(f"WITH {NAMED} SELECT name, count(DISTINCT qualified_name) AS candidates FROM named GROUP BY name HAVING count(DISTINCT qualified_name) > 1")
def ambiguous_names(spark, d):
    return R.ambiguous_names(_named(spark, d))


BARE = "bare AS (SELECT 'class' AS kind, CASE WHEN p_partkey % 3 = 0 THEN concat('C', p_partkey // 3) WHEN p_partkey % 3 = 1 THEN concat(replace(p_brand, '#', ''), '::C', p_partkey // 3) ELSE concat('NS::', replace(p_brand, '#', ''), CASE WHEN p_size < 25 THEN concat('::C', p_partkey // 3) ELSE '::Other' END) END AS qualified_name FROM part)"


def _bare(spark, d):
    key, brand = F.concat(F.lit("::C"), F.floor(F.col("p_partkey") / 3).cast("string")), F.replace("p_brand", F.lit("#"), F.lit(""))
    third = F.col("p_partkey") % 3
    name = F.when(third == 0, F.ltrim(key, F.lit(":"))).when(third == 1, F.concat(brand, key)).otherwise(F.concat(F.lit("NS::"), brand, F.when(F.col("p_size") < 25, key).otherwise("::Other")))
    return read(spark, d, "part").select(F.lit("class").alias("kind"), name.alias("qualified_name"))


@query(
    f"WITH {BARE}, e AS (SELECT DISTINCT kind, qualified_name, string_split(qualified_name, '::') AS s FROM bare) SELECT a.kind, a.qualified_name, min(b.qualified_name) AS merged FROM e a JOIN e b ON a.kind = b.kind AND a.s[-1] = b.s[-1] WHERE len(b.s) > len(a.s) AND b.s[len(b.s) - len(a.s) + 1:] = a.s GROUP BY a.kind, a.qualified_name HAVING count(*) = 1"
)
def suffix_merge(spark, d):
    return R.suffix_merges(_bare(spark, d))


MEMBERS = "member AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'method' ELSE 'field' END AS kind, concat('U', o_custkey) AS parent_qname, concat('f', o_orderkey % 97, '.cxx') AS file_path FROM orders), known AS (SELECT concat('U', c_custkey) AS qualified_name FROM customer WHERE c_custkey % 3 <> 0)"


def _members(spark, d):
    o = read(spark, d, "orders")
    member = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "method").otherwise("field").alias("kind"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("qualified_name"), F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("parent_qname"), F.concat(F.lit("f"), (F.col("o_orderkey") % 97).cast("string"), F.lit(".cxx")).alias("file_path"))
    known = read(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.lit(None).cast("long").alias("id"), F.lit("class").alias("kind"), F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("qualified_name"), F.lit(None).cast("string").alias("parent_qname"), F.lit("f.hxx").alias("file_path"))
    return known.unionByName(member)


@query(f"WITH {MEMBERS} SELECT parent_qname AS qualified_name, arg_min(file_path, id) AS file_path FROM member m WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.qualified_name = m.parent_qname) GROUP BY parent_qname")
def phantom_parents(spark, d):
    return R.phantom_parents(_members(spark, d), [F.col("id")])


@query(f"WITH {MEMBERS} SELECT k.qualified_name, count(m.id) FILTER (m.kind = 'method') AS methods, count(m.id) FILTER (m.kind = 'field') AS fields FROM known k LEFT JOIN member m ON m.parent_qname = k.qualified_name GROUP BY k.qualified_name")
def member_counts_pivot(spark, d):
    return R.member_counts(_members(spark, d))


@query(f"WITH {A.ENT}, {A.REL} SELECT r.src, r.dst, CASE WHEN r.kind IN ('inherits', 'implements') THEN CASE WHEN e.id IS NOT NULL THEN 'implements' ELSE 'inherits' END ELSE r.kind END AS kind, count(*) AS n FROM rel r LEFT JOIN ent e ON e.id = r.dst AND e.kind = 'interface' GROUP BY 1, 2, 3")
def retag_inheritance(spark, d):
    rel = A.relationships(spark, d).withColumnRenamed("dst", "target_qname")
    abstract = A.entities(spark, d).filter("kind = 'interface'").select(F.col("id").alias("qualified_name"))
    return R.retag_inheritance(rel, abstract).groupBy("src", F.col("target_qname").alias("dst"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A.REL} SELECT count(*) AS total, count(*) FILTER (dst IS NULL) AS unresolved, round(avg(CASE WHEN dst IS NULL THEN 100.0 ELSE 0.0 END), 9) AS pct, avg(CASE WHEN dst IS NULL THEN 100.0 ELSE 0.0 END) > 25 AS caution FROM rel")
def unresolved_ratio(spark, d):
    return R.unresolved_ratio(A.relationships(spark, d).withColumnRenamed("dst", "target_qname")).withColumn("pct", F.round("pct", 9))


@query(f"WITH {A.ENT}, {A.REL} SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM rel) AS relationships, (SELECT count(DISTINCT src) FROM rel) AS sources, (SELECT count(DISTINCT kind) FROM ent) AS kinds")
def dashboard_counts(spark, d):
    e = A.entities(spark, d).agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("kind").alias("kinds"))
    r = A.relationships(spark, d).agg(F.count(F.lit(1)).alias("relationships"), F.countDistinct("src").alias("sources"))
    return e.join(F.broadcast(r), how="cross").select("entities", "relationships", "sources", "kinds")  # one row each


@query(
    f"WITH {A.ENT}, {A.REL}, line AS (SELECT concat_ws('|', a.qualified_name, coalesce(b.qualified_name, 'external'), r.kind) AS l FROM rel r JOIN ent a ON a.id = r.src LEFT JOIN ent b ON b.id = r.dst) SELECT sha256(string_agg(l, chr(10) ORDER BY l)) AS fingerprint FROM line"
)
def graph_fingerprint(spark, d):
    _, rels = A.code_graph(spark, d)
    return R.graph_fingerprint(rels)


#: Both tree queries: leaves by three digits of the SHA-256 of the source's name, sums of 48 bits each, then digests of children.
TREE = f"""line AS (SELECT substr(sha256(a.qualified_name), 1, 3) AS node, sha256(concat_ws('|', a.qualified_name, coalesce(b.qualified_name, 'external'), r.kind)) AS h FROM rel r JOIN ent a ON a.id = r.src LEFT JOIN ent b ON b.id = r.dst WHERE {{where}}),
  sums AS (SELECT node, count(*) AS n, {", ".join(f"CAST(sum(CAST(concat('0x', substr(h, {1 + 12 * i}, 12)) AS BIGINT)) AS VARCHAR) AS p{i}" for i in range(4))} FROM line GROUP BY node),
  t3 AS (SELECT 3 AS level, node, n, sha256(concat_ws('|', CAST(n AS VARCHAR), p0, p1, p2, p3)) AS digest FROM sums),
  {", ".join(f"t{d} AS (SELECT {d} AS level, substr(node, 1, {d}) AS node, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(concat(node, ':', digest), ',' ORDER BY node)) AS digest FROM t{d + 1} GROUP BY substr(node, 1, {d}))" for d in (2, 1, 0))}
SELECT * FROM t3 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t0"""


@query(f"WITH {A.ENT}, {A.REL}, {TREE.format(where='true')}")
def fingerprint_tree(spark, d):
    """The hash tree of the graph."""
    return R.fingerprint_tree(A.code_graph(spark, d)[1], "source_qname").select("level", "node", "n", "digest")


@query(f"WITH {A.ENT}, {A.REL}, {TREE.format(where='evidence_line > 5')}")
def fingerprint_refresh(spark, d):
    """A stored tree brought up to date: of the first 400 lines of each file the first five go, and those beyond come."""
    rels = A.code_graph(spark, d)[1]
    old = Scratch(spark, "tree").write(R.fingerprint_tree(rels.filter("evidence_line <= 400"), "source_qname"))
    return R.refreshed_tree(old, rels.filter("evidence_line <= 5"), rels.filter("evidence_line > 400"), "source_qname").select("level", "node", "n", "digest")


@query("SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.quality = 1, true)")
def verifier_fail_open(spark, d):
    verdicts = read(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("is_real"))
    return R.fail_open(read(spark, d, "documents").select("doc_id", "source"), verdicts, ["doc_id"])


@query("SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(2, 6)) AS i FROM documents) WHERE i <= len(string_split(text, chr(10)))")
def source_lines_slice(spark, d):
    return R.source_lines(read(spark, d, "documents").select("doc_id", "text"), "text", 2, 5)


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, regexp_replace(string_split(text, chr(10))[1], '^\\s+|\\s+$', '', 'g') AS first_line FROM documents")
def line_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", X.line_count(F.col("text")).cast("long").alias("n_lines"), X.line_text(F.col("text"), F.lit(0)).alias("first_line"))


URL = "regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1)"


@query(f"SELECT page_id, {URL} AS path FROM pages WHERE NOT list_has_any(string_split({URL}, '/'), ['bundled', 'third_party', 'thirdparty', 'external', 'vendor', 'deps', '_deps', 'fr'])")
def url_vendored_filter(spark, d):
    path = F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1)
    return read(spark, d, "pages").select("page_id", path.alias("path")).filter(~X.is_vendored(F.col("path")) & ~F.array_contains(F.split("path", "/"), "fr"))


@query(f"SELECT module, count(*) AS n FROM (SELECT CASE WHEN instr({URL}, '/') = 0 THEN '(root)' ELSE regexp_replace({URL}, '/[^/]*$', '') END AS module FROM pages) GROUP BY module")
def url_folder_group(spark, d):
    from codestrata.operators.modules import by_folder

    path = F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1)
    return by_folder(read(spark, d, "pages").select("page_id", path.alias("file_path"))).groupBy("module").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json_extract(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("SELECT conv_id, string_agg(concat(role, ':', length(text)), ' ' ORDER BY turn, role, length(text)) AS history, count(*) AS turns FROM conversations GROUP BY conv_id")
def turn_history(spark, d):
    c = read(spark, d, "conversations").select("conv_id", F.struct("turn", "role", F.length("text").alias("n")).alias("t"))
    said = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.concat(t["role"], F.lit(":"), t["n"].cast("string")))
    return c.groupBy("conv_id").agg(F.array_join(said, " ").alias("history"), F.count(F.lit(1)).alias("turns"))


@query("SELECT item_id, sha256(concat('m', chr(0), 's', chr(0), text)) AS prompt_hash FROM benchmark")
def prompt_hashes(spark, d):
    return read(spark, d, "benchmark").select("item_id", X.prompt_hash(F.lit("m"), F.lit("s"), F.col("text")).alias("prompt_hash"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def sql_join_outer(spark, d):
    from codestrata.tools.sql import run_select

    return run_select(spark, "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", {t: read(spark, d, t) for t in ("customer", "orders")})


SETOPS = "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 2"


@query(SETOPS)
def sql_setops(spark, d):
    from codestrata.tools.sql import run_select

    return run_select(spark, SETOPS, {t: read(spark, d, t) for t in ("lineitem", "part")})


WINDOW = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders"


@query(WINDOW)
def sql_window(spark, d):
    from codestrata.tools.sql import run_select

    return run_select(spark, WINDOW, {"orders": read(spark, d, "orders")})


HAVING = "SELECT l_suppkey, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY l_suppkey HAVING count(*) > 10"


@query(HAVING)
def sql_having(spark, d):
    from codestrata.tools.sql import run_select

    return run_select(spark, HAVING, {"lineitem": read(spark, d, "lineitem")})
