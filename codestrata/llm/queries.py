"""The operators' queries over the driver's tables, with production parameters, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import delta_lloyd, langid, lm, mixing, piece, pstable, secret_scan, sharding, simhash, toxicity, warc, weighted_lloyd
from codestrata.llm.text import bounded_batches
from codestrata.session import read_table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded again."""
    bounded_batches(spark)
    vocabulary = piece.Vocabulary.load()
    coded = read_table(spark, sf_dir, "documents").select("doc_id", piece.encode_checked(F.col("text"), vocabulary).alias("c"))
    return coded.select("doc_id", F.size("c.ids").cast("long").alias("n_tokens"), "c.ids", "c.round_trip")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component at 4 differing bits."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every vector whose id is divisible by 50, among all other vectors."""
    return pstable.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document, learned from those whose crc32(doc_id) modulo 7 is not 2."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm.score(read_table(spark, sf_dir, "documents"), ~held)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32(doc_id) is not divisible by 5."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid_held_out("doc_id").alias("held_out"))
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_id.lang_pred", "lang_id.score")


def langid_held_out(id_col: str):
    """True where crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the contract's weights; one row per document."""
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, found through the capture index and read back."""
    return warc.archive_and_read(read_table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the secrets found in them."""
    return secret_scan.scan_documents(read_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links at cosine 0.95 and their component."""
    return pstable.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of near equal bytes."""
    return sharding.shard_records(read_table(spark, sf_dir, "documents"), 8)


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 16 clusters after 3 rounds."""
    return weighted_lloyd.cluster(read_table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as 16 codes of 64 entries after 2 rounds."""
    return delta_lloyd.compress(read_table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labelled ones whose crc32(doc_id) modulo 4 is not 2."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    lexicon = toxicity.train(docs.filter(~F.col("held_out")), read_table(spark, sf_dir, "labels").filter(~held))
    bounded_batches(spark)
    found = docs.select("doc_id", "held_out", toxicity.toxicity(F.col("text"), lexicon).alias("t"))
    return found.select("doc_id", "held_out", "t.score", (F.col("t.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "t.terms")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_simhash, op3_ann, op4_lm_score, op5_language_id, op6_entropy_mixing, op7_warc, op8_secret_scan, op9_embedding_dedup, op10_virtual_slots, op11_clustering, op12_vector_codes, op13_toxicity)}
#: SHA-1 in base 32: five bits at a time out of two neighbouring hexadecimal digits.
BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((instr('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1) * 16
    + instr('0123456789abcdef', substr(h, 2 + (5 * i) // 4, 1)) - 1) >> (3 - (5 * i) % 4)) % 32, 1)), '')"""
def _clustering_sql(k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64) -> str:
    """Lloyd's rounds written out one after the other, on doubles that hold whole numbers."""
    ctes = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY m) - 1 AS k, q AS c FROM (SELECT sha256(concat('1:', vec_id)) AS m, q FROM v ORDER BY m LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min(struct_pack(d := d, k := k)) AS m FROM (SELECT vec_id, q, k, list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c) AS d FROM v, c{r}) GROUP BY vec_id)")
        if r < rounds:
            ctes.append(f"m{r} AS (SELECT k, list(floor(s / n) ORDER BY i) AS c FROM (SELECT m.k AS k, i, sum(q[i]) AS s, count(*) AS n FROM a{r}, range(1, {dim + 1}) t(i) GROUP BY m.k, i) GROUP BY k)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))")
    return f"""WITH {", ".join(ctes)} SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = m.k"""


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, width: int = 4) -> str:
    ctes = [
        f"v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, label, p, q[p * {width} + 1 : (p + 1) * {width}] AS q FROM v, range(0, {parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, q AS c FROM x JOIN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(label) AS label, any_value(q) AS q, min(struct_pack(d := d, k := k)) AS m FROM (SELECT vec_id, label, p, q, k, list_inner_product(q, q) - 2 * list_inner_product(q, c) + list_inner_product(c, c) AS d FROM x JOIN c{r} USING (p)) GROUP BY vec_id, p)")
        if r < rounds:
            ctes.append(f"m{r} AS (SELECT p, k, list(floor(s / n) ORDER BY i) AS c FROM (SELECT p, m.k AS k, i, sum(q[i]) AS s, count(*) AS n FROM a{r}, range(1, {width + 1}) t(i) GROUP BY p, m.k, i) GROUP BY p, k)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (p, k))")
    return f"""WITH {", ".join(ctes)}, coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(m.k AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256 FROM coded"""


ORACLES: dict[str, str] = {
    "op11_clustering": _clustering_sql(),
    "op12_vector_codes": _codes_sql(),
    "op7_warc": f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
  o AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to FROM o""",
    "op9_embedding_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
  reach(u, v) AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v),
  found AS (SELECT vec_id, (SELECT count(*) FROM link WHERE u = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(r.v) FROM reach r WHERE r.u = vec_id), vec_id)) AS component_id FROM v)
SELECT *, vec_id = component_id AS kept FROM found""",
}
