"""The registered queries of this subpackage: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hnsw, mih, mixing, pii, quality, secrets, simhash, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), bpe.public_tokenizer())


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_once(table(spark, sf_dir, "documents")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_byte_bpe, op3_secret_scan, op4_warc, op5_quality_classifier, op6_simhash_near_dedup, op7_source_mixing, op8_toxicity, op9_personal_data, op10_exact_top_k)}


def _found(kind: str, pattern: str, least: str = "TRUE") -> str:
    """SQL for the matches of a pattern: code points before a match are those of the gaps and matches before it."""
    return f"""SELECT doc_id, '{kind}' AS kind, begun AS start, begun + length(m) AS "end" FROM (SELECT doc_id, m, CAST(sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begun
 FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}', 0)) AS m, unnest(list_slice(regexp_split_to_array(t, '{pattern}'), 1, -2)) AS g, unnest(range(len(regexp_extract_all(t, '{pattern}', 0)))) AS i FROM texts WHERE regexp_matches(t, '{pattern}'))
 WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE {least}"""


_ASSIGN = """((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""".replace("\\\\", "\\")
_KINDS = ("assign", "access", "hex", "pem", "jwt")
_SECRETS = " UNION ALL ".join([
    _found("assign", _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 8"), _found("access", "AKIA[A-Z0-9]{12,}"), _found("hex", "[0-9a-f]{32,}"),
    _found("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), _found("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"),
])
_LISTED = "kind || ':' || start || ':' || \"end\""
_ORDER = "ORDER BY start, list_position(['assign', 'access', 'hex', 'pem', 'jwt'], kind), \"end\""
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ORACLES = {
    "op3_secret_scan": f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({_SECRETS}),
 f AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _KINDS[:3])}, string_agg({_LISTED}, ',' {_ORDER}) FILTER (kind IN ('assign', 'access', 'hex')) AS base, string_agg({_LISTED}, ',' {_ORDER}) AS spans FROM s GROUP BY doc_id)
 SELECT doc_id, {', '.join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in _KINDS[:3])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob FROM texts LEFT JOIN f USING (doc_id)""",
    "op4_warc": f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages), m AS (SELECT x, max(page_id) AS last FROM p GROUP BY x)
 SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: '{_BASE32}'[1 + CAST((CAST('0x' || substr(x, CAST(1 + i // 4 * 5 AS INT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT)]), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p JOIN m USING (x)""",
    "op7_source_mixing": """WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
 k AS (SELECT doc_id, source, size, md5(t) AS h, greatest(0.5, 2.0 - abs(length(t) / greatest(size, 1)::DOUBLE - 6.0) / 4.0) AS weight FROM d),
 o AS (SELECT *, -ln((CAST('0x' || substr(md5('20|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || h), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0) / weight AS key FROM k),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 w AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, sum(source_size) OVER ()::DOUBLE AS total FROM s),
 r AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio, coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0) AS capped, sum(w) OVER a AS open FROM w WHERE source_size > 0
  WINDOW b AS (ORDER BY 3.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY 3.0::DOUBLE * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 l AS (SELECT arg_min((total - capped) / open, ratio) AS level FROM r WHERE (total - capped) / open <= ratio),
 t AS (SELECT w.source, w.source_size, CASE WHEN w.source_size = 0 THEN 0 ELSE least(3.0::DOUBLE * w.source_size, coalesce(level, 1e300) * w) END AS target FROM w LEFT JOIN l ON TRUE),
 e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
 x AS (SELECT *, greatest(0, CAST(round_even(target, 0) AS BIGINT) - epochs * source_size) AS rest FROM e),
 q AS (SELECT o.doc_id, o.size, x.source_size, x.target, epochs, rest, coalesce(sum(o.size) OVER (PARTITION BY o.source ORDER BY key, doc_id, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o JOIN x ON o.source IS NOT DISTINCT FROM x.source)
 SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM q""",
    "op1_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
 r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT e.b AS id, r.root FROM r JOIN e ON r.id = e.a),
 c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id), n AS (SELECT a AS id, count(*) AS n FROM e GROUP BY a)
 SELECT c.id AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n USING (id)""",
    "op10_exact_top_k": """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings),
 d AS (SELECT q.id AS query_id, v.id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.s) + 1), lambda i: CASE WHEN q.s[i] <> v.s[i] THEN 1 ELSE 0 END)) AS INT) AS distance
 FROM v q JOIN v ON q.id % 20 = 0 AND q.id <> v.id AND len(q.s) = len(v.s)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
 SELECT query_id, CAST(rank AS INT) AS rank, vec_id, distance FROM r WHERE rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express at the size of a test; the others are tested against plain versions."""
    return ORACLES
