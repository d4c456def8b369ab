"""The engine's relations, derived from the tables at hand: as DataFrames, and as SQL for the oracle.

Each derivation is the same rule in both dialects. A relation that a deployment has as a table of its own replaces the
function here; operators only see DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("t"), F.col("user_id") % 4).alias("tenant_id"), "user_id",
        F.when(F.col("event_type") == "purchase", "answer").otherwise("search").alias("source"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "Query ").otherwise("query "), F.col("event_type"), F.lit(" "), (_k() % 20).cast("string")).alias("query_text"),
        (_k() % 5).alias("result_count"), (F.col("value") * 10).cast("int").alias("duration_ms"), (_k() % 7 * 10).alias("vector_candidate_count"), (_k() % 11 * 10).alias("keyword_candidate_count"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("ts").alias("created_at"),
    )


SEARCH_EVENTS = """search_events AS (SELECT event_id AS id, 't' || (user_id % 4) AS tenant_id, user_id,
  CASE WHEN event_type = 'purchase' THEN 'answer' ELSE 'search' END AS source,
  (CASE WHEN event_id % 2 = 0 THEN 'Query ' ELSE 'query ' END) || event_type || ' ' || (k % 20) AS query_text,
  k % 5 AS result_count, CAST(trunc(value * 10) AS INTEGER) AS duration_ms, k % 7 * 10 AS vector_candidate_count, k % 11 * 10 AS keyword_candidate_count,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, ts AS created_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = (_k() * 3 + 7).cast("decimal(20,10)") / F.lit(10000).cast("decimal(20,10)")
    return read(spark, sf_dir, "events").select(
        F.expr("event_id div 3").alias("call_id"), (F.col("event_id") % 3 + 1).cast("int").alias("attempt"), F.concat(F.lit("t"), F.expr("event_id div 3") % 4).alias("tenant_id"),
        F.element_at(F.array(*map(F.lit, ("chat", "embedding", "rerank", "vision"))), (F.expr("event_id div 3") % 4 + 1).cast("int")).alias("operation"),
        F.when(F.expr("event_id div 3") % 5 == 0, "local-hash").otherwise(F.concat(F.lit("model-"), F.expr("event_id div 3") % 3)).alias("model"),
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "cancelled").otherwise("success").alias("call_status"),
        _k().alias("input_tokens"), (_k() * 2).alias("output_tokens"), cost.cast("decimal(20,10)").alias("estimated_cost_usd"),
        (F.col("value") * 10).cast("int").alias("attempt_duration_ms"), (F.col("value") * 25).cast("int").alias("call_duration_ms"),
        F.when(_k() % 3 > 0, (F.col("value") * 2).cast("int")).alias("first_token_duration_ms"), F.concat(F.lit("d"), F.col("user_id") % 20).alias("document_id"), F.col("ts").alias("created_at"),
    )


USAGE_EVENTS = """usage_events AS (SELECT event_id // 3 AS call_id, CAST(event_id % 3 + 1 AS INTEGER) AS attempt, 't' || ((event_id // 3) % 4) AS tenant_id,
  ['chat', 'embedding', 'rerank', 'vision'][(event_id // 3) % 4 + 1] AS operation,
  CASE WHEN (event_id // 3) % 5 = 0 THEN 'local-hash' ELSE 'model-' || ((event_id // 3) % 3) END AS model,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'cancelled' ELSE 'success' END AS call_status,
  k AS input_tokens, k * 2 AS output_tokens, CAST((k * 3 + 7) / 10000 AS DECIMAL(20,10)) AS estimated_cost_usd,
  CAST(trunc(value * 10) AS INTEGER) AS attempt_duration_ms, CAST(trunc(value * 25) AS INTEGER) AS call_duration_ms,
  CASE WHEN k % 3 > 0 THEN CAST(trunc(value * 2) AS INTEGER) END AS first_token_duration_ms, 'd' || (user_id % 20) AS document_id, ts AS created_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.substring(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), "\n", " "), 1, 40)
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.concat(F.lit("t"), F.col("doc_id") % 4).alias("tenant_id"), title.alias("title"), F.when(F.col("doc_id") % 5 == 0, "draft").otherwise("published").alias("status"),
        F.col("source").alias("space_id"), (F.col("doc_id") % 100).alias("folder_id"), F.concat(F.lit("user:"), F.col("doc_id") % 50).alias("created_by"), F.col("lang"), "text", "n_chars",
    )


CATALOG_DOCUMENTS = """catalog_documents AS (SELECT doc_id AS document_id, 't' || (doc_id % 4) AS tenant_id,
  substring(replace(substring(coalesce(text, ''), 1, 60), chr(10), ' '), 1, 40) AS title, CASE WHEN doc_id % 5 = 0 THEN 'draft' ELSE 'published' END AS status,
  source AS space_id, doc_id % 100 AS folder_id, 'user:' || (doc_id % 50) AS created_by, lang, text, n_chars FROM documents)"""


def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "labels")
    return own.select(F.col("doc_id").alias("document_id"), F.explode(F.array(F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic"))).alias("tag"))


DOCUMENT_TAGS = """document_tags AS (SELECT doc_id AS document_id, 'q' || quality AS tag FROM labels UNION ALL SELECT doc_id, 't' || toxic FROM labels)"""


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree over the suppliers."""
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("folder_id"), F.when(F.col("s_suppkey") > 0, F.expr("(s_suppkey - 1) div 2")).alias("parent_id"), F.concat(F.lit("space"), F.col("s_nationkey") % 5).alias("space_id"))


FOLDERS = """folders AS (SELECT s_suppkey AS folder_id, CASE WHEN s_suppkey > 0 THEN (s_suppkey - 1) // 2 END AS parent_id, 'space' || (s_nationkey % 5) AS space_id FROM supplier)"""


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resource_type, resource_id, principal, permission)."""
    doc = read(spark, sf_dir, "documents").filter("doc_id % 7 = 0").select(F.lit("document").alias("resource_type"), F.col("doc_id").cast("string").alias("resource_id"), F.concat(F.lit("user:"), F.col("doc_id") % 30).alias("principal"), F.when(F.col("doc_id") % 2 == 0, "read").otherwise("manage").alias("permission"))
    folder = read(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.lit("folder"), F.col("s_suppkey").cast("string"), F.concat(F.lit("group:"), F.col("s_nationkey")), F.lit("read"))
    space = read(spark, sf_dir, "nation").filter("n_nationkey < 3").select(F.lit("space"), F.concat(F.lit("space"), F.col("n_nationkey")), F.concat(F.lit("role:"), F.col("n_regionkey")), F.lit("read"))
    return doc.union(folder).union(space)


GRANTS = """grants AS (SELECT 'document' AS resource_type, CAST(doc_id AS VARCHAR) AS resource_id, 'user:' || (doc_id % 30) AS principal, CASE WHEN doc_id % 2 = 0 THEN 'read' ELSE 'manage' END AS permission FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT 'folder', CAST(s_suppkey AS VARCHAR), 'group:' || s_nationkey, 'read' FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT 'space', 'space' || n_nationkey, 'role:' || n_regionkey, 'read' FROM nation WHERE n_nationkey < 3)"""


def placed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, folder_id, space_id, owner): documents in the folder tree."""
    own = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("user:"), F.col("doc_id") % 50).alias("owner"), (F.col("doc_id") % 10).alias("folder_id"))
    return own.join(folders(spark, sf_dir).select("folder_id", "space_id"), "folder_id", "left")


PLACED_DOCUMENTS = """placed_documents AS (SELECT doc_id AS document_id, 'user:' || (doc_id % 50) AS owner, doc_id % 10 AS folder_id, f.space_id FROM documents d LEFT JOIN folders f ON f.folder_id = d.doc_id % 10)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks: (chunk_id, document_id, ordinal, content)."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("p", "content"))
    return lines.filter(F.trim("content") != "").select(F.concat_ws(":", F.col("document_id"), F.col("p") + 1).alias("chunk_id"), "document_id", (F.col("p") + 1).cast("long").alias("ordinal"), "content")


CHUNKS = """chunks AS (SELECT document_id || ':' || ordinal AS chunk_id, document_id, ordinal, content FROM (
  SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS ordinal FROM documents) WHERE trim(content) <> '')"""


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 5").alias("document_id"), (F.col("vec_id") % 5 + 1).alias("ordinal"), F.col("embedding").cast("array<double>").alias("embedding"), "label", F.array(F.concat(F.lit("label:"), "label"), F.when(F.col("vec_id") % 3 > 0, "all").otherwise("none")).alias("principals"))


VECTOR_CHUNKS = """vector_chunks AS (SELECT vec_id AS chunk_id, vec_id // 5 AS document_id, vec_id % 5 + 1 AS ordinal, CAST(embedding AS DOUBLE[]) AS embedding, label,
  ['label:' || label, CASE WHEN vec_id % 3 > 0 THEN 'all' ELSE 'none' END] AS principals FROM embeddings)"""


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query): the benchmark items whose id is divisible by 50, as whole texts: a stated query set."""
    return all_text_queries(spark, sf_dir).filter("qid % 50 = 0")


def all_text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query): all benchmark items, as whole texts."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


TEXT_QUERIES = "text_queries AS (SELECT item_id AS qid, text AS query FROM benchmark WHERE item_id % 50 = 0)"


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query_vector): every vector whose id is divisible by 50."""
    return vector_chunks(spark, sf_dir).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("query_vector"))


VECTOR_QUERIES = "vector_queries AS (SELECT chunk_id AS qid, embedding AS query_vector FROM vector_chunks WHERE chunk_id % 50 = 0)"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
