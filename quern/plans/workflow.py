"""Queries over outboxes, reviews, roles, error codes and search diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import governance as G
from quern.operators import retrieval as R
from quern.operators import workflow as W
from quern.plans import bindings as B
from quern.sources import sinks

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _outbox(spark, sf_dir):
    e = F.col("event_id")
    return B.read(spark, sf_dir, "events").select(
        e.alias("id"), F.element_at(F.array(*map(F.lit, ("pending", "processing", "published", "cancelled"))), (e % 4 + 1).cast("int")).alias("status"), (e % 12).cast("int").alias("attempts"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("next_attempt_at"),
        F.when(e % 4 == 1, F.col("ts")).alias("locked_at"), F.when(e % 3 == 0, "document.cleanup.requested").otherwise("document.ingestion.requested").alias("event_type"), F.to_json(F.struct((e % 700).cast("string").alias("documentVersionId"), (e % 300).cast("string").alias("documentId"))).alias("payload"),
    )


_OUTBOX = """outbox AS (SELECT event_id AS id, ['pending', 'processing', 'published', 'cancelled'][event_id % 4 + 1] AS status, CAST(event_id % 12 AS INTEGER) AS attempts, ts AS created_at, ts + INTERVAL 1 HOUR AS next_attempt_at,
  CASE WHEN event_id % 4 = 1 THEN ts END AS locked_at, CASE WHEN event_id % 3 = 0 THEN 'document.cleanup.requested' ELSE 'document.ingestion.requested' END AS event_type, event_id % 700 AS version_id, event_id % 300 AS document_id FROM events)"""
_NOW = "TIMESTAMP '2024-01-15 00:00:00'"


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")


@query(B.with_(_OUTBOX) + f"SELECT id, CASE WHEN status = 'processing' AND locked_at < {_NOW} - INTERVAL 5 MINUTE THEN 'pending' ELSE status END AS status, CASE WHEN status = 'processing' AND locked_at < {_NOW} - INTERVAL 5 MINUTE THEN NULL ELSE locked_at END AS locked_at FROM outbox")
def outbox_release(spark, sf_dir):
    return W.release_expired(_outbox(spark, sf_dir), _now()).select("id", "status", "locked_at")


@query(B.with_(_OUTBOX) + f"SELECT id, created_at FROM outbox WHERE status = 'pending' AND next_attempt_at <= {_NOW} ORDER BY created_at, id LIMIT 20")
def outbox_claim(spark, sf_dir):
    return W.claimable(_outbox(spark, sf_dir), _now()).select("id", "created_at")


@query(B.with_(_OUTBOX) + f"SELECT id, CASE WHEN attempts + 1 >= 10 THEN 'dead' ELSE 'pending' END AS status, attempts + 1 AS attempts, {_NOW} + to_milliseconds(CAST(least(60000, 1000 * pow(2, attempts)) AS BIGINT)) AS next_attempt_at FROM outbox WHERE status = 'processing'")
def outbox_retry(spark, sf_dir):
    return W.after_failure(_outbox(spark, sf_dir).filter("status = 'processing'"), _now()).select("id", "status", "attempts", "next_attempt_at")


@query(B.with_(_OUTBOX, "jobs AS (SELECT o_orderkey AS version_id, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'queued' ELSE 'completed' END AS status FROM orders)", "docs AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 > 0)",
  """a AS (SELECT *, status <> 'cancelled' AND ((event_type = 'document.ingestion.requested' AND version_id IN (SELECT version_id FROM jobs WHERE status = 'queued')) OR (event_type = 'document.cleanup.requested' AND document_id IN (SELECT doc_id FROM docs))) AS again FROM outbox)""")
  + "SELECT id, CASE WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN again THEN 0 ELSE attempts END AS attempts FROM a")
def outbox_recover(spark, sf_dir):
    jobs = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("version_id"), F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "queued").otherwise("completed").alias("status"), F.lit(40).alias("progress"))
    docs = B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 2 == 0).alias("deleted"), (F.col("doc_id") % 3 == 0).alias("purged"))
    return W.recover_outbox(_outbox(spark, sf_dir), W.recover_jobs(jobs), docs)


@query("""WITH r AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT doc_id * 10 + 1 AS version_id, CASE WHEN doc_id % 4 = 0 THEN 'not_ready' WHEN n_chars < 100 THEN 'quality_review_required' WHEN doc_id IN (SELECT doc_id FROM r) THEN 'review_pending' END AS refusal FROM documents""")
def publication_check(spark, sf_dir):
    d = F.col("doc_id")
    versions = B.read(spark, sf_dir, "documents").select(d.alias("document_id"), (d * 10 + 1).alias("version_id"), F.when(d % 4 == 0, "parsing").otherwise("ready").alias("ingestion_status"), F.when(F.col("n_chars") < 100, "review").otherwise("ready").alias("quality_status"))
    reviews = B.read(spark, sf_dir, "labels").select(d.alias("document_id"), F.when(F.col("toxic") == 1, "pending").otherwise("approved").alias("status"))
    return W.publication(versions, reviews)


@query("""SELECT event_id AS id, CASE WHEN event_type = 'signup' THEN 'request_cancelled' WHEN event_type = 'view' THEN 'answer_failed' WHEN event_type = 'click' THEN 'model_timeout' WHEN event_type = 'error' THEN 'e_' || (event_id % 7) ELSE 'answer_failed' END AS code FROM events""")
def error_codes(spark, sf_dir):
    kind = F.col("event_type")
    name = F.when(kind == "view", F.lit(None)).when(kind == "click", "TimeoutError").otherwise("Error")
    code = F.when(kind == "error", F.concat(F.lit("E_"), F.col("event_id") % 7)).otherwise("not a code")
    return B.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), W.error_code(F.when(kind == "signup", "cancelled").otherwise("failed"), name, code).alias("code"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'chart' ELSE 'other' END AS kind, CASE WHEN event_id % 3 = 2 THEN event_type ELSE 'a ' || event_type END AS description, event_id % 3 <> 1 AS searchable, CASE WHEN event_id % 3 < 2 THEN least(100, value) END::DOUBLE AS confidence FROM events""")
def vision_replies(spark, sf_dir):
    e, t = F.col("event_id"), F.col("event_type")
    body = F.concat(F.lit('reply: {"kind": "'), F.when(e % 3 == 0, "chart").otherwise("poem"), F.lit('", "description": " a '), t, F.lit(' ", "searchable": '), F.when(e % 3 == 1, "false").otherwise("true"), F.lit(', "confidence": '), F.col("value").cast("string"), F.lit("} end"))
    own = B.read(spark, sf_dir, "events").select(e.alias("id"), W.vision_reply(F.when(e % 3 == 2, F.concat(F.lit(" "), t)).otherwise(body)).alias("v"))
    return own.select("id", "v.kind", "v.description", "v.searchable", "v.confidence")


@query("""SELECT page_id AS id, replace('see ' || r || ' twice ' || r, r, '#' || substring('asset-unavailable' || repeat('-', 4000), 1, length(r) - 1)) AS markdown FROM (SELECT page_id, 'asset://img-' || page_id || '.png' AS r FROM pages)""")
def asset_placeholders(spark, sf_dir):
    r = F.concat(F.lit("asset://img-"), "page_id", F.lit(".png"))
    return B.read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), W.asset_placeholder(F.concat(F.lit("see "), r, F.lit(" twice "), r), r).alias("markdown"))


@query("SELECT n_nationkey AS role_id, count(DISTINCT c_custkey) AS n, coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey), '') AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def role_members(spark, sf_dir):
    own = B.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("role_id"), F.col("c_custkey").alias("user_id"))
    return W.members(B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("role_id")), own)


@query("SELECT conv_id, sha256(string_agg(turn || ':' || sha256(text), chr(10) ORDER BY turn)) AS checksum FROM conversations GROUP BY conv_id")
def conversation_checksums(spark, sf_dir):
    line = F.concat(F.col("turn").cast("string"), F.lit(":"), F.sha2("text", 256))
    return sinks.checksums(B.read(spark, sf_dir, "conversations"), ["conv_id"], "turn", line)


@query("SELECT doc_id AS document_id, CASE doc_id % 3 WHEN 0 THEN doc_id || '-2' WHEN 1 THEN 'cleanup-' || doc_id ELSE 'acl-' || doc_id || '-' || (doc_id % 5) END AS job_id FROM documents")
def queue_job_ids(spark, sf_dir):
    d = F.col("doc_id")
    own = F.when(d % 3 == 0, W.job_id(d, F.lit(2))).when(d % 3 == 1, W.job_id(F.lit("cleanup"), d)).otherwise(W.job_id(F.lit("acl"), d, d % 5))
    return B.read(spark, sf_dir, "documents").select(d.alias("document_id"), own.alias("job_id"))


@query(B.with_(B.VECTOR_CHUNKS, B.VECTOR_QUERIES, "r AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(query_vector, embedding), 6) DESC, chunk_id) AS rank FROM vector_queries, vector_chunks WHERE qid <> chunk_id)")
       + "SELECT 'vector' AS stage, qid, chunk_id, rank FROM r WHERE rank <= 10 UNION ALL SELECT 'selected', qid, chunk_id, rank FROM r WHERE rank <= 3")
def search_diagnostics(spark, sf_dir):
    near = R.nearest_in_blocks(B.vector_chunks(spark, sf_dir), B.vector_queries(spark, sf_dir), 10)
    return W.stages(vector=near, selected=near.filter("rank <= 3"))


@query(B.with_(B.USAGE_EVENTS, "s AS (SELECT tenant_id, round(CAST(coalesce(sum(estimated_cost_usd) FILTER (WHERE created_at >= TIMESTAMP '2024-01-20'), 0) AS DOUBLE), 6) AS day_usd, round(CAST(sum(estimated_cost_usd) AS DOUBLE), 6) AS month_usd FROM usage_events WHERE created_at <= TIMESTAMP '2024-01-20 15:30:00' GROUP BY 1)")
       + "SELECT tenant_id, NOT (day_usd + 0.05 > 1.0 OR month_usd + 0.05 > 8.9) AS allowed FROM s")
def ingestion_budget_gate(spark, sf_dir):
    spent = G.budget_usage(B.usage_events(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-01-20 15:30:00'"))
    return W.embedding_gate(spent, F.lit(0.05), 1.0, 8.9, "degrade")


@query("""WITH e AS (SELECT conv_id AS page, turn AS position, role AS path FROM conversations), l AS (SELECT page, max(position) AS top, max_by(path, position) AS path FROM e GROUP BY page), t AS (SELECT doc_id % 40 AS page, doc_id AS table_no FROM labels)
SELECT page, 'text' AS kind, position, path FROM e UNION ALL SELECT t.page, 'table', coalesce(top, 0) + row_number() OVER (PARTITION BY t.page ORDER BY table_no), path FROM t LEFT JOIN l USING (page)""")
def attached_tables(spark, sf_dir):
    elements = B.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("position"), F.col("role").alias("path"))
    tables = B.read(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("page"), F.col("doc_id").alias("table_no"))
    return W.attach_last(tables, elements)


@query("SELECT o_custkey AS key, max(o_orderkey) AS version FROM orders WHERE o_orderkey % 2 = 0 OR o_custkey % 3 = 0 GROUP BY 1")
def embedding_cache_upsert(spark, sf_dir):
    own = B.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"))
    some = own.filter("version % 2 = 0 or key % 3 = 0")
    last = some.groupBy("key").agg(F.max("version").alias("version"))
    return sinks.upsert(some, last, ["key"], F.desc("version"))
