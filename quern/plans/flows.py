"""Queries over gates of model calls, projections rebuilt and kept up to date, and answer runs with their outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans import bindings as B
from quern.plans.scratch import folder
from quern.sources import projections as J
from quern.streaming import gates

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _events(spark, sf_dir):
    own = gates.session(spark)
    schema = own.read.parquet(f"{sf_dir}/events.parquet").schema
    events = own.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}/")
    return events.select(F.concat(F.lit("t"), F.col("user_id") % 4).alias("gate"), F.col("event_id").alias("id"), "ts", "event_type", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _drained(spark, stream):
    from quern.streaming.state import drain

    base = folder(spark, "stream")
    out = drain(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query()
def stream_gates(spark, sf_dir):
    """Every event is a call of its tenant, or, where it is an error, settles the event before it."""
    e = _events(spark, sf_dir)
    settles = F.col("event_type") == "error"
    entries = gates.quota_entries(F.lit("chat"), F.concat(F.lit("m"), F.col("user_id") % 3), F.col("gate"), F.col("user_id").cast("string"), F.col("k"), {"requests": 40, "all": 3000, "tenant": 2000, "user": 400, "model": 1500})
    rows = e.select("gate", "id", "ts", F.when(settles, "settle").otherwise("reserve").alias("kind"), entries.alias("entries"), F.when(settles, F.col("id") - 1).alias("reservation"), F.col("k").alias("tokens"))
    return _drained(spark, gates.quotas(rows, 3600)).select("gate", "id", "admitted", "retry_ms")


@query()
def stream_circuits(spark, sf_dir):
    """Even events ask for a call of their tenant; odd ones report on the event before, errors as failures."""
    e = _events(spark, sf_dir)
    kind = F.when(F.col("id") % 2 == 0, "acquire").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "release").otherwise("succeed")
    return _drained(spark, gates.breakers(e.select("gate", "id", "ts", kind.alias("kind"), (F.col("id") - F.col("id") % 2).alias("permit"))))


def _documents(spark, sf_dir):
    own = B.catalog_documents(spark, sf_dir)
    version = F.when(F.col("document_id") % 11 > 0, F.concat(F.lit("v"), F.col("document_id")))
    return own.select("tenant_id", "document_id", version.alias("current_version_id"), "status", (F.col("document_id") % 13 == 0).alias("deleted"), (F.col("document_id") % 3).cast("int").alias("acl_version"), "lang")


def _rebuilt(spark, sf_dir):
    own = B.catalog_documents(spark, sf_dir)
    versions = own.select("tenant_id", "document_id", F.concat(F.lit("v"), F.col("document_id")).alias("version_id"), F.when(F.col("document_id") % 9 == 4, "failed").otherwise("ready").alias("ingestion_status"), F.col("text").alias("markdown"))

    def lines(live):
        each = live.select("tenant_id", "document_id", F.posexplode(F.split("markdown", "\n", -1)).alias("ordinal", "text"))
        return each.select("tenant_id", "document_id", F.col("ordinal").cast("long").alias("ordinal"), F.sha2("text", 256).alias("sha256"))

    projection = J.Projection(spark, folder(spark, "projection"), {"chunks": "tenant_id string, document_id long, ordinal long, sha256 string"})
    J.rebuild(projection, "chunks", versions, _documents(spark, sf_dir), lines)
    return projection


_CHUNKS = """chunks AS (SELECT tenant_id, document_id, unnest(string_split(text, chr(10))) AS t, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS ordinal FROM catalog_documents
  WHERE status = 'published' AND document_id % 13 <> 0 AND document_id % 11 > 0 AND document_id % 9 <> 4 AND text IS NOT NULL)"""


@query(B.with_(B.CATALOG_DOCUMENTS, _CHUNKS) + "SELECT tenant_id, document_id, ordinal, sha256(t) AS sha256 FROM chunks")
def rebuilt_projection(spark, sf_dir):
    """Chunks of all current versions, built anew and published, as a reader sees them."""
    return _rebuilt(spark, sf_dir).read("chunks").drop("part")


@query(B.with_(B.CATALOG_DOCUMENTS, _CHUNKS, """touched AS (SELECT tenant_id, document_id, status, document_id % 11 > 0 AS has, lang FROM catalog_documents WHERE document_id % 3 = 1 AND document_id % 13 <> 0)""") + """
SELECT tenant_id, document_id, ordinal, sha256(t) AS sha256 FROM chunks WHERE document_id NOT IN (SELECT document_id FROM touched)
UNION ALL SELECT tenant_id, document_id, 0, sha256(lang) FROM touched WHERE status = 'published' AND has""")
def access_projection(spark, sf_dir):
    """The projection after a batch of access changes, delivered twice: a third of the documents is indexed anew, by what
    their readers may see (here: the language), or removed."""
    projection, docs = _rebuilt(spark, sf_dir), _documents(spark, sf_dir)
    jobs = docs.filter("document_id % 3 = 1").select("tenant_id", "document_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("acl_version"))
    indexed = lambda own: own.select("tenant_id", "document_id", F.lit(0).cast("long").alias("ordinal"), F.sha2("lang", 256).alias("sha256"))
    for _ in range(2):
        J.project_access(projection, "chunks", jobs, docs, indexed, batch=1)
    return projection.read("chunks").drop("part")


@query("""WITH o AS (SELECT user_id AS run_id, event_id AS outcome_id, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'cancel' END AS kind, ts FROM events),
first AS (SELECT * FROM o WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts, outcome_id) = 1)
SELECT run_id, outcome_id, CASE kind WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'cancelled' END AS status FROM first WHERE run_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 > 0)""")
def run_outcomes(spark, sf_dir):
    """Customers are runs, three quarters of them running; events end them."""
    runs = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("t").alias("tenant_id"), F.when(F.col("c_custkey") % 4 > 0, "running").otherwise("cancelled").alias("status"))
    kind = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "cancel")
    outcomes = B.read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.lit("t").alias("tenant_id"), F.col("event_id").alias("outcome_id"), kind.alias("kind"), "ts")
    return J.decided_runs(runs, outcomes).drop("tenant_id")
