"""Workflows as tables: outbox, recovery after a restore, publication, reviews, settings, enrichment replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the outbox and of error and picture kinds.
CLAIM, LEASE_MINUTES, MAX_ATTEMPTS = 20, 5, 10
ERROR_CODES = {
    "ModelGatewayUnavailableError": "model_gateway_unavailable",
    "ModelGatewayOverloadedError": "model_gateway_overloaded",
    "ModelGatewayRateLimitError": "model_rate_limited",
    "ModelBudgetExceededError": "model_budget_exceeded",
    "ModelHttpError": "model_http_error",
    "TimeoutError": "model_timeout",
}
PICTURE_KINDS = ("chart", "diagram", "table", "document", "photo", "decorative", "other")


def release_expired(events: DataFrame, now: Column) -> DataFrame:
    """Events whose lease ran out wait again."""
    expired = F.coalesce((F.col("status") == "processing") & (F.col("locked_at") < now - F.make_interval(mins=F.lit(LEASE_MINUTES))), F.lit(False))
    return events.withColumns({"status": F.when(expired, "pending").otherwise(F.col("status")), "locked_at": F.when(~expired, F.col("locked_at"))})


def claimable(events: DataFrame, now: Column, size: int = CLAIM) -> DataFrame:
    """The oldest due events, one claim's worth."""
    return events.filter((F.col("status") == "pending") & (F.col("next_attempt_at") <= now)).orderBy("created_at", "id").limit(size)


def after_failure(events: DataFrame, now: Column) -> DataFrame:
    """Events after one more failed delivery: dead after MAX_ATTEMPTS, else due again after the back-off."""
    from quern.functions.numbers import backoff_ms

    n = F.col("attempts") + 1
    wait = F.make_dt_interval(secs=(backoff_ms(n) / 1000).cast("decimal(18,6)"))
    return events.withColumns({"status": F.when(n >= MAX_ATTEMPTS, "dead").otherwise("pending"), "next_attempt_at": now + wait, "attempts": n})


def recover_jobs(jobs: DataFrame) -> DataFrame:
    """After a restore: what was under way is queued from its beginning."""
    lost = F.col("status").isin("queued", "active")
    return jobs.withColumns({"progress": F.when(lost, 0).otherwise(F.col("progress")), "status": F.when(lost, "queued").otherwise(F.col("status"))})


def recover_outbox(events: DataFrame, jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, status, attempts): ingestion events of queued jobs and cleanup events of deleted, unpurged documents wait anew."""
    queued = jobs.filter("status = 'queued'").select(F.col("version_id").cast("string").alias("v")).distinct()
    deleted = documents.filter("deleted and not purged").select(F.col("document_id").cast("string").alias("d")).distinct()
    own = events.withColumn("v", F.get_json_object("payload", "$.documentVersionId")).withColumn("d", F.get_json_object("payload", "$.documentId"))
    own = own.join(queued.withColumn("is_queued", F.lit(True)), "v", "left").join(deleted.withColumn("is_deleted", F.lit(True)), "d", "left")
    again = (F.col("status") != "cancelled") & (((F.col("event_type") == "document.ingestion.requested") & F.coalesce("is_queued", F.lit(False))) | ((F.col("event_type") == "document.cleanup.requested") & F.coalesce("is_deleted", F.lit(False))))
    return own.select("id", F.when(again, "pending").otherwise(F.col("status")).alias("status"), F.when(again, 0).otherwise(F.col("attempts")).alias("attempts"))


def publication(versions: DataFrame, reviews: DataFrame) -> DataFrame:
    """(version_id, refusal): why a version can't be published directly; null where it can."""
    pending = reviews.filter("status = 'pending'").select("document_id", F.lit(True).alias("pending")).distinct()
    refusal = F.when(F.col("ingestion_status") != "ready", "not_ready").when(F.col("quality_status") == "review", "quality_review_required").when(F.col("pending"), "review_pending")
    return versions.join(pending, "document_id", "left").select("version_id", refusal.alias("refusal"))


def job_id(*parts: Column) -> Column:
    """Deterministic name of a queued job: its parts joined by dashes."""
    return F.concat_ws("-", *(p.cast("string") for p in parts))


def error_code(status: Column, name: Column, code: Column) -> Column:
    """Normalised code of a failed or cancelled run."""
    named = F.coalesce(*(F.when(name == k, F.lit(v)) for k, v in ERROR_CODES.items()))
    plain = F.when((F.length(code) <= 128) & code.rlike("^[A-Za-z0-9_.-]+$"), F.lower(code))
    return F.when(status == "cancelled", "request_cancelled").when(name.isNull(), "answer_failed").otherwise(F.coalesce(named, plain, F.lit("answer_failed")))


def vision_reply(reply: Column) -> Column:
    """Struct (kind, description, searchable, confidence) of a model's JSON, or of its text where it holds none."""
    inner = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    v = F.from_json(inner, "kind string, description string, searchable boolean, confidence double")
    described = F.length(F.trim(v["description"])) > 0
    kind = F.when(v["kind"].isin(*PICTURE_KINDS), v["kind"]).otherwise("other")
    full = F.struct(kind.alias("kind"), F.trim(v["description"]).alias("description"), F.coalesce(v["searchable"], F.lit(True)).alias("searchable"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), v["confidence"])).alias("confidence"))
    bare = F.struct(F.lit("other").alias("kind"), F.trim(reply).alias("description"), (F.trim(reply) != "").alias("searchable"), F.lit(None).cast("double").alias("confidence"))
    return F.when(F.coalesce(described, F.lit(False)), full).otherwise(bare)


def asset_placeholder(markdown: Column, reference: Column) -> Column:
    """Lost assets' references by a mark of the same length, so that offsets hold."""
    n = F.length(reference) - 1
    mark = F.concat(F.lit("#"), F.substring(F.rpad(F.lit("asset-unavailable"), 4096, "-"), F.lit(1), n))
    return F.replace(markdown, reference, mark)


def members(roles: DataFrame, user_roles: DataFrame) -> DataFrame:
    """(role_id, n, members): distinct members in order, joined by commas; roles without any too."""
    own = user_roles.groupBy("role_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("user_id")), lambda x: x.cast("string")), ",").alias("members"), F.count_distinct("user_id").alias("n"))
    return roles.join(own, "role_id", "left").select("role_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("members", F.lit("")).alias("members"))


def stages(**by_name: DataFrame) -> DataFrame:
    """(stage, qid, chunk_id, rank) of all stages of a search: what its diagnostics show."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("stage"), "qid", "chunk_id", "rank") for name, df in by_name.items()))


def embedding_gate(spent: DataFrame, call_usd: Column, daily: float, monthly: float, action: str) -> DataFrame:
    """(tenant_id, allowed): on ingestion both 'degrade' and 'reject' stop what 'warn' lets pass."""
    over = (F.col("day_usd") + call_usd > daily) | (F.col("month_usd") + call_usd > monthly)
    return spent.select("tenant_id", (~over | F.lit(action == "warn")).alias("allowed"))


def attach_last(tables: DataFrame, elements: DataFrame) -> DataFrame:
    """(page, kind, position, path): tables after a page's elements, in their order, under the last section path there."""
    last = elements.groupBy("page").agg(F.max("position").alias("top"), F.max_by("path", "position").alias("path"))
    w = Window.partitionBy("page").orderBy("table_no")
    own = tables.withColumn("n", F.row_number().over(w)).join(last, "page", "left")
    return elements.select("page", F.lit("text").alias("kind"), "position", "path").unionByName(own.select("page", F.lit("table").alias("kind"), (F.coalesce("top", F.lit(0)) + F.col("n")).alias("position"), "path"))
