"""Governance analytics: search quality, feedback, model usage, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import call_cost, half_up, ratio, resolve_price


def trailing(events: DataFrame, days: int, as_of: Column | None = None, ts: str = "created_at") -> DataFrame:
    """Events of the last days before as_of; by default before the last event, so that results can be repeated."""
    as_of = events.agg(F.max(ts)).scalar() if as_of is None else as_of
    return events.filter(F.col(ts) >= as_of - F.make_interval(days=F.lit(days)))


def search_summary(events: DataFrame) -> DataFrame:
    """One row: counts by outcome and source, mean and 95th percentile of the latency, rate of empty results over all."""
    done = F.col("status") == "completed"
    empty = done & (F.col("result_count") == 0)
    out = events.agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(empty).alias("zero_results"), F.count_if(F.col("source") == "answer").alias("answers"),
        F.avg("duration_ms").alias("mean_ms"), F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY duration_ms)").alias("p95"), F.avg(F.when(done, F.col("result_count"))).alias("mean_results"),
    )
    return out.select("total", "completed", "failed", "zero_results", "answers", half_up(F.coalesce("mean_ms", F.lit(0.0)), 2).alias("mean_ms"), half_up(F.coalesce("p95", F.lit(0.0)), 2).alias("p95_ms"), half_up(F.coalesce("mean_results", F.lit(0.0)), 2).alias("mean_results"), half_up(ratio(F.col("zero_results"), F.col("total"), 0.0), 4).alias("zero_rate"))


def top_queries(events: DataFrame, only_empty: bool = False, limit: int = 10) -> DataFrame:
    """Queries alike but for case, the most frequent first, then the latest; a top-k report."""
    empty = (F.col("status") == "completed") & (F.col("result_count") == 0)
    own = events.filter(empty) if only_empty else events
    grouped = own.groupBy(F.lower("query_text").alias("key")).agg(F.min("query_text").alias("query_text"), F.count("*").alias("n"), F.count_if(empty).alias("n_empty"), F.round(F.avg(F.col("duration_ms").cast("decimal(20,6)")), 2).cast("double").alias("mean_ms"), F.max("created_at").alias("last"))
    return grouped.orderBy(F.desc("n"), F.desc("last"), "key").limit(limit).select("query_text", "n", "n_empty", "mean_ms")


def recent(events: DataFrame, limit: int = 30) -> DataFrame:
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("id", "query_text", "status", "result_count", "duration_ms")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count("*").alias("total"), F.count_if("helpful").alias("helpful"), F.count_if(~F.col("helpful")).alias("unhelpful"))


def feedback_reasons(feedback: DataFrame) -> DataFrame:
    """Counts by reason; rows without one are a group."""
    return feedback.groupBy("reason").agg(F.count("*").alias("n"))


def usage_by_operation(usage: DataFrame) -> DataFrame:
    """Two levels: attempts make up calls (worst status, longest times, retries), calls make up (operation, model)."""
    key = ["operation", "model"]
    calls = usage.groupBy(*key, "call_id").agg(F.min("call_status").alias("status"), F.max("call_duration_ms").alias("ms"), F.max("first_token_duration_ms").alias("first_ms"), F.greatest(F.max("attempt") - 1, F.lit(0)).alias("retries"))
    by_call = calls.groupBy(*key).agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "success").alias("successes"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("retries").cast("long").alias("retries"), F.sum("ms").alias("ms"), F.count("first_ms").alias("n_first"), F.sum("first_ms").alias("first_ms"))
    raw = usage.groupBy(*key).agg(F.count("*").alias("attempts"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("estimated_cost_usd").alias("cost"))
    both = by_call.join(raw, key)
    return both.select(*key, "calls", "successes", "errors", "retries", "attempts", "input_tokens", "output_tokens", F.round(F.col("cost").cast("double"), 6).alias("cost_usd"), half_up(ratio(F.col("ms"), F.col("calls"), None), 2).alias("mean_ms"), half_up(ratio(F.col("first_ms"), F.col("n_first"), None), 2).alias("mean_first_token_ms"))


def usage_by_document(usage: DataFrame) -> DataFrame:
    key = ["document_id", "operation", "model", "call_status"]
    return usage.groupBy(*key).agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("attempt_duration_ms").alias("duration_ms"), F.round(F.sum("estimated_cost_usd").cast("double"), 6).alias("cost_usd"))


def period_start(ts: Column, period: str, offset_minutes: int = 0) -> Column:
    """Start, in the clock of ts, of the day or month that ts is in at so many minutes east."""
    shift = F.make_interval(mins=F.lit(offset_minutes))
    return F.date_trunc(period, ts + shift).cast("timestamp_ntz") - shift


def budget_usage(usage: DataFrame, now: Column, offset_minutes: int = 0) -> DataFrame:
    """Cost of the current day and month by tenant, from one scan."""
    spent = lambda period: F.coalesce(F.sum(F.when(F.col("created_at") >= period_start(now, period, offset_minutes), F.col("estimated_cost_usd"))), F.lit(0).cast("decimal(30,10)"))
    out = usage.filter(F.col("created_at") >= period_start(now, "month", offset_minutes)).filter(F.col("created_at") <= now)
    return out.groupBy("tenant_id").agg(F.round(spent("day").cast("double"), 6).alias("day_usd"), F.round(spent("month").cast("double"), 6).alias("month_usd"))


def budget_assessment(spent: DataFrame, call_usd: Column, single: float, daily: float, monthly: float, action: str, retries: int = 2) -> DataFrame:
    """Decision for a call whose cost is counted with its retries: single call, then daily, then monthly limit; 'warn' allows."""
    cost = call_usd * (retries + 1)
    reason = F.when(cost > single, "single_call").when(F.col("day_usd") + cost > daily, "daily").when(F.col("month_usd") + cost > monthly, "monthly")
    return spent.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason").isNull(), "allow").otherwise(F.lit("allow" if action == "warn" else action)))


def threshold_alerts(usage: DataFrame, budget: float, thresholds: list[float], period: str = "month") -> DataFrame:
    """The first time at which a tenant's cost of the period reaches each share (in hundredths) of the budget."""
    start = period_start(F.col("created_at"), period)
    w = Window.partitionBy("tenant_id", "period_start").orderBy("created_at", "call_id", "attempt").rowsBetween(Window.unboundedPreceding, 0)
    running = usage.withColumn("period_start", start).withColumn("so_far", F.sum("estimated_cost_usd").over(w))
    marks = F.explode(F.array(*(F.lit(float(t)) for t in sorted({t for t in thresholds if 0 < t <= 100})))).alias("threshold")
    reached = running.select("tenant_id", "period_start", "created_at", "so_far", marks).filter(F.col("so_far") >= F.col("threshold") / 100 * budget)
    return reached.groupBy("tenant_id", "period_start", "threshold").agg(F.min("created_at").alias("reached_at"))


def before_after(after: DataFrame, before: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Differences of counters by key; keys without any change are left out."""
    old = before.select(*keys, *(F.col(v).alias(f"old_{v}") for v in values))
    out = after.join(old, keys, "left").select(*keys, *((F.col(v) - F.coalesce(F.col(f"old_{v}"), F.lit(0))).alias(v) for v in values))
    changed = F.lit(False)
    for v in values:
        changed = changed | (F.col(v) != 0)
    return out.filter(changed)


#: The model that answers with sentences of its sources.
EXTRACTIVE = "local-extractive-v1"
#: Sources of such an answer.
EXTRACTIVE_HITS = 3


def answer_plan(calls: DataFrame, spent: DataFrame, prices: Column, limits: tuple[float, float, float], action: str, fallback: str | None, degraded_output: int, degraded_context: int, history: int, gateway: bool = True) -> DataFrame:
    """How each question is answered under its tenant's budget.

    calls: (call_id, tenant_id, model, input_tokens, degraded_input_tokens, max_output_tokens, hits), with what a prompt
    within the smaller context has as well; spent: (tenant_id, day_usd, month_usd), tenants without a row have spent nothing;
    limits: single call, day, month. A call beyond its budget is refused or degraded: the fallback model (or the same one),
    fewer tokens of output, of context, and of history, at most half the context; if even that is beyond the budget, or
    the fallback has no model behind it, sentences of the first sources answer. Adds status, reason, the model and
    tokens in use, extractive, and cited: how many hits are cited.
    """
    single, daily, monthly = limits
    price = lambda: resolve_price(prices, F.lit("chat"), F.col("model"), F.lit(0.0))
    # what a million tokens of output cost is twice what those of input do, as elsewhere
    usd = lambda: call_cost(price(), price() * 2, F.col("input_tokens"), F.col("max_output_tokens"))
    zero = F.lit(0.0)
    own = calls.join(spent, "tenant_id", "left").withColumn("day_usd", F.coalesce("day_usd", zero)).withColumn("month_usd", F.coalesce("month_usd", zero))
    first = budget_assessment(own, usd(), single, daily, monthly, action)
    less = F.col("decision") == "degrade"
    smaller = {
        "model": F.when(less, F.coalesce(F.lit(fallback), "model")).otherwise(F.col("model")),
        "input_tokens": F.when(less, F.col("degraded_input_tokens")).otherwise(F.col("input_tokens")),
        "max_output_tokens": F.when(less, F.least("max_output_tokens", F.lit(degraded_output))).otherwise(F.col("max_output_tokens")),
        "history_tokens": F.when(less, F.least(F.lit(history), F.lit(degraded_context // 2))).otherwise(F.lit(history)),
    }
    status = F.when(F.col("decision") == "reject", "rejected").when(less, "degraded").otherwise("allowed")
    again = budget_assessment(first.withColumns(smaller | {"status": status}).withColumnRenamed("reason", "why").drop("decision"), usd(), single, daily, monthly, action)
    refused, degraded = F.col("status") == "rejected", F.col("status") == "degraded"
    extractive = ~refused & (F.lit(not gateway) | (degraded & ((F.col("model") == EXTRACTIVE) | (F.col("decision") != "allow"))))
    rows = again.withColumn("extractive", extractive).withColumn("reason", F.col("why"))
    cited = F.when(refused, F.lit(0)).when(F.col("extractive"), F.least("hits", F.lit(EXTRACTIVE_HITS))).otherwise(F.col("hits"))
    return rows.select("call_id", "tenant_id", "status", "reason", "model", "input_tokens", "max_output_tokens", "history_tokens", "extractive", cited.cast("long").alias("cited"))
