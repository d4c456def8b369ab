"""Queries over search events, usage, budgets and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import numbers as N
from quern.operators import governance as G
from quern.plans import bindings as B

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_WINDOW = "recent_events AS (SELECT * FROM search_events WHERE created_at >= (SELECT max(created_at) FROM search_events) - INTERVAL 14 DAY)"


@query(B.with_(B.SEARCH_EVENTS, _WINDOW, """s AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'completed' AND result_count = 0) AS zero_results, count(*) FILTER (WHERE source = 'answer') AS answers,
  avg(duration_ms) AS mean_ms, quantile_cont(duration_ms, 0.95) AS p95, avg(result_count) FILTER (WHERE status = 'completed') AS mean_results FROM recent_events)""") + """
SELECT total, completed, failed, zero_results, answers, floor(mean_ms * 100 + 0.5) / 100 AS mean_ms, floor(p95 * 100 + 0.5) / 100 AS p95_ms,
  floor(mean_results * 100 + 0.5) / 100 AS mean_results, floor(zero_results / total * 10000 + 0.5) / 10000 AS zero_rate FROM s""")
def gov_search_summary(spark, sf_dir):
    return G.search_summary(G.trailing(B.search_events(spark, sf_dir), 14))


_TOP = """SELECT min(query_text) AS query_text, count(*) AS n, count(*) FILTER (WHERE status = 'completed' AND result_count = 0) AS n_empty,
  CAST(round(CAST(sum(duration_ms) AS DECIMAL(28,6)) / count(*), 2) AS DOUBLE) AS mean_ms, max(created_at) AS last, lower(query_text) AS key
FROM search_events {where} GROUP BY lower(query_text)"""


@query(B.with_(B.SEARCH_EVENTS) + f"SELECT query_text, n, n_empty, mean_ms FROM ({_TOP.format(where='')}) ORDER BY n DESC, last DESC, key LIMIT 10")
def gov_top_queries(spark, sf_dir):
    return G.top_queries(B.search_events(spark, sf_dir))


@query(B.with_(B.SEARCH_EVENTS) + f"SELECT query_text, n, n_empty, mean_ms FROM ({_TOP.format(where="WHERE status = 'completed' AND result_count = 0")}) ORDER BY n DESC, last DESC, key LIMIT 10")
def gov_zero_result_queries(spark, sf_dir):
    return G.top_queries(B.search_events(spark, sf_dir), only_empty=True)


@query(B.with_(B.SEARCH_EVENTS) + "SELECT id, query_text, status, result_count, duration_ms FROM search_events ORDER BY created_at DESC, id DESC LIMIT 30")
def gov_recent(spark, sf_dir):
    return G.recent(B.search_events(spark, sf_dir))


def _feedback(spark, sf_dir):
    reason = F.when(F.col("toxic") == 1, "incorrect").when(F.col("doc_id") % 3 == 0, "outdated")
    return B.read(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("helpful"), reason.alias("reason"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS helpful, count(*) FILTER (WHERE quality <> 1) AS unhelpful FROM labels")
def feedback_summary(spark, sf_dir):
    return G.feedback_summary(_feedback(spark, sf_dir))


@query("SELECT CASE WHEN toxic = 1 THEN 'incorrect' WHEN doc_id % 3 = 0 THEN 'outdated' END AS reason, count(*) AS n FROM labels GROUP BY 1")
def feedback_reasons(spark, sf_dir):
    return G.feedback_reasons(_feedback(spark, sf_dir))


@query(B.with_(B.USAGE_EVENTS, """calls AS (SELECT operation, model, call_id, min(call_status) AS status, max(call_duration_ms) AS ms, max(first_token_duration_ms) AS first_ms, greatest(max(attempt) - 1, 0) AS retries FROM usage_events GROUP BY ALL)""",
  """by_call AS (SELECT operation, model, count(*) AS calls, count(*) FILTER (WHERE status = 'success') AS successes, count(*) FILTER (WHERE status = 'error') AS errors, CAST(sum(retries) AS BIGINT) AS retries, sum(ms) AS ms, count(first_ms) AS n_first, sum(first_ms) AS first_ms FROM calls GROUP BY ALL)""",
  """raw AS (SELECT operation, model, count(*) AS attempts, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, sum(estimated_cost_usd) AS cost FROM usage_events GROUP BY ALL)""") + """
SELECT operation, model, calls, successes, errors, retries, attempts, input_tokens, output_tokens, round(CAST(cost AS DOUBLE), 6) AS cost_usd,
  floor(ms / calls * 100 + 0.5) / 100 AS mean_ms, CASE WHEN n_first > 0 THEN floor(first_ms / n_first * 100 + 0.5) / 100 END AS mean_first_token_ms FROM by_call JOIN raw USING (operation, model)""")
def usage_by_operation(spark, sf_dir):
    return G.usage_by_operation(B.usage_events(spark, sf_dir))


@query(B.with_(B.USAGE_EVENTS) + """SELECT document_id, operation, model, call_status, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(attempt_duration_ms) AS BIGINT) AS duration_ms, round(CAST(sum(estimated_cost_usd) AS DOUBLE), 6) AS cost_usd FROM usage_events GROUP BY ALL""")
def usage_by_document(spark, sf_dir):
    return G.usage_by_document(B.usage_events(spark, sf_dir))


_NOW = "TIMESTAMP '2024-01-20 15:30:00'"


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-01-20 15:30:00'")


_SPENT = f"""spent AS (SELECT tenant_id, round(CAST(coalesce(sum(estimated_cost_usd) FILTER (WHERE created_at >= date_trunc('day', {_NOW} + INTERVAL 60 MINUTE) - INTERVAL 60 MINUTE), 0) AS DOUBLE), 6) AS day_usd,
  round(CAST(sum(estimated_cost_usd) AS DOUBLE), 6) AS month_usd FROM usage_events WHERE created_at <= {_NOW} AND created_at >= date_trunc('month', {_NOW} + INTERVAL 60 MINUTE) - INTERVAL 60 MINUTE GROUP BY tenant_id)"""


@query(B.with_(B.USAGE_EVENTS, _SPENT) + "SELECT * FROM spent")
def budget_day_month(spark, sf_dir):
    return G.budget_usage(B.usage_events(spark, sf_dir), _now(), 60)


@query(B.with_(B.USAGE_EVENTS, _SPENT, "c AS (SELECT *, CASE tenant_id WHEN 't0' THEN 0.5 ELSE 0.01 END * 3 AS cost FROM spent)", """r AS (SELECT *, CASE WHEN cost > 1 THEN 'single_call' WHEN day_usd + cost > 0.6 THEN 'daily' WHEN month_usd + cost > 9 THEN 'monthly' END AS reason FROM c)""") + """
SELECT tenant_id, day_usd, month_usd, reason, CASE WHEN reason IS NULL THEN 'allow' ELSE 'degrade' END AS decision FROM r""")
def budget_assessment(spark, sf_dir):
    spent = G.budget_usage(B.usage_events(spark, sf_dir), _now(), 60)
    return G.budget_assessment(spent, F.when(F.col("tenant_id") == "t0", 0.5).otherwise(0.01), 1.0, 0.6, 9.0, "degrade")


@query(B.with_(B.USAGE_EVENTS, """running AS (SELECT tenant_id, date_trunc('month', created_at) AS period_start, created_at, sum(estimated_cost_usd) OVER (PARTITION BY tenant_id, date_trunc('month', created_at) ORDER BY created_at, call_id, attempt ROWS UNBOUNDED PRECEDING) AS so_far FROM usage_events)""") + """
SELECT tenant_id, CAST(period_start AS TIMESTAMP) AS period_start, threshold, min(created_at) AS reached_at FROM running, (SELECT unnest([50.0, 80.0, 100.0])::DOUBLE AS threshold) WHERE CAST(so_far AS DOUBLE) >= threshold / 100 * 10.0 GROUP BY 1, 2, 3""")
def budget_threshold_alerts(spark, sf_dir):
    return G.threshold_alerts(B.usage_events(spark, sf_dir), 10.0, [80, 50, 100, 100, 0, 120])


_PRICES = {"chat:model-1": 3.0, "chat:*": 2.0, "*:model-2": 1.5, "*:*": 0.5}


@query(B.with_(B.USAGE_EVENTS) + """SELECT operation, model, price, count(*) AS n, floor((sum(input_tokens) * price + sum(output_tokens) * (price * 2)) / 1000000.0::DOUBLE * 1000000 + 0.5) / 1000000 AS cost_usd FROM (
  SELECT *, CASE WHEN starts_with(model, 'local-') THEN 0.0 WHEN operation = 'chat' AND model = 'model-1' THEN 3.0 WHEN operation = 'chat' THEN 2.0 WHEN model = 'model-2' THEN 1.5 ELSE 0.5 END::DOUBLE AS price FROM usage_events) GROUP BY 1, 2, 3""")
def price_resolution(spark, sf_dir):
    catalog = F.create_map(*(x for k, v in _PRICES.items() for x in (F.lit(k), F.lit(v))))
    priced = B.usage_events(spark, sf_dir).withColumn("price", N.resolve_price(catalog, F.col("operation"), F.col("model"), F.lit(0.1)))
    sums = priced.groupBy("operation", "model", "price").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    return sums.select("operation", "model", "price", "n", N.half_up(N.call_cost(F.col("price"), F.col("price") * 2, F.col("i"), F.col("o")), 6).alias("cost_usd"))


@query(B.with_(B.USAGE_EVENTS, """m AS (SELECT operation, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS tokens, created_at < TIMESTAMP '2024-01-10' AS old FROM usage_events GROUP BY ALL)""",
  "a AS (SELECT operation, model, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(coalesce(sum(calls) FILTER (WHERE old), 0) AS BIGINT) AS c0, CAST(coalesce(sum(tokens) FILTER (WHERE old), 0) AS BIGINT) AS t0 FROM m GROUP BY ALL)") + """
SELECT operation, model, calls - c0 AS calls, tokens - t0 AS tokens FROM a WHERE calls <> c0 OR tokens <> t0""")
def model_metric_delta(spark, sf_dir):
    usage = B.usage_events(spark, sf_dir)
    count = lambda df: df.groupBy("operation", "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("tokens"))
    return G.before_after(count(usage), count(usage.filter("created_at < timestamp_ntz'2024-01-10'")), ["operation", "model"], ["calls", "tokens"])


@query("SELECT id, backoff_ms FROM (SELECT event_id AS id, CAST(least(60000, 1000 * pow(2, greatest(0, event_id % 12 - 1))) AS BIGINT) AS backoff_ms FROM events WHERE event_type = 'error')")
def retry_backoff(spark, sf_dir):
    return B.read(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), N.backoff_ms(F.col("event_id") % 12).alias("backoff_ms"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 1024 ELSE greatest(256, CAST(ceil(p_size * 40 / 512) * ceil(p_size * 25 / 512) * 170 + 85 AS BIGINT)) END AS tokens FROM part")
def image_tokens(spark, sf_dir):
    w = F.when(F.col("p_size") % 7 != 0, F.col("p_size") * 40)
    return B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.image_tokens(w, F.col("p_size") * 25).alias("tokens"))


@query("SELECT event_id AS id, ts AS created_at FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def retention_delete(spark, sf_dir):
    own = B.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return G.trailing(own, 7)
