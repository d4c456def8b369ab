"""Queries over texts, layout, chunks, jobs and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking as C
from quern.operators import layout as L
from quern.operators import lifecycle as S
from quern.plans import bindings as B
from quern.sources import markdown as M

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _marked(spark, sf_dir):
    """Documents whose every fifth line is a heading."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## "), x)).otherwise(x))
    return B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.array_join(lines, "\n").alias("text"))


_MARKED = "l AS (SELECT doc_id AS document_id, i - 1 AS line, CASE WHEN (i - 1) % 5 = 0 THEN '## ' || s ELSE s END AS s FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))"


@query(B.with_(_MARKED, r"""p AS (SELECT *, coalesce(sum(length(s) + 1) OVER (PARTITION BY document_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l), t AS (SELECT document_id, sum(length(s) + 1) - 1 AS n FROM l GROUP BY document_id),
m AS (SELECT *, regexp_extract(s, '^#{1,6}[ \t]+(.+?)[ \t]*$', 1) AS title FROM p WHERE regexp_extract(s, '^#{1,6}[ \t]+(.+?)[ \t]*$', 1) <> '')""") + """
SELECT document_id, title, CAST(start AS BIGINT) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY document_id ORDER BY line), n) AS BIGINT) AS "end" FROM m JOIN t USING (document_id)""")
def heading_anchors(spark, sf_dir):
    return M.headings(_marked(spark, sf_dir))


@query(r"""WITH p AS (SELECT doc_id AS document_id, unnest(regexp_split_to_array(text, '\n[ \t]*\n')) AS content, generate_subscripts(regexp_split_to_array(text, '\n[ \t]*\n'), 1) - 1 AS position FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10) || ' ' || chr(10)) AS text FROM documents))
SELECT document_id, position, sha256(trim(content, ' ' || chr(9) || chr(13) || chr(10))) AS content_sha256 FROM p WHERE trim(content, ' ' || chr(9) || chr(13) || chr(10)) <> ''""")
def paragraph_ranges(spark, sf_dir):
    own = B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.replace("text", F.lit(". "), F.lit(".\n \n")).alias("text"))
    return M.paragraphs(own).select("document_id", "position", F.sha2("content", 256).alias("content_sha256"))


@query(r"SELECT doc_id AS document_id, sha256(trim(regexp_replace(replace(t, chr(13) || chr(10), chr(10)), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), " + " || ".join(f"chr({ord(c)})" for c in T.WHITE) + r")) AS h FROM (SELECT doc_id, replace(text, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10)) AS t FROM documents)")
def clean_markdown(spark, sf_dir):
    t = F.replace("text", F.lit(". "), F.lit(".\r\n\n\n\n"))
    return B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2(T.clean_markdown(t), 256).alias("h"))


_PAGE_LINES = """lines AS (SELECT source AS doc, doc_id AS page, 5.0 AS top, 100.0 AS page_height, string_split(coalesce(text, ''), chr(10))[1] AS text FROM documents
  UNION ALL SELECT source, doc_id, 50.0, 100.0, 'body ' || doc_id FROM documents UNION ALL SELECT source, doc_id, 95.0, 100.0, CASE WHEN doc_id % 3 = 0 THEN doc_id || ' / ' || doc_id ELSE 'Page ' || doc_id || ' of 9' END FROM documents)"""


@query(B.with_(_PAGE_LINES, r"""o AS (SELECT *, CASE WHEN top <= page_height * 0.12 THEN 'header' WHEN top >= page_height * 0.88 THEN 'footer' END AS role, lower(trim(regexp_replace(regexp_replace(text, '\d+', '#', 'g'), '\s+', ' ', 'g'))) AS fingerprint FROM lines),
n AS (SELECT doc, count(DISTINCT page) AS n FROM lines GROUP BY doc), s AS (SELECT doc, role, fingerprint, count(DISTINCT page) AS pages FROM o WHERE role IS NOT NULL GROUP BY ALL)""") + r"""
SELECT doc, role, fingerprint, pages FROM s JOIN n USING (doc) WHERE pages >= greatest(2, ceil(n * 0.1)) OR (role = 'footer' AND regexp_matches(fingerprint, '^(page\s*)?#(\s*(of|/)\s*#)?$'))""")
def repeated_margins(spark, sf_dir):
    docs = B.read(spark, sf_dir, "documents")
    line = lambda top, text: docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.lit(top).alias("top"), F.lit(1.0).alias("height"), F.lit(100.0).alias("page_height"), text.alias("text"))
    foot = F.when(F.col("doc_id") % 3 == 0, F.concat("doc_id", F.lit(" / "), "doc_id")).otherwise(F.concat(F.lit("Page "), "doc_id", F.lit(" of 9")))
    rows = line(5.0, F.split(F.coalesce("text", F.lit("")), "\n", -1)[0]).unionByName(line(50.0, F.concat(F.lit("body "), "doc_id"))).unionByName(line(95.0, foot))
    return L.repeated_margins(rows, 0.1)


_CELLS = "cells AS (SELECT DISTINCT l_suppkey AS sheet, l_orderkey AS r, l_linenumber AS c FROM lineitem)"


@query(B.with_(_CELLS, "a AS (SELECT *, r - dense_rank() OVER (PARTITION BY sheet ORDER BY r) AS band FROM cells)", "b AS (SELECT *, c - dense_rank() OVER (PARTITION BY sheet, band ORDER BY c) AS block FROM a)") + """
SELECT sheet, min(r) AS row_start, max(r) AS row_end, min(c) AS column_start, max(c) AS column_end, count(*) AS n FROM b GROUP BY sheet, band, block""")
def grid_regions(spark, sf_dir):
    own = B.read(spark, sf_dir, "lineitem")
    return L.regions(own.select(F.col("l_suppkey").alias("sheet"), F.col("l_orderkey").alias("r"), F.col("l_linenumber").alias("c")))


@query("SELECT doc_id AS document_id, CASE WHEN n_chars < 200 THEN 'scanned' WHEN doc_id % 4 > 0 THEN 'mixed' ELSE 'native' END AS class FROM documents")
def page_classes(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), L.page_class(F.col("n_chars"), F.col("doc_id") % 4, 200).alias("class"))


@query("""SELECT source, CAST(greatest(0, 100 - CASE WHEN unread > 0 THEN 35 ELSE 0 END - CASE WHEN unsure > 0 THEN 20 ELSE 0 END - CASE WHEN empty > 0 THEN 25 ELSE 0 END - least(15, warnings * 3)) AS INTEGER) AS score FROM (
  SELECT source, count(*) FILTER (WHERE n_chars < 40) AS unread, count(*) FILTER (WHERE n_chars BETWEEN 40 AND 60) AS unsure, count(*) FILTER (WHERE n_chars = 0) AS empty, count(*) FILTER (WHERE doc_id % 11 = 0) AS warnings FROM documents GROUP BY source)""")
def quality_score(spark, sf_dir):
    n = F.col("n_chars")
    own = B.read(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(n < 40).alias("u"), F.count_if(n.between(40, 60)).alias("c"), F.count_if(n == 0).alias("e"), F.count_if(F.col("doc_id") % 11 == 0).alias("w"))
    return own.select("source", L.quality_score(F.col("u"), F.col("c"), F.col("e"), F.col("w")).alias("score"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey % 9 + 1 AS n, sha256(o_orderkey || ':' || (o_custkey % 9 + 1)) AS h FROM orders)
SELECT id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8','9','a','b'][instr('0123456789abcdef', h[17]) % 4 + CASE WHEN instr('0123456789abcdef', h[17]) % 4 = 0 THEN 4 ELSE 0 END] || h[18:20] || '-' || h[21:32] AS chunk_id FROM s""")
def chunk_ids(spark, sf_dir):
    return B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.chunk_id(F.col("o_orderkey"), F.col("o_custkey") % 9 + 1).alias("chunk_id"))


@query()
def chunk_documents(spark, sf_dir):
    return C.chunk_documents(_marked(spark, sf_dir).withColumnRenamed("text", "markdown")).drop("content")


@query(r"SELECT doc_id AS id, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS tokens, len(regexp_extract_all(text, '[^\s]+')) AS words FROM documents")
def token_stats(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.estimate_tokens(F.col("text")).alias("tokens"), T.count_words(F.col("text")).alias("words"))


@query("""SELECT doc_id AS id, 'document_title: ' || lang || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'page: ' || (doc_id % 7 + 1) || chr(10) ELSE '' END || 'section: ' || source AS context FROM documents""")
def context_prefix(spark, sf_dir):
    own = B.read(spark, sf_dir, "documents")
    return own.select(F.col("doc_id").alias("id"), T.context_prefix(document_title=F.col("lang"), page=F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 7 + 1), section=F.col("source")).alias("context"))


@query(r"SELECT doc_id AS id, substring(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 320) AS excerpt FROM documents")
def citation_excerpt(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT doc_id AS id, CASE WHEN length(text) > 420 THEN substring(text, 1, 417) || '...' ELSE text END AS snippet FROM documents")
def snippet(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.snippet(F.col("text")).alias("snippet"))


@query(r"SELECT doc_id AS id, regexp_replace(text, '(?i)(tion|the)', '<mark>\1</mark>', 'g') AS marked FROM documents")
def highlight(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.highlight(F.col("text"), F.lit("the a TION the")).alias("marked"))


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'page ' || p_size WHEN 1 THEN 'slide ' || p_size WHEN 2 THEN 'sheet ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' A1:B2' ELSE '' END WHEN 3 THEN p_name ELSE 'document' END AS label FROM part WHERE p_size > 0")
def source_labels(spark, sf_dir):
    k = F.col("p_size") % 5
    return B.read(spark, sf_dir, "part").filter("p_size > 0").select(F.col("p_partkey").alias("id"), T.source_label(F.when(k == 0, F.col("p_size")), F.when(k == 1, F.col("p_size")), F.when(k == 2, F.col("p_brand")), F.when(F.col("p_partkey") % 2 == 0, "A1:B2"), F.when(k == 3, F.col("p_name"))).alias("label"))


@query("""WITH n AS (SELECT p_partkey AS id, p_partkey % 800 + 1 AS c FROM part), x AS (SELECT id, c, CASE WHEN c > 702 THEN chr(CAST(65 + (c - 703) // 676 AS INTEGER)) ELSE '' END || CASE WHEN c > 26 THEN chr(CAST(65 + ((c - 27) // 26) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (c - 1) % 26 AS INTEGER)) AS letters FROM n)
SELECT id, letters, CAST(c AS INTEGER) AS number FROM x""")
def column_letters(spark, sf_dir):
    own = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.column_letters(F.col("p_partkey") % 800 + 1).alias("letters"))
    return own.withColumn("number", T.column_number(F.col("letters")))


@query("SELECT page_id AS id, CASE WHEN instr(f, '.') > 0 THEN lower('.' || string_split(f, '.')[-1]) ELSE '' END AS extension, substring(regexp_replace(string_split(f, '/')[-1], '[^a-zA-Z0-9_.\\-]+', '_', 'g'), 1, 160) AS name FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'noext' || page_id ELSE url || '.PDF' END AS f FROM pages)")
def file_names(spark, sf_dir):
    f = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("noext"), "page_id")).otherwise(F.concat("url", F.lit(".PDF")))
    return B.read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), T.extension(f).alias("extension"), T.safe_filename(f, F.col("page_id")).alias("name"))


def _jobs(spark, sf_dir):
    names = list(S.TRANSITIONS)
    status = F.element_at(F.array(*map(F.lit, names)), (F.get_json_object("props", "$.k").cast("int") % len(names) + 1).cast("int"))
    return B.read(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("id"), "ts", status.alias("status"))


_STATES = "[" + ", ".join(f"'{s}'" for s in S.TRANSITIONS) + "]"
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, bs in S.TRANSITIONS.items() for b in bs)


@query(f"""WITH j AS (SELECT user_id AS job, event_id AS id, ts, {_STATES}[CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 + 1] AS status FROM events), s AS (SELECT *, lag(status) OVER (PARTITION BY job ORDER BY ts, id) AS before FROM j)
SELECT job, id, before, status FROM s WHERE before <> status AND (before, status) NOT IN (VALUES {_ALLOWED})""")
def job_transitions(spark, sf_dir):
    allowed = spark.createDataFrame([(a, b) for a, bs in S.TRANSITIONS.items() for b in bs], "before string, status string")
    return S.illegal_transitions(_jobs(spark, sf_dir), allowed)


@query(f"""SELECT job, status, ts FROM (SELECT user_id AS job, event_id AS id, ts, {_STATES}[CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 + 1] AS status FROM events) QUALIFY row_number() OVER (PARTITION BY job ORDER BY ts DESC, id DESC) = 1""")
def job_states(spark, sf_dir):
    return S.latest_state(_jobs(spark, sf_dir))


def _metered(events):
    return events.select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("event_type").alias("operation"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), (F.col("event_id") % 500).alias("delivery"), (F.col("event_id") % 5).alias("version"))


@query("SELECT 'u' || (user_id % 20) AS key, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2")
def quota_windows(spark, sf_dir):
    return S.quota_windows(_metered(B.read(spark, sf_dir, "events"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_id % 500 AS delivery, min_by(event_id, (ts, event_id)) AS id FROM events GROUP BY 1")
def first_deliveries(spark, sf_dir):
    return S.first_deliveries(_metered(B.read(spark, sf_dir, "events")), "delivery").select("delivery", "id")


@query("""WITH e AS (SELECT 'u' || (user_id % 20) AS key, event_id AS id, event_id % 5 AS version, max(event_id % 5) OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events)
SELECT key, id, version FROM e WHERE seen IS NULL OR version >= seen""")
def fresh_only(spark, sf_dir):
    return S.fresh_only(_metered(B.read(spark, sf_dir, "events"))).select("key", "id", "version")


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return _metered(spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(f"{sf_dir}/"))


def _drained(spark, stream, mode="append"):
    from quern.plans.scratch import folder
    from quern.streaming.state import drain

    base = folder(spark, "stream")
    return drain(stream, f"{base}/out", f"{base}/checkpoint", mode)


@query("""SELECT event_type AS operation, 'm' || (user_id % 3) AS model, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failures, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2""")
def stream_usage(spark, sf_dir):
    from quern.streaming.state import usage_counters

    return _drained(spark, usage_counters(_stream(spark, sf_dir)), "complete")


@query("SELECT event_id % 500 AS delivery, 1::BIGINT AS n FROM events GROUP BY 1")
def stream_dedupe(spark, sf_dir):
    from quern.streaming.state import deduplicate

    return _drained(spark, deduplicate(_stream(spark, sf_dir), "delivery", "40 days").select("delivery")).groupBy("delivery").agg(F.count("*").alias("n"))


@query()
def stream_quota(spark, sf_dir):
    from quern.streaming.state import quota

    return _drained(spark, quota(_stream(spark, sf_dir), 150, 3600))


@query()
def stream_breaker(spark, sf_dir):
    from quern.streaming.state import breaker

    return _drained(spark, breaker(_stream(spark, sf_dir).select("key", "id", "ts", (F.col("status") == "success").alias("ok"))))
