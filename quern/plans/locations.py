"""Queries over places in documents, merged contents, ids, settled quotas and the cost of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import locations as L
from quern.plans import bindings as B

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_KINDS = ("document", "section", "page", "slide", "sheet")


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey % 5 AS a, o_orderkey % 5 AS b, o_custkey AS x, o_orderkey AS y FROM orders)
SELECT id, a = b AND CASE a WHEN 0 THEN true WHEN 1 THEN x % 3 = y % 3 WHEN 2 THEN x % 4 = y % 4 WHEN 3 THEN x % 2 = y % 2 ELSE x % 2 = y % 2 AND nullif(x % 3, 0) IS NOT DISTINCT FROM nullif(y % 3, 0) END AS same FROM o""")
def same_locations(spark, sf_dir):
    def place(c):
        kind = F.element_at(F.array(*map(F.lit, _KINDS)), (c % 5 + 1).cast("int"))
        return F.struct(kind.alias("type"), (c % 3).alias("heading"), (c % 4).alias("page"), (c % 2).alias("slide"), (c % 2).alias("sheet"), F.nullif(c % 3, F.lit(0)).alias("row_start"), F.lit(None).cast("int").alias("row_end"), F.lit("A1").alias("range"))

    own = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), place(F.col("o_custkey")).alias("a"), place(F.col("o_orderkey")).alias("b"))
    return own.select("id", L.same_location(F.col("a"), F.col("b")).alias("same"))


@query("""WITH b AS (SELECT l_orderkey AS id, CAST(l_quantity AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) * 20 AS t, CAST(l_suppkey % 90 AS DOUBLE) AS w FROM lineitem),
u AS (SELECT id, min(x) AS x, min(t) AS y, max(x + w) - min(x) AS width, max(t + 10) - min(t) AS height FROM b GROUP BY id)
SELECT id, x, y, width, height, round(least(1.0, width / 100), 6) AS width_share, round(least(1.0, height / 80), 6) AS height_share FROM u""")
def union_boxes(spark, sf_dir):
    double = lambda c: F.col(c).cast("double")
    lines = B.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), double("l_quantity").alias("x"), (double("l_linenumber") * 20).alias("top"), (F.col("l_suppkey") % 90).cast("double").alias("width"), F.lit(10.0).alias("height"))
    share = lambda c, page: F.round(L.share_of_page(F.col(c), F.lit(page)), 6).alias(f"{c}_share")
    return L.union_boxes(lines, "id").select("*", share("width", 100), share("height", 80))


@query(r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) > 1) AS e FROM conversations),
t AS (SELECT conv_id, e AS cells FROM w WHERE turn % 3 = 0)
SELECT DISTINCT w.conv_id AS page, w.turn AS element FROM w JOIN t USING (conv_id) WHERE len(e) > 0 AND len(cells) > 0 AND len(list_filter(e, lambda x: list_contains(cells, x))) >= len(e) * 0.65""")
def repeated_paragraphs(spark, sf_dir):
    """Every third turn is a table of its conversation."""
    own = B.read(spark, sf_dir, "conversations")
    tables = own.filter("turn % 3 = 0").select(F.col("conv_id").alias("page"), F.array("text").alias("cells"))
    return L.repeated_paragraphs(own.select(F.col("conv_id").alias("page"), F.col("turn").alias("element"), "text"), tables)


@query("""WITH h AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents)
SELECT doc_id AS document_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab', (instr('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""")
def synthetic_ids(spark, sf_dir):
    return B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), L.synthetic_id(F.col("doc_id")).alias("id"))


@query("""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 80 ELSE 120 END AS stride FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, k, substring(text, k * stride + 1, 100) AS piece, k * stride AS o, k = (length(text) - 1) // stride AS last FROM (SELECT *, unnest(range((length(text) - 1) // stride + 1)) AS k FROM d)),
odd AS (SELECT doc_id, string_agg(CASE WHEN last OR piece LIKE '%' || chr(10) THEN piece ELSE piece || chr(10) || chr(10) END, '' ORDER BY k) AS content FROM p GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, max(o + length(piece)) AS offset_end, min(k) FILTER (WHERE k % 3 = least(2, m)) AS best FROM (SELECT *, max(k) OVER (PARTITION BY doc_id) AS m FROM p) GROUP BY doc_id)
SELECT doc_id AS document_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE content END) AS sha256, 0 AS offset_start, offset_end, doc_id || ':' || best AS chunk_id, n FROM d JOIN odd USING (doc_id) JOIN n USING (doc_id)""")
def merged_contents(spark, sf_dir):
    """Windows of 100 characters, every 80 (they overlap) or every 120 (they do not)."""
    own = B.read(spark, sf_dir, "documents").filter(F.length("text") > 0).select(F.col("doc_id").alias("document_id"), "text", F.when(F.col("doc_id") % 2 == 0, 80).otherwise(120).alias("stride"))
    each = own.select("*", F.explode(F.sequence(F.lit(0), F.expr("cast((length(text) - 1) div stride as int)"))).alias("k")).withColumn("offset_start", (F.col("k") * F.col("stride")).cast("long"))
    each = each.withColumn("content", F.substr("text", (F.col("offset_start") + 1).cast("int"), F.lit(100)))
    parts = each.select("document_id", F.concat_ws(":", "document_id", "k").alias("chunk_id"), F.col("k").alias("ordinal"), "content", "offset_start", (F.col("offset_start") + F.length("content")).alias("offset_end"), (F.col("k") % 3).alias("score"))
    return L.merge_contents(parts, "document_id").select("document_id", F.sha2("content", 256).alias("sha256"), "offset_start", "offset_end", "chunk_id", "n")


@query("SELECT event_id AS id, CAST(greatest(0, event_id % 500 + greatest(0, floor(value)) - 120) AS BIGINT) AS used FROM events")
def settled_quotas(spark, sf_dir):
    return B.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), L.settled(F.col("event_id") % 500, F.lit(120), F.col("value")).alias("used"))


@query(B.with_(B.USAGE_EVENTS, "s AS (SELECT call_id, tenant_id, sum(estimated_cost_usd) AS c FROM usage_events GROUP BY ALL)")
       + "SELECT o_orderkey AS run_id, round(coalesce(CAST(c AS DOUBLE), 0.5), 6) AS cost FROM orders LEFT JOIN s ON call_id = o_orderkey AND tenant_id = 't' || (o_custkey % 4)")
def run_costs(spark, sf_dir):
    runs = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("t"), F.col("o_custkey") % 4).alias("tenant_id"), F.lit(0.5).alias("fallback"))
    return L.run_costs(runs, B.usage_events(spark, sf_dir).withColumnRenamed("call_id", "run_id"))
