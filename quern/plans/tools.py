"""Queries over persisted structures and document tools; the structures are made from the lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import tools as D
from quern.plans import bindings as B
from quern.plans.scratch import stored
from quern.sources import structure as S

QUERIES, ORACLE = {}, {}
PER_PAGE = 5


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _files(spark, sf_dir):
    """Structures of documents as JSON: five lines a page, the first version for ids divisible by three; of every
    seventeenth the text is broken, of every nineteenth the checksum. Every fourth line of a page is a figure, and each
    page has a table of its first line."""
    own = B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    first = F.col("id") % 3 == 0

    def page(p):
        number, start = p.cast("int") + 1, p * PER_PAGE

        def element(line, i):
            n = start + i
            kind = F.when(n % 4 == 3, "figure").otherwise("paragraph")
            at = F.when(~first, F.struct(F.lit("page").alias("type"), number.alias("page")))
            return F.struct(
                F.concat(F.lit("e"), n).alias("id"), kind.alias("kind"), at.alias("location"), F.when(first, number).alias("page"), n.alias("order"), line.alias("text"), line.alias("markdown"), (n * 10).alias("offsetStart"), (n * 10 + F.length(line)).alias("offsetEnd"),
                (n % 7 != 6).alias("searchable"), F.lit("native").alias("source"), F.array(F.concat(F.lit("Part "), number)).alias("sectionPath"), F.when(n % 4 == 3, F.concat(F.lit("f"), n)).alias("figureId"), F.when(i == 0, F.concat(F.lit("t"), number)).alias("tableId"),
            )

        at = F.when(~first, F.struct(F.lit("page").alias("type"), number.alias("page")))
        return F.struct(
            F.when(~first, F.concat(F.lit("page-"), number)).alias("id"), at.alias("location"), F.when(first, number).alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit("native").alias("classification"), F.lit(1).alias("textCharacters"), F.lit(1.0).alias("textCoverage"),
            F.lit(0).alias("imageCount"), F.lit(False).alias("ocrApplied"), F.lit(0).alias("visionAnalyzedImages"), F.transform(F.slice("lines", start.cast("int") + 1, PER_PAGE), element).alias("elements"),
        )

    pages = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.size("lines") / PER_PAGE).cast("long") - 1), page)

    def table(p):
        number, line = p.cast("int") + 1, F.element_at("lines", (p * PER_PAGE + 1).cast("int"))
        at = F.when(~first, F.struct(F.lit("page").alias("type"), number.alias("page")))
        return F.struct(F.concat(F.lit("t"), number).alias("id"), at.alias("location"), F.when(first, number).alias("page"), F.array(F.array(line)).alias("rows"), F.concat(F.lit("| "), line, F.lit(" |")).alias("markdown"))

    tables = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.size("lines") / PER_PAGE).cast("long") - 1), table)
    counters = {c: F.lit(0) for c in S.COUNTERS}
    quality = F.struct(F.lit("pass").alias("status"), F.lit(100).alias("score"), F.array().cast("array<string>").alias("reasons"), F.when(~first, F.struct(F.lit(1).alias("checked"))).alias("metrics"), *(v.alias(k) for k, v in counters.items()))
    whole = F.to_json(F.struct(F.when(first, 1).otherwise(2).alias("version"), F.lit("pdf").alias("format"), F.when(~first, pages).alias("units"), F.when(first, pages).alias("pages"), tables.alias("tables"), quality.alias("quality")))
    # the checksum is of the column, so that each structure is written once
    rows = own.select("id", F.concat(F.when(F.col("id") % 17 == 5, "{").otherwise(""), whole).alias("content"))
    wrong = F.when(F.col("id") % 19 == 7, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256))
    return rows.select(F.col("id").cast("string").alias("version_id"), "content", wrong.alias("sha256"))


def _structures(spark, sf_dir):
    """Parsed once, as a table: look-ups read only the columns that they need."""
    return stored(S.read(_files(spark, sf_dir)), "structures")


_LINES = r"""l AS (SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
bad AS (SELECT doc_id AS id, CASE WHEN doc_id % 19 = 7 THEN 'checksum' WHEN doc_id % 17 = 5 THEN 'malformed' END AS problem FROM documents)"""


@query(f"WITH {_LINES} SELECT CAST(id AS VARCHAR) AS version_id, problem FROM bad WHERE problem IS NOT NULL")
def structure_problems(spark, sf_dir):
    """The reasons are written first: Spark would put all that they are computed from into the filter, and there again
    and again."""
    return S.problems(stored(S.read(_files(spark, sf_dir)).select("version_id", "problem"), "problems"))


@query(f"""WITH {_LINES} SELECT CAST(id AS VARCHAR) AS version_id, n // 5 + 1 AS page, count(*) AS elements, sha256(string_agg(line, chr(10) ORDER BY n)) AS sha256, max(n * 10 + length(line)) AS offset_end FROM l JOIN bad USING (id) WHERE problem IS NULL GROUP BY id, n // 5""")
def structure_pages(spark, sf_dir):
    """Every page of every sound structure, of either version, by a look-up."""
    own = _structures(spark, sf_dir)
    wanted = S.units(own).select("version_id", F.col("unit.location.page").alias("page"))
    e = F.col("unit.elements")
    return S.pages(own, wanted).select("version_id", "page", F.size(e).cast("long").alias("elements"), F.sha2(F.array_join(F.transform(e, lambda x: x["text"]), "\n"), 256).alias("sha256"), F.array_max(F.transform(e, lambda x: x["offsetEnd"])).alias("offset_end"))


def _asked(spark, sf_dir):
    """A question for every four documents, which are its hits: their second page is found."""
    docs = B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    qid = F.expr("id div 4")
    texts = ["What is page 1 used for?", "read section Part 2", "compare the numbers", "show the chart", "anything else"]
    questions = docs.select(qid.alias("qid")).distinct().withColumn("question", F.element_at(F.array(*map(F.lit, texts)), (F.col("qid") % 5 + 1).cast("int")))
    place = D._place(type=F.lit("page"), page=F.lit(2))
    hits = docs.select(qid.alias("qid"), (F.col("id") % 4 + 1).cast("int").alias("rank"), F.col("id").cast("string").alias("chunk_id"), F.col("id").alias("document_id"), F.col("id").cast("string").alias("version_id"), F.lit("title").alias("title"), F.lit(None).cast("string").alias("context"), F.coalesce(F.get("lines", F.lit(5)), F.lit("")).alias("content"), F.lit(0.5).alias("score"), place.alias("source"), F.lit(0).cast("long").alias("offset_start"), F.lit(0).cast("long").alias("offset_end"))
    return questions, hits


@query(f"""WITH {_LINES}, s AS (SELECT b.id, id // 4 AS qid, row_number() OVER (PARTITION BY id // 4 ORDER BY id % 4) AS source_no, problem FROM bad b QUALIFY source_no <= 3),
e AS (SELECT id, n // 5 + 1 AS page, count(*) FILTER (WHERE n % 7 <> 6) AS shown, coalesce(string_agg(line, '') FILTER (WHERE n % 7 <> 6), '') AS content, count(*) FILTER (WHERE n % 4 = 3 AND n % 7 <> 6) AS figures FROM l GROUP BY 1, 2),
c AS (SELECT s.*, 'read_page' AS tool, 1 AS page FROM s WHERE qid % 5 = 0 UNION ALL SELECT s.*, 'read_location', 2 FROM s WHERE qid % 5 = 1 UNION ALL SELECT s.*, 'get_table', 2 FROM s WHERE qid % 5 = 2 UNION ALL SELECT s.*, 'inspect_figure', 2 FROM s WHERE qid % 5 = 3),
r AS (SELECT c.qid, c.source_no, c.id, tool, sum(shown) AS shown, string_agg(content, '') AS content, max(figures) AS figures, count(e.page) > 0 AS there FROM c LEFT JOIN e ON e.id = c.id AND (e.page = c.page OR tool = 'read_location' AND CAST(e.page AS VARCHAR) LIKE '2%') WHERE problem IS NULL GROUP BY ALL),
n AS (SELECT *, CASE tool WHEN 'read_page' THEN CASE WHEN content <> '' THEN 1 ELSE 0 END WHEN 'read_location' THEN CASE WHEN content <> '' THEN shown ELSE 0 END WHEN 'get_table' THEN CASE WHEN there THEN 1 ELSE 0 END ELSE least(2, coalesce(figures, 0)) END AS n FROM r)
SELECT qid, CAST(source_no AS INTEGER) AS source_no, id AS document_id, tool, CASE WHEN n > 0 THEN 'success' ELSE 'skipped' END AS status, CAST(n AS INTEGER) AS n FROM n
UNION ALL SELECT qid, CAST(source_no AS INTEGER), id, 'get_source', 'skipped', 0 FROM s WHERE problem IS NOT NULL""")
def document_tool_calls(spark, sf_dir):
    questions, hits = _asked(spark, sf_dir)
    structures = _structures(spark, sf_dir)
    asked = D.calls(questions, hits)
    done = D.report(asked, D.found(asked, structures), structures).unionByName(D.missing_sources(hits, structures))
    return done.drop("resource")


@query()
def document_tool_hits(spark, sf_dir):
    """The hits of every question with what the tools read, in place; tests hold them against a plain version."""
    questions, hits = _asked(spark, sf_dir)
    structures = _structures(spark, sf_dir)
    return D.enrich(hits, D.found(D.calls(questions, hits), structures)).select("qid", "rank", "document_id", "source", F.sha2("content", 256).alias("sha256"), "offset_start", "offset_end")
