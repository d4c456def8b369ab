"""Queries over provenance, anchors and addresses of assets; elements are the lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import assets as A
from quern.plans import bindings as B
from quern.sources import structure as S

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _lines(spark, sf_dir):
    own = B.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("version_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line"))
    return own.withColumn("n", F.col("n").cast("long"))


def _elements(spark, sf_dir):
    """Sections of ten lines, every third on a page; every fourth line shows one of its document's five pictures."""
    paged = F.expr("n div 10") % 3 == 2
    at = {"type": F.when(paged, "page").otherwise("section"), "heading": F.when(F.expr("n div 10") % 2 == 0, F.concat(F.lit("H"), F.expr("n div 10"))), "page": F.when(paged, F.expr("n div 10").cast("int") + 1)}
    place = F.from_json(F.to_json(F.struct(*(v.alias(k) for k, v in at.items()))), S.LOCATION)
    fields = {
        "id": F.concat(F.lit("e"), "n"), "kind": F.lit("paragraph"), "location": place, "order": F.col("n").cast("double"), "text": F.col("line"), "source": F.lit("native"), "confidence": F.lit(None).cast("double"),
        "sectionPath": F.array(F.lit("Top"), F.concat(F.lit("P"), F.expr("n div 10"))), "figureId": F.lit(None).cast("string"), "assetFilename": F.when(F.col("n") % 4 == 0, F.concat(F.lit("pic "), F.expr("n div 4") % 5, F.lit(".png"))),
    }
    return _lines(spark, sf_dir).select("version_id", F.lit(0).alias("unit_no"), F.col("n").alias("place"), F.struct(*(v.alias(k) for k, v in fields.items())).alias("element"))


_LINES = """l AS (SELECT CAST(doc_id AS VARCHAR) AS version_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents)"""
_KEY = r"trim(regexp_replace(line, '[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ')"


@query(f"""WITH {_LINES}, k AS (SELECT *, {_KEY} AS key FROM l),
said AS (SELECT version_id, key, max(n) AS n FROM k WHERE n % 6 = 2 GROUP BY 1, 2)
SELECT k.version_id, CASE WHEN s.n IS NULL THEN 'native' WHEN s.n % 4 = 0 THEN 'ocr' ELSE 'vision' END AS source, CASE WHEN s.n % 5 > 0 THEN s.n % 100 END AS confidence,
  CASE WHEN s.n % 12 = 2 THEN 'figure' ELSE 'paragraph' END AS kind, CASE WHEN s.n % 12 = 2 THEN 'f' || s.n END AS figure_id, count(*) AS n_elements
FROM k LEFT JOIN said s ON s.version_id = k.version_id AND s.key = k.key GROUP BY ALL""")
def element_provenance(spark, sf_dir):
    """Every sixth line has been read by an enrichment, which wrote it with other white space."""
    n, figure = F.col("n"), F.col("n") % 12 == 2
    marker = F.concat(F.lit(" \t"), F.replace("line", F.lit(" "), F.lit("  　")), F.lit("\n"))
    said = _lines(spark, sf_dir).filter("n % 6 = 2").select("version_id", n.alias("number"), marker.alias("marker"), F.when(n % 4 == 0, "ocr").otherwise("vision").alias("source"), F.when(n % 5 > 0, n % 100).cast("double").alias("confidence"), F.when(figure, "figure").alias("kind"), F.when(figure, F.concat(F.lit("f"), n)).alias("figure_id"))
    e = F.col("element")
    own = A.with_provenance(_elements(spark, sf_dir), said)
    return own.groupBy("version_id", e["source"].alias("source"), e["confidence"].cast("long").alias("confidence"), e["kind"].alias("kind"), e["figureId"].alias("figure_id")).agg(F.count("*").alias("n_elements"))


_ASSETS = "a AS (SELECT CAST(doc_id AS VARCHAR) AS version_id, i AS ordinal, 'pic ' || i || '.png' AS filename, doc_id FROM documents, range(6) r(i))"


def _assets(spark, sf_dir):
    i = F.col("ordinal")
    return B.read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("version_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("ordinal")).withColumn("filename", F.concat(F.lit("pic "), i, F.lit(".png")))


@query(f"""WITH {_LINES}, {_ASSETS}, last AS (SELECT version_id, 'pic ' || (n // 4 % 5) || '.png' AS filename, max(n) AS n FROM l WHERE n % 4 = 0 GROUP BY 1, 2)
SELECT a.version_id, a.filename, CASE WHEN n // 10 % 3 <> 2 THEN 'heading' END AS type, CASE WHEN n // 10 % 3 <> 2 THEN CASE WHEN n // 10 % 2 = 0 THEN 'H' ELSE 'P' END || (n // 10) END AS heading,
  CASE WHEN n // 10 % 3 <> 2 THEN 'Top/P' || (n // 10) END AS section_path FROM a LEFT JOIN last USING (version_id, filename)""")
def asset_anchors(spark, sf_dir):
    own = A.with_anchors(_assets(spark, sf_dir).drop("doc_id"), _elements(spark, sf_dir))
    return own.select("version_id", "filename", "anchor.type", "anchor.heading", F.array_join("anchor.sectionPath", "/").alias("section_path"))


@query(f"""WITH {_LINES}, r AS (SELECT version_id, string_agg(CASE WHEN n % 4 <> 0 THEN line ELSE line || ' ![](' || CASE WHEN n // 4 % 7 = 6 THEN 'asset://other.png' WHEN n // 4 % 7 = 5 THEN 'asset://pic%205.pngx' ELSE 'https://store/' || version_id || '/' || (n // 4 % 7) END || ')' END, chr(10) ORDER BY n) AS markdown FROM l GROUP BY 1)
SELECT version_id, length(markdown) AS chars, sha256(markdown) AS sha256 FROM r""")
def markdown_with_addresses(spark, sf_dir):
    """Every fourth line refers to a picture; two of seven references are unknown."""
    docs = B.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("version_id"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))

    def shown(x, n):
        j = F.floor(n / 4) % 7
        name = F.when(j == 6, "other.png").otherwise(F.concat(F.lit("pic%20"), j, F.lit(".png"), F.when(j == 5, "x").otherwise("")))
        return F.when(n % 4 == 0, F.concat(x, F.lit(" ![](asset://"), name, F.lit(")"))).otherwise(x)

    versions = docs.select("version_id", F.array_join(F.transform("lines", shown), "\n").alias("markdown"))
    addresses = _assets(spark, sf_dir).filter("ordinal < 5").select("version_id", "ordinal", "filename", F.concat(F.lit("https://store/"), "version_id", F.lit("/"), "ordinal").alias("address"))
    out = A.resolved(versions, addresses)
    return out.select("version_id", F.length("markdown").cast("long").alias("chars"), F.sha2("markdown", 256).alias("sha256"))


@query("SELECT sha256(coalesce(text, '')) AS sha256, max(strlen(coalesce(text, ''))) AS bytes, count(*) AS n_assets, count(DISTINCT doc_id) AS n_versions, min(doc_id) AS version_id FROM documents GROUP BY 1")
def assets_by_content(spark, sf_dir):
    """Texts as contents: each is stored once, under its first place."""
    text = F.coalesce("text", F.lit(""))
    own = B.read(spark, sf_dir, "documents").select(F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"), F.col("doc_id").alias("version_id"), F.lit(1).alias("ordinal"))
    return A.by_content(own).drop("ordinal")
