"""Queries over the whole search request: variants, two-level fusion, reranked candidates, pages; and inverted lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import pages as G
from quern.operators import planning as P
from quern.operators import vectors as X
from quern.plans import bindings as B
from quern.plans import search as S
from quern.plans.scratch import stored

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _chunks(spark, sf_dir):
    """Published documents; those of a language and folder are one source."""
    docs = B.catalog_documents(spark, sf_dir).filter("status = 'published'").withColumn("content", F.coalesce("text", F.lit("")))
    source = G.source_identity({"type": F.col("lang"), "page": (F.col("document_id") % 100 - F.col("document_id") % 20).cast("string")})
    return docs.select(F.col("document_id").alias("chunk_id"), F.expr("document_id div 3").alias("document_id"), source.alias("source"), "title", "content", F.sha2("content", 256).alias("content_hash"), F.col("document_id").alias("ordinal"), F.lit(0).cast("long").alias("offset_start"), F.length("content").cast("long").alias("offset_end"))


def _own(spark, sf_dir):
    return B.vector_chunks(spark, sf_dir).select("chunk_id", "embedding")


def _variants(spark, sf_dir):
    """Three variants of each query: itself, its first and its last eight words."""
    words = F.split("query", " ", -1)
    each = [(F.col("query"), 1.0, True), (F.array_join(F.slice(words, 1, 8), " "), 0.85, False), (F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 7), 8), " "), 0.95, True)]
    rows = F.array(*(F.struct((F.col("qid") * 8 + i).alias("vid"), t.alias("text"), F.lit(w).alias("weight"), F.lit(v).alias("use_vector")) for i, (t, w, v) in enumerate(each)))
    odd = F.expr("qid div 50 % 2 = 1")
    plan = F.when(odd, 15).otherwise(12).alias("candidate_limit"), F.when(odd, 0.9).otherwise(1.0).alias("keyword_weight"), F.when(odd, 1.3).otherwise(1.1).alias("vector_weight")
    return B.text_queries(spark, sf_dir).select("qid", F.explode(rows).alias("v"), *plan).select("qid", "v.*", *("candidate_limit", "keyword_weight", "vector_weight"))


def _vectors(spark, sf_dir, variants):
    """The vector of a variant is that of the row whose id is the query's and the variant's place."""
    own = B.vector_chunks(spark, sf_dir).select("chunk_id", F.col("embedding").alias("query_vector"))
    return variants.select("vid", F.expr("vid div 8 + vid % 8").alias("chunk_id")).join(own, "chunk_id").select("vid", "query_vector")


_VARIANTS = """asked AS (SELECT item_id AS qid, text AS query, string_split(text, ' ') AS words FROM benchmark WHERE item_id % 50 = 0),
plans AS (SELECT qid, CASE WHEN qid // 50 % 2 = 1 THEN 15 ELSE 12 END AS candidate_limit, CASE WHEN qid // 50 % 2 = 1 THEN 0.9 ELSE 1.0 END::DOUBLE AS keyword_weight, CASE WHEN qid // 50 % 2 = 1 THEN 1.3 ELSE 1.1 END::DOUBLE AS vector_weight FROM asked),
variants AS (SELECT qid, qid * 8 AS vid, query AS text, 1.0::DOUBLE AS weight FROM asked UNION ALL SELECT qid, qid * 8 + 1, array_to_string(words[1:8], ' '), 0.85 FROM asked UNION ALL SELECT qid, qid * 8 + 2, array_to_string(words[greatest(1, len(words) - 7):], ' '), 0.95 FROM asked),
text_queries AS (SELECT vid AS qid, text AS query FROM variants)"""
_FUSED = """cosines AS (SELECT vid, c.chunk_id, round(list_cosine_similarity(q.embedding, c.embedding), 6) AS score FROM variants JOIN vector_chunks q ON q.chunk_id = vid // 8 + vid % 8 JOIN vector_chunks c ON c.chunk_id IN (SELECT chunk_id FROM texts) WHERE vid % 8 <> 1),
near AS (SELECT vid, chunk_id, row_number() OVER (PARTITION BY vid ORDER BY score DESC, chunk_id) AS rank FROM cosines QUALIFY rank <= 20),
found AS (SELECT 'k' AS channel, qid AS vid, chunk_id, rank FROM keyword UNION ALL SELECT 'v', vid, chunk_id, rank FROM near),
level AS (SELECT qid, channel, chunk_id, round(sum(weight / (60 + rank)), 9) AS s FROM found JOIN variants USING (vid) JOIN plans USING (qid) WHERE rank <= candidate_limit GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, channel ORDER BY s DESC, chunk_id) AS r FROM level),
both_ AS (SELECT qid, chunk_id, round(sum(CASE channel WHEN 'k' THEN keyword_weight ELSE vector_weight END / (60 + r)), 9) AS score FROM ranked JOIN plans USING (qid) GROUP BY qid, chunk_id),
fused AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM both_ JOIN plans USING (qid) QUALIFY rank <= max(candidate_limit) OVER (PARTITION BY qid))"""
_BASE = (B.CATALOG_DOCUMENTS, S._TEXTS, B.VECTOR_CHUNKS, _VARIANTS, S._BM25, _FUSED)


@query(B.with_(*_BASE) + "SELECT qid, chunk_id, score, rank FROM fused")
def search_fusion(spark, sf_dir):
    """Variants fused within each channel, then the channels by the plan's weights, within the plan's window."""
    variants = _variants(spark, sf_dir)
    return G.recall(_chunks(spark, sf_dir), variants, _vectors(spark, sf_dir, variants), 20, own_vectors=_own(spark, sf_dir)).select("qid", "chunk_id", "score", "rank")


def _relevant(spark, sf_dir):
    chunks, variants = _chunks(spark, sf_dir), _variants(spark, sf_dir)
    fused = G.recall(chunks, variants, _vectors(spark, sf_dir, variants), 20, own_vectors=_own(spark, sf_dir))
    return G.relevant(fused, chunks, B.text_queries(spark, sf_dir), score_threshold=0.1, per_document=2, rerank_limit=10)


@query(B.with_(*_BASE, r"""hydrated AS (SELECT f.*, t.content, t.chunk_id // 3 AS owner FROM fused f JOIN texts t USING (chunk_id)),
once AS (SELECT * FROM hydrated QUALIFY row_number() OVER (PARTITION BY qid, sha256(content) ORDER BY rank) = 1),
capped AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY qid, owner ORDER BY rank) <= 2),
prepared AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS position FROM capped QUALIFY position <= 10),
w AS (SELECT qid, term, CASE WHEN length(term) = 1 THEN 0.25 ELSE 1.0 END::DOUBLE AS w FROM (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS term FROM asked)),
scored AS (SELECT p.qid, p.chunk_id, position, round(coalesce((SELECT sum(w.w) FROM w WHERE w.qid = p.qid AND list_contains(t.ws, w.term)), 0) / (SELECT sum(w.w) FROM w WHERE w.qid = p.qid), 6) AS score FROM prepared p JOIN toks t USING (chunk_id))""")
       + "SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, position) AS rank FROM scored WHERE score > 0.1")
def search_relevant(spark, sf_dir):
    """What a page is chosen from: prepared, reranked and above the score threshold."""
    return _relevant(spark, sf_dir).select("qid", "chunk_id", "score", "rank")


_MERGED = r"""hydrated AS (SELECT f.*, t.content, t.lang, t.chunk_id // 3 AS owner FROM fused f JOIN texts t USING (chunk_id)),
ranks AS (SELECT qid, chunk_id, rank, score, content, coalesce(lang, '') || ':' || (chunk_id % 100 - chunk_id % 20) AS source, embedding FROM hydrated JOIN vector_chunks v USING (chunk_id)),
once AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM ranks QUALIFY row_number() OVER (PARTITION BY qid, sha256(content) ORDER BY score DESC, rank) = 1),
steps AS (SELECT *, count(*) OVER (PARTITION BY qid) AS left_over, CASE WHEN chunk_id = lag(chunk_id) OVER w + 1 AND greatest(0, list_cosine_similarity(embedding, lag(embedding) OVER w)) >= 0.05 THEN 0 ELSE 1 END AS breaks FROM (SELECT o.*, (SELECT count(*) FROM ranks r WHERE r.qid = o.qid) AS whole FROM once o) WINDOW w AS (PARTITION BY qid, source ORDER BY chunk_id)),
islands AS (SELECT *, sum(breaks) OVER (PARTITION BY qid, source ORDER BY chunk_id) AS island FROM steps)"""


@query(B.with_(*_BASE, _MERGED) + """SELECT qid, arg_max(chunk_id, (score, -rank)) AS chunk_id, max(score) AS score, min(chunk_id) AS ordinal_start, max(chunk_id) AS ordinal_end, CAST(count(*) AS INTEGER) AS members, CAST(any_value(whole - left_over) AS INTEGER) AS exact_removed,
  CAST(max(length(content)) AS BIGINT) AS offset_end FROM islands GROUP BY qid, source, island""")
def search_merged(spark, sf_dir):
    """Fused candidates without copies, neighbours of a source joined."""
    chunks, variants = _chunks(spark, sf_dir), _variants(spark, sf_dir)
    fused = G.recall(chunks, variants, _vectors(spark, sf_dir, variants), 20, own_vectors=_own(spark, sf_dir))
    rows = fused.join(chunks, "chunk_id").join(_own(spark, sf_dir).filter(F.col("embedding").isNotNull()), "chunk_id")
    return G.merged(rows, 0.05).select("qid", "chunk_id", "score", "ordinal_start", "ordinal_end", "members", "exact_removed", "offset_end")


@query()
def search_page(spark, sf_dir):
    """The second page, of five, of every query by its plan; query and chunk vectors are the given ones."""
    queries = B.text_queries(spark, sf_dir)
    planned = stored(P.plan(queries, 200, 8), "plans")
    vectors = _vectors(spark, sf_dir, G.exploded(planned))
    return G.search_page(_chunks(spark, sf_dir), queries, planned, vectors, page=2, size=5, fields={"title": 2.0, "content": 1.0}, own_vectors=_own(spark, sf_dir), threshold=0.9)


@query()
def knn_inverted_lists(spark, sf_dir):
    """The best ten of every query vector by inverted lists; tests hold its recall against knn_topk."""
    chunks = B.vector_chunks(spark, sf_dir)
    lists = X.fit(chunks)
    return X.search(X.index(chunks, lists), B.vector_queries(spark, sf_dir), lists, 10)
