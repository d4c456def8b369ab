"""Queries over recall, fusion, reranking, answers and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import answers as N
from quern.operators import evaluation as E
from quern.operators import planning as P
from quern.operators import retrieval as R
from quern.plans import bindings as B

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _texts(spark, sf_dir):
    return B.catalog_documents(spark, sf_dir).filter("status = 'published'").select(F.col("document_id").alias("chunk_id"), "document_id", "title", F.coalesce("text", F.lit("")).alias("content"), "space_id", "lang")


_TEXTS = "texts AS (SELECT document_id AS chunk_id, document_id, title, coalesce(text, '') AS content, space_id, lang FROM catalog_documents WHERE status = 'published')"
_BM25 = r"""toks AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS ws FROM texts),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM toks),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(ws) AS dl, unnest(ws) AS term FROM toks) GROUP BY ALL),
terms AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS term FROM text_queries),
dfs AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM terms) GROUP BY term),
bm AS (SELECT qid, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN terms USING (term) JOIN dfs USING (term), stats GROUP BY qid, chunk_id),
keyword AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM bm QUALIFY rank <= 20)"""
_KNN = """cosines AS (SELECT qid, chunk_id, document_id, principals, round(list_cosine_similarity(query_vector, embedding), 6) AS score FROM vector_queries, vector_chunks WHERE qid <> chunk_id)"""
_BASE = (B.CATALOG_DOCUMENTS, _TEXTS, B.TEXT_QUERIES, _BM25, B.VECTOR_CHUNKS, B.VECTOR_QUERIES, _KNN)


@query(B.with_(B.CATALOG_DOCUMENTS, _TEXTS, B.TEXT_QUERIES, _BM25) + "SELECT qid, chunk_id, score, rank FROM keyword")
def bm25_topk(spark, sf_dir):
    return R.bm25(_texts(spark, sf_dir), B.text_queries(spark, sf_dir), 20)


_FIELDS = r"""fields AS (SELECT chunk_id, 'content' AS field, 1.0 AS boost, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS ws FROM texts UNION ALL SELECT chunk_id, 'title', 2.0, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') FROM texts),
stats AS (SELECT field, count(*) AS n, avg(len(ws)) AS avgdl FROM fields GROUP BY field),
tf AS (SELECT chunk_id, field, boost, dl, term, count(*) AS tf FROM (SELECT chunk_id, field, boost, len(ws) AS dl, unnest(ws) AS term FROM fields) GROUP BY ALL),
terms AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS term FROM text_queries),
dfs AS (SELECT field, term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
by_field AS (SELECT qid, chunk_id, field, boost * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM tf JOIN terms USING (term) JOIN dfs USING (field, term) JOIN stats USING (field) GROUP BY qid, chunk_id, field, boost),
best AS (SELECT qid, chunk_id, round(CAST(max(s) AS DOUBLE), 6) AS score FROM by_field GROUP BY qid, chunk_id)"""


@query(B.with_(B.CATALOG_DOCUMENTS, _TEXTS, B.TEXT_QUERIES, _FIELDS) + "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM best QUALIFY rank <= 10")
def bm25_fields(spark, sf_dir):
    return R.bm25(_texts(spark, sf_dir), B.text_queries(spark, sf_dir), 10, {"title": 2.0, "content": 1.0})


@query(B.with_(B.VECTOR_CHUNKS, B.VECTOR_QUERIES, _KNN) + "SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM cosines QUALIFY rank <= 10")
def knn_topk(spark, sf_dir):
    return R.nearest_in_blocks(B.vector_chunks(spark, sf_dir), B.vector_queries(spark, sf_dir), 10)


@query(B.with_(B.VECTOR_CHUNKS, B.VECTOR_QUERIES, _KNN) + "SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM cosines WHERE list_has_any(principals, ['all', 'label:3']) QUALIFY rank <= 10")
def knn_topk_acl(spark, sf_dir):
    from quern.operators.access import may_read

    return R.nearest_in_blocks(B.vector_chunks(spark, sf_dir).filter(may_read(F.col("principals"), ["all", "label:3"])), B.vector_queries(spark, sf_dir), 10)


_CHANNELS = """vector AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM cosines QUALIFY rank <= 20),
channels AS (SELECT qid, chunk_id, rank, 1.0 AS weight FROM keyword UNION ALL SELECT qid, chunk_id, rank, 1.1 FROM vector),
fused AS (SELECT qid, chunk_id, round(CAST(sum(CAST(weight AS DOUBLE) / (60 + rank)) AS DOUBLE), 9) AS score FROM channels GROUP BY qid, chunk_id)"""


def _channels(spark, sf_dir, texts=None, vectors=None):
    texts, vectors = texts or _texts(spark, sf_dir), vectors or B.vector_chunks(spark, sf_dir)
    keyword = R.bm25(texts, B.text_queries(spark, sf_dir), 20).select("qid", "chunk_id", "rank", F.lit(1.0).alias("weight"))
    vector = R.nearest_in_blocks(vectors, B.vector_queries(spark, sf_dir), 20).select("qid", "chunk_id", "rank", F.lit(1.1).alias("weight"))
    return keyword.unionByName(vector)


@query(B.with_(*_BASE, _CHANNELS) + "SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM fused QUALIFY rank <= 20")
def rrf_two_channels(spark, sf_dir):
    return R.fuse(_channels(spark, sf_dir), limit=20)


# a reader: a tenant, and principals of which a document must grant one
_TENANT, _READER = "t1", ["lang:en", "lang:fr", "user:7"]
_READABLE = "texts AS (SELECT document_id AS chunk_id, document_id, title, coalesce(text, '') AS content, space_id, lang FROM catalog_documents WHERE status = 'published' AND tenant_id = 't1' AND (lang IN ('en', 'fr') OR created_by = 'user:7'))"
_KNN_READABLE = _KNN.replace("WHERE", "WHERE chunk_id IN (SELECT chunk_id FROM texts) AND")


@query(B.with_(B.CATALOG_DOCUMENTS, _READABLE, B.TEXT_QUERIES, _BM25, B.VECTOR_CHUNKS, B.VECTOR_QUERIES, _KNN_READABLE, _CHANNELS) + """SELECT qid, rank, chunk_id, title, space_id, score FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM fused)
JOIN texts USING (chunk_id) WHERE rank <= 15""")
def hybrid_search(spark, sf_dir):
    """Keyword and vector recall over what the reader may read, fused by rank, and hydrated under the same check; ids lost
    in hydration drop out."""
    from quern.operators.access import visible

    docs = B.catalog_documents(spark, sf_dir).withColumn("principals", F.array(F.concat(F.lit("lang:"), "lang"), F.col("created_by")))
    texts = visible(docs, _TENANT, _READER).select(F.col("document_id").alias("chunk_id"), "title", F.coalesce("text", F.lit("")).alias("content"), "space_id")
    vectors = B.vector_chunks(spark, sf_dir).join(texts.select("chunk_id"), "chunk_id", "left_semi")
    fused = R.fuse(_channels(spark, sf_dir, texts, vectors), limit=15)
    return fused.join(texts.select("chunk_id", "title", "space_id"), "chunk_id").select("qid", "rank", "chunk_id", "title", "space_id", "score")


_VARIANTS = """ranked AS (SELECT label % 4 AS qid, chunk_id, label % 3 AS variant, row_number() OVER (PARTITION BY label ORDER BY chunk_id % 7, chunk_id) AS rank FROM vector_chunks),
fused AS (SELECT qid, chunk_id, round(sum(CASE variant WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 ELSE 0.0 END::DOUBLE / (60 + rank)), 9) AS score FROM ranked WHERE variant < 2 GROUP BY 1, 2)"""


@query(B.with_(B.VECTOR_CHUNKS, _VARIANTS) + "SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM fused")
def rrf_variants(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy(F.col("chunk_id") % 7, "chunk_id")
    ranked = B.vector_chunks(spark, sf_dir).select((F.col("label") % 4).alias("qid"), "chunk_id", F.element_at(F.array(F.lit(1.0), F.lit(0.95), F.lit(0.0)), F.col("label") % 3 + 1).alias("weight"), F.row_number().over(w).alias("rank"))
    return R.fuse(ranked)


@query(B.with_(B.CATALOG_DOCUMENTS, _TEXTS, B.TEXT_QUERIES, _BM25, r"""w AS (SELECT qid, term, CASE WHEN length(term) = 1 THEN 0.25 ELSE 1.0 END::DOUBLE AS w FROM terms),
whole AS (SELECT qid, sum(w) AS whole FROM w GROUP BY qid)""") + """
SELECT k.qid, k.chunk_id, round(coalesce((SELECT sum(w.w) FROM w WHERE w.qid = k.qid AND list_contains(t.ws, w.term)), 0) / whole, 6) AS score FROM keyword k JOIN toks t USING (chunk_id) JOIN whole USING (qid)""")
def lexical_rerank(spark, sf_dir):
    queries = B.text_queries(spark, sf_dir)
    found = R.bm25(_texts(spark, sf_dir), queries, 20).join(_texts(spark, sf_dir).select("chunk_id", "content"), "chunk_id")
    return R.lexical_rerank(found, queries)


def _ranked_chunks(chunks, qid):
    """Chunks as the ranked candidates of queries."""
    from pyspark.sql import Window

    own = chunks.withColumn("qid", qid).withColumn("content_hash", F.sha2(F.lower("content"), 256))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("ordinal") % 5, "document_id", "ordinal")))


_RANKED = "ranked AS (SELECT *, document_id // 10 AS qid, sha256(lower(content)) AS content_hash, row_number() OVER (PARTITION BY document_id // 10 ORDER BY ordinal % 5, document_id, ordinal) AS rank FROM chunks)"


@query(B.with_(B.CHUNKS, _RANKED, "a AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY qid, content_hash ORDER BY rank) = 1)", "b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY qid, document_id ORDER BY rank) <= 3)")
       + "SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS position FROM b QUALIFY position <= 12")
def rerank_prepare_caps(spark, sf_dir):
    return R.rerank_candidates(_ranked_chunks(B.chunks(spark, sf_dir), F.expr("document_id div 10")), 3, 12).select("qid", "chunk_id", "position")


@query()
def rerank_prepare_budget(spark, sf_dir):
    """All chunks are candidates: those of ten documents of one query each, so that queries grow with the table."""
    import public_tokenizers

    ranked = _ranked_chunks(B.chunks(spark, sf_dir), F.expr("document_id div 10"))
    ranked = ranked.select("qid", F.concat(F.lit("what of group "), "qid").alias("query"), F.concat(F.lit("document "), "document_id").alias("title"), F.lit(None).cast("string").alias("context"), "chunk_id", "document_id", "content", "content_hash", "rank")
    return R.pack_for_rerank(ranked, 3, 12, 200, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("SELECT source AS qid, doc_id AS chunk_id, n_chars AS score FROM documents QUALIFY row_number() OVER (PARTITION BY source, sha256(text) ORDER BY n_chars DESC, doc_id) = 1")
def exact_dedupe(spark, sf_dir):
    own = B.read(spark, sf_dir, "documents").select(F.col("source").alias("qid"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("score"), F.sha2("text", 256).alias("content_hash"))
    return R.exact_duplicates(own).select("qid", "chunk_id", "score")


_ISLANDS = """steps AS (SELECT *, CASE WHEN ordinal = lag(ordinal) OVER w + 1 AND list_cosine_similarity(embedding, lag(embedding) OVER w) >= 0.1 THEN 0 ELSE 1 END AS breaks FROM vector_chunks WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)),
islands AS (SELECT *, sum(breaks) OVER (PARTITION BY document_id ORDER BY ordinal) AS island FROM steps)"""


@query(B.with_(B.VECTOR_CHUNKS, _ISLANDS) + "SELECT chunk_id, document_id, CAST(island AS BIGINT) AS island FROM islands")
def adjacent_islands(spark, sf_dir):
    return R.adjacent_islands(B.vector_chunks(spark, sf_dir), 0.1).select("chunk_id", "document_id", "island")


@query(B.with_(B.VECTOR_CHUNKS, _ISLANDS, "e AS (SELECT document_id, island, chunk_id % 3 + 1 AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS position FROM islands)") + """
SELECT document_id, CAST(island AS BIGINT) AS island, position, round(sum(x * w) / sum(w), 6) AS value FROM e GROUP BY 1, 2, 3""")
def merged_embeddings(spark, sf_dir):
    own = R.adjacent_islands(B.vector_chunks(spark, sf_dir), 0.1).withColumn("w0", F.col("chunk_id") % 3 + 1)
    return R.merged_embeddings(own, ["document_id", "island"], "w0").withColumn("value", F.round("value", 6))


@query(B.with_(B.VECTOR_CHUNKS) + """SELECT x.chunk_id AS a, y.chunk_id AS b, round(greatest(0, list_cosine_similarity(x.embedding, y.embedding)), 6) AS similarity FROM vector_chunks x JOIN vector_chunks y ON x.document_id = y.document_id AND x.chunk_id < y.chunk_id
WHERE round(greatest(0, list_cosine_similarity(x.embedding, y.embedding)), 6) >= 0.2""")
def near_duplicate_pairs(spark, sf_dir):
    return R.near_duplicate_pairs(B.vector_chunks(spark, sf_dir), 0.2, "document_id")


def _vector_candidates(spark, sf_dir):
    near = R.nearest_in_blocks(B.vector_chunks(spark, sf_dir), B.vector_queries(spark, sf_dir), 50)
    return near.join(B.vector_chunks(spark, sf_dir).select("chunk_id", "embedding", (F.col("label") % 3).alias("source")), "chunk_id")


@query()
def consolidate_greedy(spark, sf_dir):
    return R.consolidate(_vector_candidates(spark, sf_dir), 0.5)


@query()
def mmr_select(spark, sf_dir):
    return R.diversify(_vector_candidates(spark, sf_dir))


@query()
def hash_embedding(spark, sf_dir):
    own = B.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    return R.hash_embed(own).select("id", F.posexplode("embedding").alias("position", "value")).filter("value <> 0").withColumn("value", F.round("value", 6))


@query()
def embedding_batches(spark, sf_dir):
    own = B.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("turn").alias("position"), T.estimate_tokens(F.col("text")).alias("tokens"))
    return R.embedding_batches(own, 4, 2000)


_PLANNED = r"""q AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'please ' || substring(text, 1, 30) || '?' WHEN 1 THEN 'compare ' || substring(text, 1, 10) || ' versus ' || substring(text, 20, 10) WHEN 2 THEN 'read report-12 of ' || substring(text, 1, 20) WHEN 3 THEN 'how does it work? why?' ELSE text END AS query FROM benchmark),
o AS (SELECT item_id, trim(regexp_replace(query, '\s+', ' ', 'g')) AS original FROM q),
n AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(original, '^(?:please|could you|can you)\s*', '', 'i'), '[?？]+\s*$', ''), '\s+', ' ', 'g')) AS normalized FROM o)"""


@query(B.with_(_PLANNED) + r"""SELECT item_id, CASE WHEN item_id % 5 = 1 THEN 'comparison' WHEN regexp_matches(original, '\b([A-Z]{2,}[A-Z0-9._/-]*|[A-Za-z0-9_-]+\.(?:pdf|docx?|xlsx?|pptx?|md|txt)|[A-Za-z]+-[0-9]{2,})\b') THEN 'exact'
  WHEN length(original) >= 80 OR regexp_matches(original, '(?i)(how does|analy[sz]e|summari[sz]e)') OR len(regexp_extract_all(original, '[?？]')) > 1 THEN 'analysis' ELSE 'fact' END AS intent FROM n""")
def query_intent(spark, sf_dir):
    return _planned(spark, sf_dir).select("item_id", "intent")


def _planned(spark, sf_dir):
    t, i = F.col("text"), F.col("item_id") % 5
    q = F.when(i == 0, F.concat(F.lit("please "), F.substring(t, 1, 30), F.lit("?"))).when(i == 1, F.concat(F.lit("compare "), F.substring(t, 1, 10), F.lit(" versus "), F.substring(t, 20, 10))).when(i == 2, F.concat(F.lit("read report-12 of "), F.substring(t, 1, 20))).when(i == 3, "how does it work? why?").otherwise(t)
    return P.plan(B.read(spark, sf_dir, "benchmark").select("item_id", q.alias("query")), 200, 8, "answer")


@query()
def query_plan(spark, sf_dir):
    return _planned(spark, sf_dir).select("item_id", "intent", "candidate_limit", "result_limit", "keyword_weight", "vector_weight", F.posexplode("variants").alias("position", "v")).select("*", "v.*").drop("v")


@query(B.with_(*_BASE, """first_hits AS (SELECT qid, min(rank) AS rank FROM keyword WHERE chunk_id % 3 = 0 GROUP BY qid)""") + """
SELECT k, avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall FROM (SELECT qid, rank FROM text_queries LEFT JOIN first_hits USING (qid)), (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k""")
def recall_at_k(spark, sf_dir):
    queries = B.text_queries(spark, sf_dir)
    hits = R.bm25(_texts(spark, sf_dir), queries, 20)
    return E.recall_at(hits.withColumn("relevant", F.col("chunk_id") % 3 == 0), queries.select("qid"), [1, 3, 5, 10])


@query(B.with_(*_BASE, """g AS (SELECT qid, rank, chunk_id % 4 AS rel FROM keyword), ideal AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS place FROM g),
i AS (SELECT qid, sum((pow(2, rel) - 1) / log2(place + 1)) AS idcg FROM ideal WHERE place <= 10 GROUP BY qid), d AS (SELECT qid, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg FROM g WHERE rank <= 10 GROUP BY qid)""") + """
SELECT qid, CASE WHEN idcg = 0 THEN 1.0 ELSE floor(dcg / idcg * 10000 + 0.5) / 10000 END AS ndcg FROM i JOIN d USING (qid)""")
def ndcg_at_k(spark, sf_dir):
    hits = R.bm25(_texts(spark, sf_dir), B.text_queries(spark, sf_dir), 20)
    return E.ndcg_at(hits.withColumn("relevance", F.col("chunk_id") % 4), 10)


@query("""WITH s AS (SELECT toxic, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS k FROM labels GROUP BY toxic), b AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM s)
SELECT toxic, n, k, round(greatest(0, ((p + z*z/(2*n)) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS low, round(least(1, ((p + z*z/(2*n)) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS high FROM b""")
def wilson(spark, sf_dir):
    from quern.functions.numbers import wilson as bound

    own = B.read(spark, sf_dir, "labels").groupBy("toxic").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    return own.select("toxic", "n", "k", F.round(bound(F.col("k"), F.col("n"), False), 6).alias("low"), F.round(bound(F.col("k"), F.col("n"), True), 6).alias("high"))


@query("""SELECT event_type, count(*) AS samples, round(sum(value), 2) AS total, floor(avg(value) * 100 + 0.5) / 100 AS mean, min(value) AS min, max(value) AS max, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type""")
def latency_distribution(spark, sf_dir):
    return E.distribution(B.read(spark, sf_dir, "events"), ["event_type"], "value")


@query()
def bootstrap_ci(spark, sf_dir):
    own = B.read(spark, sf_dir, "events").filter("event_type = 'purchase'").select((F.col("user_id") % 4).alias("group"), F.col("event_id").alias("position"), "value")
    return E.bootstrap(own, "mean", 200, 42)


@query("""WITH r AS (SELECT doc_id % 5 AS metric, count(*) FILTER (WHERE quality = 1) AS part, count(*) FILTER (WHERE toxic >= 0 AND doc_id % 2 = 0) AS whole FROM labels GROUP BY 1)
SELECT metric, part, whole, CASE WHEN whole = 0 THEN 1.0 ELSE round(part / whole, 6) END AS ratio FROM r""")
def evaluation_ratios(spark, sf_dir):
    from quern.functions.numbers import ratio

    own = B.read(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 5).alias("metric")).agg(F.count_if(F.col("quality") == 1).alias("part"), F.count_if(F.col("doc_id") % 2 == 0).alias("whole"))
    return own.withColumn("ratio", F.round(ratio(F.col("part"), F.col("whole"), 1.0), 6))


@query()
def extractive_answer(spark, sf_dir):
    queries = B.all_text_queries(spark, sf_dir)
    hits = R.bm25(_texts(spark, sf_dir), queries, 3).join(_texts(spark, sf_dir).select("chunk_id", "content"), "chunk_id")
    return N.extractive_answer(hits, queries)


_ANSWERS = """answers AS (SELECT conv_id * 1000 + turn AS id, CASE turn % 5 WHEN 0 THEN text || ' [1]' WHEN 1 THEN text || ' [2, 9]' WHEN 2 THEN text WHEN 3 THEN '## [1][1, 2]' ELSE text || '【2】 [1]' END AS answer, CASE WHEN conv_id % 6 = 0 THEN 0 ELSE 3 END AS n_hits FROM conversations)"""
_ORDINALS = r"""m AS (SELECT id, unnest(regexp_extract_all(answer, '[\[【]\d+(?:\s*[,，、]\s*\d+)*[\]】]')) AS g, generate_subscripts(regexp_extract_all(answer, '[\[【]\d+(?:\s*[,，、]\s*\d+)*[\]】]'), 1) AS i FROM answers),
p AS (SELECT id, i, CAST(unnest(regexp_extract_all(g, '\d+')) AS INTEGER) AS ordinal, generate_subscripts(regexp_extract_all(g, '\d+'), 1) AS j FROM m),
f AS (SELECT id, ordinal, min(i * 1000 + j) AS place FROM p GROUP BY id, ordinal)"""


def _answers(spark, sf_dir):
    k, t = F.col("turn") % 5, F.col("text")
    answer = F.when(k == 0, F.concat(t, F.lit(" [1]"))).when(k == 1, F.concat(t, F.lit(" [2, 9]"))).when(k == 2, t).when(k == 3, "## [1][1, 2]").otherwise(F.concat(t, F.lit("【2】 [1]")))
    return B.read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), answer.alias("answer"), F.when(F.col("conv_id") % 6 == 0, 0).otherwise(3).alias("n_hits"))


@query(B.with_(_ANSWERS, _ORDINALS) + "SELECT id, ordinal, row_number() OVER (PARTITION BY id ORDER BY place) AS position FROM f")
def citation_parse(spark, sf_dir):
    return _answers(spark, sf_dir).select("id", F.posexplode(T.citations(F.col("answer"))).alias("p", "ordinal")).select("id", "ordinal", (F.col("p") + 1).alias("position"))


@query(B.with_(_ANSWERS, _ORDINALS) + r"""SELECT a.id, CASE WHEN n_hits = 0 THEN 'no_evidence' WHEN count(*) FILTER (WHERE ordinal < 1 OR ordinal > n_hits) > 0 THEN 'invalid_citations' WHEN count(ordinal) = 0 THEN 'missing_citations'
  WHEN regexp_replace(regexp_replace(answer, '[\[【]\d+(?:\s*[,，、]\s*\d+)*[\]】]', '', 'g'), '[\s#>*_`~\-|:：]', '', 'g') = '' THEN 'empty_answer' END AS reason FROM answers a LEFT JOIN f USING (id) GROUP BY a.id, n_hits, answer""")
def grounding(spark, sf_dir):
    return N.grounding(_answers(spark, sf_dir)).select("id", "reason")


@query(r"""WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS so_far FROM t WHERE back <= 6)
SELECT conv_id, turn, tokens FROM s WHERE so_far <= 100""")
def conversation_history_window(spark, sf_dir):
    return N.history(B.read(spark, sf_dir, "conversations"), 6, 100).select("conv_id", "turn", "tokens")


@query()
def prompt_packing(spark, sf_dir):
    hits = R.bm25(_texts(spark, sf_dir), B.all_text_queries(spark, sf_dir), 8).join(_texts(spark, sf_dir).select("chunk_id", T.estimate_tokens(F.col("content")).alias("tokens")), "chunk_id")
    return N.pack_prompt(hits.select("qid", "rank", "tokens"), 1500)


@query("""WITH h AS (SELECT doc_id // 40 AS qid, source AS location, doc_id AS rank, text AS content FROM documents)
SELECT qid, rank FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.qid = h.qid AND o.location = h.location AND contains(o.content, h.content) AND (length(o.content) > length(h.content) OR (length(o.content) = length(h.content) AND o.rank < h.rank)))""")
def contained_duplicates(spark, sf_dir):
    own = B.read(spark, sf_dir, "documents").select(F.expr("doc_id div 40").alias("qid"), F.col("source").alias("location"), F.col("doc_id").alias("rank"), F.col("text").alias("content"))
    return N.contained_duplicates(own).select("qid", "rank")


_CELLS = "SELECT p_partkey AS id, p_brand || '-' || (p_partkey // 500) AS sheet, p_size % 9 + 1 AS r1, p_size % 9 + 1 + p_partkey % 4 AS r2, p_partkey % 30 + 1 AS c1, p_partkey % 30 + 1 + p_size % 3 AS c2 FROM part"


@query(f"WITH c AS ({_CELLS}) SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.sheet = b.sheet AND a.r1 <= b.r2 AND b.r1 <= a.r2 AND a.c1 <= b.c2 AND b.c1 <= a.c2 AND a.id < b.id")
def a1_ranges_overlap(spark, sf_dir):
    s, p = F.col("p_size"), F.col("p_partkey")
    own = B.read(spark, sf_dir, "part").select(p.alias("id"), F.concat_ws("-", "p_brand", F.expr("p_partkey div 500")).alias("sheet"), (s % 9 + 1).alias("r1"), (s % 9 + 1 + p % 4).alias("r2"), (p % 30 + 1).alias("c1"), (p % 30 + 1 + s % 3).alias("c2"))
    return N.ranges_overlap(own, own).filter("a < b")


@query(B.with_(B.VECTOR_CHUNKS) + "SELECT a.chunk_id AS id, round(greatest(0, least(1, list_cosine_similarity(a.embedding, b.embedding))), 6) AS similarity FROM vector_chunks a JOIN vector_chunks b ON b.chunk_id = a.chunk_id + 1")
def cosine_similarity(spark, sf_dir):
    own = B.vector_chunks(spark, sf_dir)
    other = own.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("embedding").alias("next"))
    return own.join(other, "chunk_id").select(F.col("chunk_id").alias("id"), F.round(V.similarity(F.col("embedding"), F.col("next")), 6).alias("similarity"))
