"""Recall and ranking: BM25, nearest neighbours, rank fusion, reranking, consolidation, diversity, facets."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import tokens
from quern.functions import vectors as V
from quern.operators import vectors
from quern.operators.parts import parts

K1, B = 1.2, 0.75
RANK_CONSTANT = 60
#: Queries by chunks that a vector recall broadcasts its queries for; larger query sets go in blocks of as many.
MAX_QUERIES = 10_000
#: Rows (query, term) that keyword recall broadcasts at most.
BROADCAST_ROWS = 500_000
#: Chunks of a task of keyword recall, about; each has up to a score for every query.
CHUNKS = 500


def bm25(chunks: DataFrame, queries: DataFrame, k: int, fields: dict[str, float] | None = None, within: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): the best k chunks of each query; any term may match, the best boosted field counts.

    Only terms of the queries leave the scan: document frequencies are counted on them alone. The terms and their
    weights are broadcast where a count finds at most BROADCAST_ROWS of them, and shuffled beyond. within: (chunk_id) of the
    chunks that count, if not all; they meet lengths and postings, not texts, unless they are few enough to broadcast.
    """
    late = lambda df: df
    if within is not None and within.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        chunks = chunks.join(F.broadcast(within), "chunk_id")
    elif within is not None:
        late = lambda df: df.join(within, "chunk_id")
    fields = fields or {"content": 1.0}
    terms = queries.select("qid", F.explode(F.array_distinct(T.words(F.col("query")))).alias("term"))
    boost = F.coalesce(*(F.when(F.col("field") == n, F.lit(float(w))) for n, w in fields.items()))
    lengths = None
    for name in fields:
        one = late(chunks.select("chunk_id", F.lit(name).alias("field"), F.size(T.words(F.col(name))).alias("dl"))).groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        lengths = one if lengths is None else lengths.unionByName(one)
    hits = None
    for name in fields:
        own = chunks.select("chunk_id", F.lit(name).alias("field"), T.words(F.col(name)).alias("ws"))
        own = own.select("chunk_id", "field", F.size("ws").alias("dl"), F.explode("ws").alias("term"))
        hits = own if hits is None else hits.unionByName(own)
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = F.broadcast if few else lambda df: df
    # a chunk's terms and scores meet in one part; only the best k of a part are shuffled again
    hits = late(hits.join(sent(terms.select("term").distinct()), "term", "left_semi")).repartition(parts(chunks.select("chunk_id"), CHUNKS), "chunk_id").groupBy("chunk_id", "field", "dl", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    weights = terms.join(df, "term").join(F.broadcast(lengths), "field").withColumn("idf", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    scored = hits.join(sent(weights.select("qid", "term", "field", "idf", "avgdl")), ["term", "field"])
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    by_field = scored.groupBy("qid", "chunk_id", "field").agg(F.sum(part).alias("s")).withColumn("s", F.col("s") * boost)
    best = by_field.groupBy("qid", "chunk_id").agg(F.round(F.max("s"), 6).alias("score"))
    return top(best, k)


def top(scored: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The best k of each query, ties by key. Spark keeps k rows a task before the exchange."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(chunks: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """(qid, chunk_id, score, rank): exact cosine neighbours of a stated set of query vectors.

    Batches of vectors meet the queries in products of a bounded size, and only a task's best k a query leave it.
    """
    qs = vectors.clean(queries, "qid", "query_vector").orderBy("qid").limit(MAX_QUERIES + 1).toArrow()
    if qs.num_rows > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} query vectors: search them in blocks")
    return top(vectors.scan(chunks, qs["qid"].to_numpy(), vectors.matrix(qs["query_vector"]), k, exclude_self), k)


def nearest_in_blocks(chunks: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, size: int = MAX_QUERIES) -> DataFrame:
    """nearest() of any number of query vectors: so many at most in one broadcast, more in blocks that meet slices of the
    vectors; the number of jobs is the same for any number."""
    if queries.limit(size + 1).count() <= size:
        return nearest(chunks, queries, k, exclude_self)
    return vectors.exact(chunks, queries, k, exclude_self, block=size)


def fuse(rankings: DataFrame, constant: int = RANK_CONSTANT, key: str = "chunk_id", limit: int | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of (qid, key, rank, weight): sum of weight / (constant + rank); weights of 0 or
    less are left out."""
    scores = rankings.filter("weight > 0").groupBy("qid", key).agg(F.round(F.sum(F.col("weight") / (F.lit(constant) + F.col("rank"))), 9).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def lexical_rerank(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, chunk_id, score): weight of the query's distinct terms found in the chunk over the weight of all; terms
    of one letter weigh a quarter."""
    weigh = F.when(F.length("term") == 1, 0.25).otherwise(1.0)
    terms = queries.select("qid", F.explode(F.array_distinct(tokens.tokenize_column("query"))).alias("term")).withColumn("w", weigh)
    whole = terms.groupBy("qid").agg(F.sum("w").alias("whole"))
    found = candidates.select("qid", "chunk_id", F.explode(F.array_distinct(tokens.tokenize_column("content"))).alias("term")).join(terms, ["qid", "term"]).groupBy("qid", "chunk_id").agg(F.sum("w").alias("part"))
    return candidates.select("qid", "chunk_id").join(found, ["qid", "chunk_id"], "left").join(whole, "qid").select("qid", "chunk_id", F.round(F.coalesce("part", F.lit(0.0)) / F.col("whole"), 6).alias("score"))


def with_lexical_scores(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """candidates with the score of lexical_rerank(), in one pass: a query's terms travel to its candidates as one array.
    A query without terms has no score."""
    weigh = lambda t: F.when(F.length(t) == 1, 0.25).otherwise(1.0)
    terms = queries.select("qid", F.array_distinct(tokens.tokenize_column("query")).alias("__terms"))
    rows = candidates.join(terms, "qid").withColumn("__found", tokens.tokenize_column("content"))
    weight = lambda some: F.aggregate(some, F.lit(0.0), lambda a, t: a + weigh(t))
    part, whole = weight(F.array_intersect("__terms", "__found")), weight(F.col("__terms"))
    return rows.withColumn("score", F.when(whole > 0, F.round(part / whole, 6))).drop("__terms", "__found")


def rerank_candidates(ranked: DataFrame, per_document: int, limit: int) -> DataFrame:
    """Without a token budget: one row of each content hash, then so many a document, then so many in all, by rank."""
    first = Window.partitionBy("qid", "content_hash").orderBy("rank")
    own = Window.partitionBy("qid", "document_id").orderBy("rank")
    whole = Window.partitionBy("qid").orderBy("rank")
    out = ranked.withColumn("n", F.row_number().over(first)).filter("n = 1")
    out = out.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= per_document)
    return out.withColumn("position", F.row_number().over(whole)).filter(F.col("position") <= limit).drop("n")


def pack_for_rerank(ranked: DataFrame, per_document: int, limit: int, most: int, path: str, pattern: str) -> DataFrame:
    """(qid, chunk_id, position, tokens, cut): with a budget of BPE tokens. In rank order, title, context and content of
    what is selected use up hash, document and budget, each with 4 tokens of framing; the query counts first, and a
    text is cut to what is left. path and pattern: the vocabulary's rank file.

    The rule is sequential, so a query's candidates are one group: the window of a recall, not a table of any size.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        count = lambda text: tokens.count_tokens(text, path, pattern)
        seen, docs, out, used = set(), Counter(), [], None
        for r in pdf.sort_values("rank").itertuples():
            used = count(r.query or "") if used is None else used
            if len(out) >= limit:
                break  # nothing after it is taken
            if (r.content_hash and r.content_hash in seen) or docs[r.document_id] >= per_document:
                continue
            left = most - used - 4
            whole = "\n".join(x for x in (r.title, r.context, r.content) if x)
            text = "" if left <= 0 else whole if count(whole) <= left else tokens.truncate_tokens(whole, left, path, pattern)
            if not text:
                continue
            size = count(text)
            out.append((r.qid, r.chunk_id, len(out) + 1, size, text != whole))
            used += size + 4
            seen.add(r.content_hash)
            docs[r.document_id] += 1
        return pd.DataFrame(out, columns=["qid", "chunk_id", "position", "tokens", "cut"])

    return ranked.select("qid", "query", "title", "context", "chunk_id", "document_id", "content", "content_hash", "rank").groupBy("qid").applyInPandas(run, "qid long, chunk_id string, position int, tokens int, cut boolean")


def exact_duplicates(candidates: DataFrame) -> DataFrame:
    """The best of each content hash."""
    w = Window.partitionBy("qid", "content_hash").orderBy(F.desc("score"), "chunk_id")
    return candidates.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def adjacent_islands(chunks: DataFrame, threshold: float) -> DataFrame:
    """Adds island: number of the run of chunks of a document, each following and similar to the one before."""
    w = Window.partitionBy("document_id").orderBy("ordinal")
    near = (F.col("ordinal") == F.lag("ordinal").over(w) + 1) & (V.similarity(F.col("embedding"), F.lag("embedding").over(w)) >= threshold)
    return chunks.withColumn("breaks", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("breaks").over(w)).drop("breaks")


def merged_embeddings(members: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """(keys, position, value): means of the members' vectors weighted by a column, not normalised again."""
    each = members.select(*keys, F.col(weight).alias("w"), F.posexplode("embedding").alias("position", "x"))
    return each.groupBy(*keys, "position").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("value"))


def near_duplicate_pairs(chunks: DataFrame, threshold: float, scope: str) -> DataFrame:
    """(a, b, similarity) within a scope column: the pairwise part of the consolidation of a query's candidates."""
    x = chunks.select(F.col(scope).alias("s"), F.col("chunk_id").alias("a"), F.col("embedding").alias("va"))
    y = chunks.select(F.col(scope).alias("s"), F.col("chunk_id").alias("b"), F.col("embedding").alias("vb"))
    both = x.join(y, "s").filter("a < b").withColumn("similarity", F.round(V.similarity(F.col("va"), F.col("vb")), 6))
    return both.filter(F.col("similarity") >= threshold).select("a", "b", "similarity")


def consolidate(candidates: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Greedy, best score first: a candidate goes if it is as similar as the threshold to one kept of the same source.
    Those of other sources stay and are counted. A query's candidates (500 at most) are one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "chunk_id"], ascending=[False, True])
        x = np.stack(pdf["embedding"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        kept, cross, source = [], [], pdf["source"].to_numpy()
        for i in range(len(pdf)):
            near = [j for j in kept if x[i] @ x[j] >= threshold]
            if any(source[j] == source[i] for j in near):
                continue
            kept.append(i)
            cross.append(len(near))
        out = pdf.iloc[kept]
        return pd.DataFrame({"qid": out["qid"], "chunk_id": out["chunk_id"], "position": range(1, len(kept) + 1), "cross_source": cross})

    return candidates.groupBy("qid").applyInPandas(run, "qid long, chunk_id long, position int, cross_source int")


def diversify(candidates: DataFrame, trade: float = 0.7, limit: int = 10) -> DataFrame:
    """Maximal marginal relevance: trade times relevance less the rest times the most similarity to what is selected;
    of ties the earlier candidate. trade is between 0 and 1. A query's candidates (500 at most) are one group."""
    if not 0 <= trade <= 1:
        raise ValueError("trade is between 0 and 1")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        x = np.stack(pdf["embedding"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        relevance = np.clip(pdf["score"].to_numpy(float), 0, 1)
        most, chosen = np.zeros(len(pdf)), []
        for _ in range(min(limit, len(pdf))):
            gain = trade * relevance - (1 - trade) * most
            gain[chosen] = -np.inf
            i = int(np.argmax(gain))
            chosen.append(i)
            most = np.maximum(most, np.clip(x @ x[i], 0, 1))
        out = pdf.iloc[chosen]
        return pd.DataFrame({"qid": out["qid"], "chunk_id": out["chunk_id"], "position": range(1, len(chosen) + 1)})

    return candidates.groupBy("qid").applyInPandas(run, "qid long, chunk_id long, position int")


def facets(hits: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n): distinct documents by value of each column."""
    docs = hits.dropDuplicates(["document_id"])
    each = docs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x"))
    return each.filter("x.value is not null").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def hash_embed(texts: DataFrame, dimension: int = 384) -> DataFrame:
    """(id, embedding): term counts at places and with signs that two 32-bit rolling hashes give, weights 1 + ln(tf), of
    unit length; zeros for a text without terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["content"]:
                v = np.zeros(dimension)
                for term, tf in Counter(tokens.tokenize(t or "")).items():
                    place, sign = tokens.place_and_sign(term, dimension)
                    v[place] += sign * (1 + np.log(tf))
                out.append(v / (np.linalg.norm(v) or 1.0))
            yield pd.DataFrame({"id": pdf["id"], "embedding": out})

    return texts.select("id", "content").mapInPandas(run, "id long, embedding array<double>")


def embedding_batches(items: DataFrame, most: int, most_tokens: int) -> DataFrame:
    """(group, id, batch): items of a group packed in order; a batch ends before it would exceed either bound."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        batch = n = tokens_ = 0
        out = []
        for r in pdf.sort_values("position").itertuples():
            if r.tokens > most_tokens:
                raise ValueError(f"item {r.id} exceeds {most_tokens} tokens")
            if n and (n == most or tokens_ + r.tokens > most_tokens):
                batch, n, tokens_ = batch + 1, 0, 0
            n, tokens_ = n + 1, tokens_ + r.tokens
            out.append((r.group, r.id, batch))
        return pd.DataFrame(out, columns=["group", "id", "batch"])

    return items.groupBy("group").applyInPandas(run, "group long, id long, batch int")


def missing_embeddings(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that the cache doesn't have."""
    return wanted.select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")
