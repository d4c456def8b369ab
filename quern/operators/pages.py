"""A page of search results, from weighted variants of each query to diversified, paged hits with their counters.

Recall: all variants of all queries go through one scan of the texts and share its postings. Fusion has two levels: the
variants of a channel by their weights, then the channels by the plan's. What follows works on a query's window of
candidates (500 at most): preparation, reranking, threshold, consolidation, diversity and the page. Windows and
aggregations do all but the two greedy steps, in partitions by query; these two are one group a query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import retrieval as R

# The fields that tell sources apart.
SOURCE = ("version_id", "type", "page", "slide", "sheet", "row_start", "row_end", "heading", "table_id", "figure_id")
PAGE = (
    "qid long, position int, chunk_id long, document_id long, score double, content string, offset_start long, offset_end long, ordinal_start long, ordinal_end long, members int, "
    "total int, exact_removed int, merged int, near_removed int, cross_source int"
)


def source_identity(columns: dict[str, Column]) -> Column:
    """What sources are equal by, as one value; fields that are not given are missing for all."""
    return F.to_json(F.struct(*(columns.get(n, F.lit(None).cast("string")).alias(n) for n in SOURCE)), {"ignoreNullFields": "false"})


def exploded(planned: DataFrame) -> DataFrame:
    """(qid, vid, text, weight, use_vector, candidate_limit, keyword_weight, vector_weight): the variants of plans."""
    rows = planned.select("qid", "candidate_limit", "keyword_weight", "vector_weight", F.posexplode("variants").alias("place", "v"))
    return rows.select("qid", (F.col("qid") * 8 + F.col("place")).alias("vid"), "v.text", "v.weight", "v.use_vector", "candidate_limit", "keyword_weight", "vector_weight")


def recall(chunks: DataFrame, variants: DataFrame, vectors: DataFrame, limit: int = 500, fields: dict[str, float] | None = None, own_vectors: DataFrame | None = None, within: DataFrame | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank): candidates of each query. variants as exploded() gives them; vectors: (vid,
    query_vector). Each variant recalls as many as the query's candidate_limit, limit at most.

    own_vectors: (chunk_id, embedding), where chunks do not have them: texts are not shuffled to meet their vectors.
    within: (chunk_id) of the chunks whose texts are searched, if not all."""
    own = variants.select("qid", "vid", "weight", "candidate_limit", "keyword_weight", "vector_weight", "use_vector")
    plans = own.groupBy("qid").agg(*(F.max(c).alias(c) for c in ("candidate_limit", "keyword_weight", "vector_weight")))

    def channel(found: DataFrame, name: str) -> DataFrame:
        ranked = found.withColumnRenamed("qid", "vid").join(own, "vid").filter(F.col("rank") <= F.col("candidate_limit"))
        return R.fuse(ranked.select("qid", "chunk_id", "rank", "weight")).join(plans, "qid").select("qid", "chunk_id", "rank", F.col(f"{name}_weight").alias("weight"))

    keyword = R.bm25(chunks, variants.select(F.col("vid").alias("qid"), F.col("text").alias("query")), limit, fields, within)
    asked = vectors.join(own.filter("use_vector").select("vid"), "vid", "left_semi").select(F.col("vid").alias("qid"), "query_vector")
    embedded = chunks if own_vectors is None else own_vectors.join(chunks.select("chunk_id"), "chunk_id")
    vector = R.nearest_in_blocks(embedded.filter(F.col("embedding").isNotNull()), asked, limit, exclude_self=False)
    fused = R.fuse(channel(keyword, "keyword").unionByName(channel(vector, "vector")))
    fused = fused.join(plans.select("qid", "candidate_limit"), "qid").filter(F.col("rank") <= F.col("candidate_limit")).drop("candidate_limit")
    # the plans' windows bound the candidates: below the bound they go to the texts
    most = plans.agg(F.sum("candidate_limit")).first()[0] or 0
    return F.broadcast(fused) if most <= R.BROADCAST_ROWS else fused


def merged(candidates: DataFrame, threshold: float) -> DataFrame:
    """Candidates (qid, chunk_id, document_id, source, ordinal, content, content_hash, offset_start, offset_end,
    embedding, score, rank) after two steps: of equal hashes (missing or empty ones are never equal) the best stays, and
    neighbours of a source that are as similar as the threshold to the one before become one.

    A merged candidate has the id, score and rank of its best member, the contents without what their offsets overlap (a
    blank line between others), and the mean of the vectors weighted by length. Adds ordinal_start, ordinal_end, members
    and exact_removed, the query's number of copies.
    """
    best = [F.desc("score"), "rank"]
    rows = candidates.repartition("qid").withColumn("hash", F.nullif(F.trim("content_hash"), F.lit("")))
    same = Window.partitionBy("qid", F.coalesce("hash", F.concat(F.lit("id "), F.col("chunk_id").cast("string")))).orderBy(*best)
    of_query = Window.partitionBy("qid")
    rows = rows.withColumn("nth", F.row_number().over(same)).withColumn("exact_removed", F.count_if(F.col("nth") > 1).over(of_query)).filter("nth = 1")
    w = Window.partitionBy("qid", "source").orderBy("ordinal", "rank")
    follows = (F.col("ordinal") == F.lag("ordinal").over(w) + 1) & (V.similarity(F.col("embedding"), F.lag("embedding").over(w)) >= threshold)
    rows = rows.withColumn("breaks", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("breaks").over(w))
    inside = Window.partitionBy("qid", "source", "island").orderBy("ordinal")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    content, size = F.col("content"), F.length("content")
    reached = F.max("offset_end").over(before)
    overlap = F.greatest(F.lit(0), reached - F.col("offset_start")).cast("int")
    rows = rows.withColumn("reached", reached).withColumn("overlap", overlap).withColumn("added", F.col("reached").isNull() | (F.col("overlap") < size))
    ended = F.coalesce(F.last(F.when(F.col("added") & (size > 0), content.endswith("\n")), ignorenulls=True).over(before), F.lit(False))
    piece = (
        F.when(F.col("reached").isNull(), content).when(~F.col("added"), "").when(F.col("overlap") > 0, F.substr(content, F.col("overlap") + 1))
        .otherwise(F.concat(F.when(ended, "").otherwise("\n\n"), content))
    )
    rows = rows.withColumn("piece", piece).withColumn("w", F.greatest(F.lit(1), size).cast("double"))
    members = F.sort_array(F.collect_list(F.struct("ordinal", "piece", "w", "embedding")))
    first = F.struct(*("score", (-F.col("rank")).alias("back")))
    grouped = rows.groupBy("qid", "source", "island").agg(
        members.alias("m"), F.max_by(F.struct("chunk_id", "document_id", "score", "rank"), first).alias("best"), F.min("ordinal").alias("ordinal_start"), F.max("ordinal").alias("ordinal_end"),
        F.min("offset_start").alias("offset_start"), F.max("offset_end").alias("offset_end"), F.count("*").cast("int").alias("members"), F.max("exact_removed").cast("int").alias("exact_removed"),
    )
    zero = F.transform(F.col("m")[0]["embedding"], lambda x: F.lit(0.0))
    total = F.aggregate("m", F.lit(0.0), lambda a, x: a + x["w"])
    sums = F.aggregate("m", zero, lambda a, x: F.zip_with(a, x["embedding"], lambda s, e: s + e * x["w"]))
    equal = F.forall("m", lambda x: F.size(x["embedding"]) == F.size(F.col("m")[0]["embedding"]))
    vector = F.when((F.col("members") > 1) & equal, F.transform(sums, lambda s: s / total)).otherwise(F.col("m")[0]["embedding"])
    return grouped.select("qid", "source", "best.*", F.array_join(F.transform("m", lambda x: x["piece"]), "").alias("content"), "offset_start", "offset_end", "ordinal_start", "ordinal_end", "members", vector.alias("embedding"), "exact_removed")


def _greedy(pdf: pd.DataFrame, threshold: float, trade: float, page: int, size: int) -> pd.DataFrame:
    """Near duplicates of a source go, best first; then by relevance and novelty; then the page."""
    pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
    d = max(map(len, pdf["embedding"]), default=0)
    x = np.array([e if len(e) == d else [0.0] * d for e in pdf["embedding"]], float).reshape(len(pdf), d)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    alike = np.clip(x @ x.T, 0, 1)
    source, version = pdf["source"].to_numpy(), pdf["document_id"].to_numpy()
    start, end = pdf["ordinal_start"].to_numpy(), pdf["ordinal_end"].to_numpy()
    kept, cross = [], 0
    for i in range(len(pdf)):
        near = [j for j in kept if alike[i, j] >= threshold]
        adjacent = lambda j: version[i] == version[j] and (end[i] + 1 == start[j] or end[j] + 1 == start[i])  # noqa: B023, E731
        if any(source[i] == source[j] and not adjacent(j) for j in near):
            continue
        cross += any(source[i] != source[j] for j in near)
        kept.append(i)
    relevance, most, chosen = np.clip(pdf["score"].to_numpy(float)[kept], 0, 1), np.zeros(len(kept)), []
    for _ in range(min(page * size, len(kept))):
        gain = trade * relevance - (1 - trade) * most
        gain[chosen] = -np.inf
        chosen.append(int(np.argmax(gain)))
        most = np.maximum(most, alike[kept][:, kept][chosen[-1]])
    shown = chosen[(page - 1) * size : page * size]
    out = pdf.iloc[[kept[i] for i in shown]].copy()
    out["position"] = np.arange(len(shown)) + (page - 1) * size + 1
    out["total"], out["merged"], out["near_removed"], out["cross_source"] = len(kept), int((pdf["members"] - 1).sum()), len(pdf) - len(kept), cross
    return out[[f.split()[0] for f in PAGE.split(", ")]]


def page_of(candidates: DataFrame, threshold: float = 0.92, trade: float = 0.7, page: int = 1, size: int = 10) -> DataFrame:
    """PAGE: one page of each query's consolidated and diversified candidates (columns as merged() takes them). The window
    is fixed: diversity runs to the end of the page, total counts what is left of the window, and the counters tell what
    went. A page beyond the window has no rows."""
    if not (0 <= threshold <= 1 and 0 <= trade <= 1 and page >= 1 and size >= 1):
        raise ValueError("threshold and trade are between 0 and 1, page and size 1 at least")
    return merged(candidates, threshold).groupBy("qid").applyInPandas(lambda pdf: _greedy(pdf, threshold, trade, page, size), PAGE)


def relevant(fused: DataFrame, chunks: DataFrame, queries: DataFrame, score_threshold: float = 0.0, per_document: int = 3, rerank_limit: int = 50) -> DataFrame:
    """Fused candidates, hydrated (ids without a row drop out), prepared, reranked by terms and above the threshold: with
    the columns of chunks, score and rank in the order of the reranker."""
    rows = fused.select("qid", "chunk_id", "rank").join(chunks, "chunk_id")
    prepared = R.rerank_candidates(rows, per_document, rerank_limit)
    ranked = R.with_lexical_scores(prepared.drop("rank"), queries).filter(F.col("score") > score_threshold)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "position"))).drop("position")


def search_page(chunks: DataFrame, queries: DataFrame, planned: DataFrame, vectors: DataFrame, page: int = 1, size: int = 10, fields: dict[str, float] | None = None, own_vectors: DataFrame | None = None, **options: float) -> DataFrame:
    """PAGE for queries (qid, query) with their plans: recall, fusion, reranking, consolidation, diversity.

    chunks: (chunk_id, document_id, source, title, content, content_hash, ordinal, offset_start, offset_end, embedding).
    Plans are read several times: give them as a table. With own_vectors, (chunk_id, embedding), chunks have no embedding,
    and those without a vector are left out.
    """
    own = None if own_vectors is None else own_vectors.filter(F.col("embedding").isNotNull())
    fused = recall(chunks, exploded(planned), vectors, fields=fields, own_vectors=own, within=None if own is None else own.select("chunk_id"))
    keep = {k: options.pop(k) for k in ("score_threshold", "per_document", "rerank_limit") if k in options}
    found = relevant(fused, chunks, queries, **keep)
    return page_of(found if own is None else found.join(own, "chunk_id"), page=page, size=size, **options)
