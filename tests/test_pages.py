"""Search pages, recall in blocks and by inverted lists, and text searches over all items, against plain versions."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import pages as G
from quern.operators import retrieval as R
from quern.operators import vectors as X
from quern.plans import bindings as B
from quern.plans import catalog
from tests.oracle import DATA, compare

CANDIDATE = "qid long, chunk_id long, document_id long, source string, ordinal long, content string, content_hash string, offset_start long, offset_end long, embedding array<double>, score double, rank int"


def candidate(chunk, score=0.8, ordinal=1, source="s", content=None, start=0, end=None, hash_=None, embedding=(1.0, 0.0), document=1, qid=1, rank=None):
    content = f"text {chunk}" if content is None else content
    return (qid, chunk, document, source, ordinal, content, f"hash {chunk}" if hash_ is None else hash_, start, start + len(content) if end is None else end, list(embedding), score, rank or chunk)


def shown(spark, rows, **options):
    return G.page_of(spark.createDataFrame(rows, CANDIDATE), **{"threshold": 0.92, "trade": 1.0} | options).orderBy("qid", "position").collect()


def test_equal_hashes_keep_the_better_score(spark):
    got = shown(spark, [candidate(1, 0.7, hash_="same"), candidate(2, 0.9, hash_=" same ", ordinal=9, embedding=(0.0, 1.0)), candidate(3, 0.1, hash_="", ordinal=20, source="t"), candidate(4, 0.1, hash_="", ordinal=30, source="u")])
    assert [r.chunk_id for r in got] == [2, 3, 4] and got[0].exact_removed == 1 and got[0].total == 3


def test_similar_neighbours_merge_by_their_offsets(spark):
    got = shown(spark, [candidate(1, 0.8, 1, content="abcdefghij"), candidate(2, 0.9, 2, content="ijKLMN", start=8, embedding=(0.99, 0.01)), candidate(3, 0.7, 4, content="far", source="t")])
    assert [(r.chunk_id, r.content, r.offset_start, r.offset_end, r.ordinal_start, r.ordinal_end, r.members) for r in got] == [(2, "abcdefghijKLMN", 0, 14, 1, 2, 2), (3, "far", 0, 3, 4, 4, 1)]
    assert got[0].merged == 1


def test_contents_that_do_not_overlap_and_covered_ones(spark):
    got = shown(spark, [candidate(1, 0.9, 1, content="one\n"), candidate(2, 0.8, 2, content="two", start=4), candidate(3, 0.7, 3, content="wo", start=5, end=7), candidate(4, 0.6, 4, content="three", start=10)])
    assert [r.content for r in got] == ["one\ntwo\n\nthree"] and got[0].members == 4


def test_near_duplicates_of_a_source_go_and_those_of_others_stay(spark):
    near = (0.99, 0.01)
    assert [(r.chunk_id, r.near_removed) for r in shown(spark, [candidate(1, 0.9, 1), candidate(2, 0.7, 4, embedding=near)])] == [(1, 1)]
    got = shown(spark, [candidate(1, 0.9, 1), candidate(2, 0.7, 4, embedding=near, source="other")])
    assert [r.chunk_id for r in got] == [1, 2] and got[0].cross_source == 1
    # neighbours are no duplicates of each other, even where they weren't merged
    got = shown(spark, [candidate(1, 0.9, 1, embedding=(1.0, 0.0)), candidate(2, 0.8, 2, embedding=(0.6, 0.8)), candidate(3, 0.7, 3, embedding=(0.99, 0.14))], threshold=0.95)
    assert [r.chunk_id for r in got] == [1, 2]


def plain_page(rows, threshold, trade, page, size):
    cos = lambda a, b: max(0.0, min(1.0, float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))))) if np.linalg.norm(a) and np.linalg.norm(b) else 0.0
    rows = sorted(rows, key=lambda r: (-r["score"], r["rank"]))
    seen, unique = set(), []
    for r in rows:
        if r["content_hash"] not in seen:
            seen.add(r["content_hash"])
            unique.append(dict(r, start=r["ordinal"], stop=r["ordinal"], parts=[r]))
    islands = []
    for s in dict.fromkeys(r["source"] for r in unique):
        run = None
        for r in sorted((r for r in unique if r["source"] == s), key=lambda r: r["ordinal"]):
            if run and run[-1]["ordinal"] + 1 == r["ordinal"] and cos(run[-1]["embedding"], r["embedding"]) >= threshold:
                run.append(r)
            else:
                run = [r]
                islands.append(run)
    whole = []
    for run in islands:
        best = min(run, key=lambda r: (-r["score"], r["rank"]))
        w = np.array([max(1, len(r["content"])) for r in run], float)
        v = np.array([r["embedding"] for r in run])
        whole.append(dict(best, start=run[0]["ordinal"], stop=run[-1]["ordinal"], n=len(run), embedding=(v * w[:, None]).sum(0) / w.sum() if len(run) > 1 else v[0]))
    kept = []
    for r in sorted(whole, key=lambda r: r["rank"]):
        near = [k for k in kept if cos(r["embedding"], k["embedding"]) >= threshold]
        if not any(k["source"] == r["source"] and not (k["document_id"] == r["document_id"] and (k["stop"] + 1 == r["start"] or r["stop"] + 1 == k["start"])) for k in near):
            kept.append(r)
    chosen = []
    while len(chosen) < min(page * size, len(kept)):
        gain = lambda r: trade * r["score"] - (1 - trade) * max((cos(r["embedding"], c["embedding"]) for c in chosen), default=0)  # noqa: B023, E731
        chosen.append(max((r for r in kept if not any(r is c for c in chosen)), key=gain))
    return [(r["chunk_id"], r["n"]) for r in chosen[(page - 1) * size : page * size]], len(kept)


@pytest.mark.parametrize(("page", "size"), [(1, 5), (2, 4), (9, 10)])
def test_pages_equal_the_plain_rules(spark, page, size):
    rng = np.random.default_rng(page)
    rows, names = [], [f.split()[0] for f in CANDIDATE.split(", ")]
    for q in range(6):
        for i, score in enumerate(np.sort(rng.random(40))[::-1]):
            v = np.round(rng.normal(size=4), 3) if rng.random() < 0.5 else np.round([1, 0.1 * rng.random(), 0, 0.1 * rng.random()], 3)
            rows.append((q, i, int(rng.integers(3)), f"s{rng.integers(3)}", int(rng.integers(60)) * 40 + i if rng.random() < 0.5 else i, "x" * int(rng.integers(1, 9)), f"h{rng.integers(60)}", 0, 9, v.tolist(), float(np.round(score, 4)), i))
    got = defaultdict(list)
    for r in shown(spark, rows, page=page, size=size, trade=0.6, threshold=0.9):
        got[r.qid].append(((r.chunk_id, r.members), r.total))
    for q in range(6):
        want, total = plain_page([dict(zip(names, r, strict=True)) for r in rows if r[0] == q], 0.9, 0.6, page, size)
        assert [x for x, _ in got[q]] == want and {t for _, t in got[q]} <= {total}


def test_bad_pages_are_refused(spark):
    for bad in ({"page": 0}, {"trade": 1.5}, {"threshold": -0.1}, {"size": 0}):
        with pytest.raises(ValueError):
            shown(spark, [candidate(1)], **bad)
    with pytest.raises(ValueError):
        R.diversify(spark.createDataFrame([(1, 1, 1, 1.0, [1.0])], "qid long, chunk_id long, rank int, score double, embedding array<double>"), 1.1)


def test_variants_share_one_scan_and_weights_count(spark):
    chunks = spark.createDataFrame([(1, "apple pear", [1.0, 0.0]), (2, "apple", [0.0, 1.0]), (3, "pear", [0.7, 0.7]), (4, "plum", None)], "chunk_id long, content string, embedding array<double>")
    variants = spark.createDataFrame([(1, 8, "apple", 1.0, True, 10, 1.0, 1.1), (1, 9, "pear", 0.95, False, 10, 1.0, 1.1), (2, 16, "plum", 0.0, False, 10, 1.0, 1.1), (3, 24, "apple pear", 1.0, False, 1, 1.0, 1.1)], "qid long, vid long, text string, weight double, use_vector boolean, candidate_limit int, keyword_weight double, vector_weight double")
    vectors = spark.createDataFrame([(8, [1.0, 0.0]), (9, [0.0, 1.0])], "vid long, query_vector array<double>")
    got = {(r.qid, r.chunk_id): (r.rank, r.score) for r in G.recall(chunks, variants, vectors, 10).collect()}
    keyword = {1: 1 / 62 + 0.95 / 62, 2: 1 / 61, 3: 0.95 / 61}
    order = sorted(keyword, key=lambda c: -keyword[c])
    near = [1, 3, 2]
    score = {c: 1 / (61 + order.index(c)) + 1.1 / (61 + near.index(c)) for c in (1, 2, 3)}
    best = sorted(score, key=lambda c: -score[c])
    assert {c: (got[1, c][0], round(got[1, c][1], 6)) for c in (1, 2, 3)} == {c: (best.index(c) + 1, round(score[c], 6)) for c in (1, 2, 3)}
    assert Counter(q for q, _ in got) == {1: 3, 3: 1}


# recall


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(30, 8)) + 3 * c for c in rng.normal(size=(40, 8))]).round(3)
    x[5], x[6] = x[4], 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [None] * 8), (None, x[0].tolist())]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>"), x


def plain_nearest(x, qids, k):
    u = X.unit(x)
    out = {}
    for q in qids:
        s = np.round(u @ u[q], 6)
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
        out[q] = [(int(i), float(s[i])) for i in order]
    return out


@pytest.mark.parametrize(("rows", "block"), [(10**6, 10**6), (100, 7), (1, 1000)])
def test_blocks_and_slices_give_the_exact_neighbours(spark, cloud, rows, block):
    chunks, x = cloud
    qids = list(range(0, len(x), 40 if rows > 1 else 400))
    queries = chunks.filter(F.col("chunk_id").isin(qids)).select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("query_vector"))
    got = defaultdict(list)
    for r in X.exact(chunks, queries, 5, rows=rows, block=block).orderBy("qid", "rank").collect():
        got[r.qid].append((r.chunk_id, r.score))
    assert got == plain_nearest(x, qids, 5)


def test_many_queries_need_no_more_jobs(spark, cloud):
    chunks, _ = cloud
    queries = chunks.filter("chunk_id is not null and chunk_id < 5000").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("query_vector"))
    plans = [R.nearest_in_blocks(chunks, queries.filter(F.col("qid") < n), 3, size=10)._jdf.queryExecution().optimizedPlan().toString() for n in (20, 1000)]
    assert plans[0].count("\n") == plans[1].count("\n")
    clean = chunks.filter("chunk_id < 5000")
    few, many = R.nearest_in_blocks(clean, queries.filter("qid < 8"), 3, size=10), X.exact(chunks, queries.filter("qid < 8"), 3)
    assert Counter(map(tuple, few.collect())) == Counter(map(tuple, many.collect()))


def test_inverted_lists_cover_all_rows_and_find_nearly_all(spark, cloud):
    chunks, x = cloud
    lists = X.fit(chunks, k=5)
    assert 1 <= lists.probes <= len(lists.centroids)
    indexed = X.index(chunks, lists)
    assert sorted(r.chunk_id for r in indexed.collect()) == list(range(len(x)))
    qids = list(range(0, len(x), 20))
    queries = chunks.filter(F.col("chunk_id").isin(qids)).select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("query_vector"))
    want = plain_nearest(x, qids, 5)
    for options in ({}, {"rows": 9, "block": 4}):
        got = Counter((r.qid, r.chunk_id) for r in X.search(indexed, queries, lists, 5, **options).collect())
        assert sum((q, c) in got for q in qids for c, _ in want[q]) >= 0.9 * 5 * len(qids) and max(got.values()) == 1
    every = X.Lists(lists.centroids, len(lists.centroids))
    got = Counter((r.qid, r.chunk_id) for r in X.search(indexed, queries, every, 5, rows=50, block=10).collect())
    assert got == Counter((q, c) for q in qids for c, _ in want[q])
    assert X.search(X.index(chunks.limit(0), X.fit(chunks.limit(0))), queries.limit(0), X.fit(chunks.limit(0)), 5).count() == 0


def test_lists_find_nine_tenths_on_the_given_vectors(spark):
    data = DATA.replace("0.001", "0.01")
    pairs = lambda name: {(r.qid, r.chunk_id) for r in catalog.queries()[name](spark, data).collect()}
    want = pairs("knn_topk")
    assert len(want & pairs("knn_inverted_lists")) >= 0.9 * len(want)


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_fields", "lexical_rerank", "ndcg_at_k", "recall_at_k", "rrf_two_channels", "hybrid_search", "search_fusion", "search_relevant", "search_merged"])
@pytest.mark.parametrize("few", [True, False])
def test_all_items_as_queries(spark, monkeypatch, name, few):
    if not few and name not in ("bm25_topk", "search_relevant"):
        pytest.skip("one way of sending terms is enough")
    monkeypatch.setattr(R, "BROADCAST_ROWS", 500_000 if few else 1)
    monkeypatch.setattr(B, "text_queries", B.all_text_queries)
    compare(spark, catalog.queries()[name], catalog.oracle_sql()[name].replace("WHERE item_id % 50 = 0", ""))
