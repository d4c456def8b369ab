"""Queries without SQL over whole tables, against plain Python."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from quern.operators import retrieval as R
from quern.plans import bindings as B
from quern.plans import catalog
from tests.oracle import DATA


def test_rerank_budget_takes_all_chunks(spark, tmp_path):
    docs = [(i, f"head {i % 9}\n\n" + "\n".join(f"{'Word' if i % 2 else 'word'} {j % 4} " + f"w{i} " * (j * 5) for j in range(i % 7))) for i in range(95)]
    spark.createDataFrame([*docs, (95, None), (96, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    chunks = defaultdict(list)
    for d, text in docs:
        for n, line in enumerate(text.split("\n"), 1):
            if line.strip(" "):
                chunks[d // 10].append((n % 5, d, n, line))
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, lines)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for q, own in chunks.items():
        seen, taken, used, place = set(), defaultdict(int), len(e.encode_ordinary(f"what of group {q}")), 0
        for _, d, n, line in sorted(own):
            h = hashlib.sha256(line.lower().encode()).digest()
            ids, left = e.encode_ordinary(f"document {d}\n{line}"), 200 - used - 4
            if h in seen or taken[d] >= 3 or place >= 12 or left <= 0:
                continue
            place += 1
            want.append((q, f"{d}:{n}", place, min(len(ids), left), len(ids) > left))
            seen.add(h)
            taken[d] += 1
            used += min(len(ids), left) + 4
    got = catalog.queries()["rerank_prepare_budget"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {q for q, *_ in want} == set(range(10))


@pytest.mark.parametrize("name", ["extractive_answer", "prompt_packing"])
def test_all_benchmark_items_are_queries(spark, name):
    items = {r.item_id for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    assert {r.qid for r in catalog.queries()[name](spark, DATA).collect()} == items


@pytest.mark.parametrize("name", ["consolidate_greedy", "mmr_select"])
def test_vectors_divisible_by_fifty_are_queries(spark, name):
    ids = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect() if r.vec_id % 50 == 0}
    assert {r.qid for r in catalog.queries()[name](spark, DATA).collect()} == ids


def test_text_queries_are_whole(spark):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    assert {r.qid: r.query for r in B.all_text_queries(spark, DATA).collect()} == texts


def test_nearest_in_blocks_against_plain_search(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)).round(2)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>").repartition(3)
    queries = chunks.filter("chunk_id % 5 = 0").selectExpr("chunk_id as qid", "embedding as query_vector")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    want = {(q, c, r) for q in range(0, 60, 5) for r, c in enumerate(sorted((c for c in range(60) if c != q), key=lambda c: (-s[q, c], c))[:7], 1)}
    for size in (1, 5, 12, 100):
        got = R.nearest_in_blocks(chunks, queries, 7, size=size).collect()
        assert len(got) == len(want) and {(r.qid, r.chunk_id, r["rank"]) for r in got} == want
