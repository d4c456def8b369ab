"""The pipeline on odd rows: nulls, empty and long texts, repeated rows and ids, clashing names, and an empty table."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from tests.llm.test_llm import DATA, empty, odd, rows_of  # noqa: F401  fixtures


def tables(spark, docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_odd_rows_pass_all_stages(spark, odd, tmp_path):  # noqa: F811
    names = odd.columns
    kept = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = spark.createDataFrame(stage(spark, before, DATA).collect(), before.schema)
        assert kept.columns == names
        assert not [r for r in rows_of(kept) if r not in set(rows_of(before))]
    rows = rows_of(kept)
    # one empty text, one of each group of copies, one of the near copies of 100 to 139
    blank = [t for _, t in rows if not (t or "").strip(" \t\n\x0b\x0c\r")]
    assert len(blank) == 1 and len({"".join((t or "").split()) for _, t in rows}) == len(rows)
    assert {6, 7, 400} <= {i for i, _ in rows} and len([i for i, _ in rows if i and 100 <= i < 140]) < 40
    got = corpus_pipeline.run(spark, tables(spark, odd, tmp_path)).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.decoded_sha256) for r in got) == sorted((i is None, i or 0, sha(t)) for i, t in rows)


def test_an_empty_table(spark, empty, tmp_path):  # noqa: F811
    assert corpus_pipeline.run(spark, tables(spark, empty, tmp_path)).count() == 0
