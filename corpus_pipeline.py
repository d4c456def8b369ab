"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Edge cases, as the operators state them: null text counts as empty. Toxicity keeps rows without evidence, so empty
texts and, without positive labels, all rows. Exact dedup leaves one row of each group of equal texts, so one empty
text, and one of rows that repeat. The n-gram join leaves one row of each group of near copies; documents without words
all stay. Decontamination keeps documents with fewer words than a seed. Ties go to the smallest doc_id (null last).
Very long texts pass whole. An empty table gives an empty result. Extra columns, whatever their names, pass all stages
but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from quern.llm.common import materialize, scratch_scope, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep(spark, docs)


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_overlaps),
    ("byte-level BPE", encode),
]
#: Learned and iterative stages are beyond SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark) as passing:
            out = stage(spark, docs, sf_dir)
            with scratch_scope(spark) as own:
                docs = materialize(spark, out, f"stage-{name.replace(' ', '-')}")
        # the stage's table is written: what led to it can go
        passing.delete()
        if before is not None:
            before.delete()
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
