"""Projections: rebuilds that die, replayed batches of access changes, answers that come too late."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.sources import projections as J

CHUNKS = "tenant_id string, document_id long, text string"
DOCUMENTS = "tenant_id string, document_id long, current_version_id string, status string, deleted boolean, acl_version int, reader string"
VERSIONS = "tenant_id string, document_id long, version_id string, ingestion_status string, markdown string"


def lines(versions):
    return versions.select("tenant_id", "document_id", F.explode(F.split("markdown", "\n")).alias("text"))


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture
def projection(spark, tmp_path):
    return J.Projection(spark, f"file://{tmp_path}/p", {"chunks": CHUNKS})


def documents(spark, *changes):
    base = {i: ["a" if i < 4 else "b", i, f"v{i}", "published", False, 1, "all"] for i in range(6)}
    for i, at, value in changes:
        base[i][at] = value
    return spark.createDataFrame([tuple(r) for r in base.values()], DOCUMENTS)


def versions(spark, word="text"):
    made = [("a" if i < 4 else "b", i, f"v{i}", "ready", f"{word} {i}\nmore") for i in range(6)]
    return spark.createDataFrame([*made, ("a", 1, "old", "ready", "stale"), ("a", 2, "v2x", "failed", "bad")], VERSIONS)


def test_a_rebuild_that_dies_leaves_the_old_projection(spark, projection):
    J.rebuild(projection, "chunks", versions(spark), documents(spark, (3, 3, "draft"), (5, 4, True)), lines)
    first = rows(projection.read("chunks"), "document_id", "text")
    assert first == sorted((i, t) for i in (0, 1, 2, 4) for t in (f"text {i}", "more"))

    def dies(own):
        broken = F.when(F.col("document_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.lit("new"))
        return own.select("tenant_id", "document_id", broken.alias("text"))

    with pytest.raises(Exception, match="lost"):
        J.rebuild(projection, "chunks", versions(spark, "new"), documents(spark), dies)
    assert rows(projection.read("chunks"), "document_id", "text") == first


def test_a_tenant_alone_is_rebuilt_and_what_it_lost_is_gone(spark, projection):
    J.rebuild(projection, "chunks", versions(spark), documents(spark), lines)
    J.rebuild(projection, "chunks", versions(spark, "new"), documents(spark, (0, 3, "draft"), (4, 3, "draft")), lines, tenant="a")
    got = rows(projection.read("chunks").filter("text <> 'more'"), "document_id", "text")
    assert got == [(1, "new 1"), (2, "new 2"), (3, "new 3"), (4, "text 4"), (5, "text 5")]


def indexed(docs):
    return docs.select("tenant_id", "document_id", F.concat(F.lit("read by "), "reader").alias("text"))


def test_access_changes_replace_remove_and_skip(spark, projection):
    docs = documents(spark, (0, 6, "few"), (1, 3, "draft"), (2, 4, True), (0, 5, 3))
    J.rebuild(projection, "chunks", versions(spark), documents(spark), lines)
    jobs = spark.createDataFrame([("a", 0, 2), ("a", 0, 3), ("a", 1, 1), ("a", 2, 1), ("a", 77, 1)], "tenant_id string, document_id long, acl_version int")
    got = J.project_access(projection, "chunks", jobs, docs, indexed, batch=0)
    assert rows(got, "document_id", "status") == [(0, "projected"), (1, "not-published"), (2, "missing"), (77, "missing")]
    once = rows(projection.read("chunks"), "document_id", "text")
    assert [t for t in once if t[0] < 3] == [(0, "read by few"), (2, "more"), (2, "text 2")]
    assert len([t for t in once if t[0] > 2]) == 6
    before = projection.manifest()
    J.project_access(projection, "chunks", jobs, docs, indexed, batch=0)
    assert projection.manifest() == before and rows(projection.read("chunks"), "document_id", "text") == once
    J.project_access(projection, "chunks", jobs, docs, indexed, batch=1)
    assert rows(projection.read("chunks"), "document_id", "text") == once
    with pytest.raises(RuntimeError, match="behind"):
        J.project_access(projection, "chunks", spark.createDataFrame([("a", 0, 4)], jobs.schema), docs, indexed, batch=2)
    assert rows(projection.read("chunks"), "document_id", "text") == once


def test_a_stream_of_access_changes(spark, projection, tmp_path):
    J.rebuild(projection, "chunks", versions(spark), documents(spark), lines)
    docs = documents(spark, (0, 6, "few"), (4, 3, "draft"))
    schema = "tenant_id string, document_id long, acl_version int"
    spark.createDataFrame([("a", 0, 1), ("b", 4, 1)], schema).write.parquet(f"{tmp_path}/jobs")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/jobs")
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, n: J.project_access(projection, "chunks", df, docs, indexed, n) and None).start().awaitTermination()
    got = rows(projection.read("chunks"), "document_id", "text")
    assert (0, "read by few") in got and not [r for r in got if r[0] == 4]


def test_late_outcomes_change_nothing(spark, tmp_path):
    keys = "run_id long, tenant_id string"
    p = J.Projection(spark, f"file://{tmp_path}/p", {"runs": f"{keys}, status string", "messages": f"{keys}, outcome_id long, text string", "citations": f"{keys}, outcome_id long, ordinal int"})
    runs = spark.createDataFrame([(i, "a", "running") for i in range(4)] + [(9, "a", "cancelled")], f"{keys}, status string").withColumn("part", J.part_of(F.col("tenant_id"), F.col("run_id")))
    p.replace({"runs": (runs, J._names(runs))})

    def batch(n, *outcomes):
        made = spark.createDataFrame([(r, "a", o, kind, t) for r, o, kind, t in outcomes], f"{keys}, outcome_id long, kind string, ts long")
        texts = made.filter("kind = 'complete'").select("run_id", "tenant_id", "outcome_id", F.concat(F.lit("answer "), "outcome_id").alias("text"))
        cited = texts.select("run_id", "tenant_id", "outcome_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("ordinal"))
        J.persist_answers(p, made, texts, cited, n)

    batch(0, (0, 10, "complete", 5), (1, 11, "cancel", 5), (1, 12, "complete", 6), (9, 13, "complete", 1), (2, 14, "fail", 3), (2, 15, "complete", 3))
    state = lambda: (rows(p.read("runs"), "run_id", "status"), rows(p.read("messages"), "run_id", "text"), rows(p.read("citations"), "run_id", "ordinal"))
    want = ([(0, "completed"), (1, "cancelled"), (2, "failed"), (3, "running"), (9, "cancelled")], [(0, "answer 10")], [(0, 1), (0, 2)])
    assert state() == want
    batch(0, (3, 99, "complete", 1))  # a batch that was published before
    batch(1, (1, 20, "complete", 9), (0, 21, "fail", 9), (0, 22, "complete", 10))
    assert state() == want
    batch(2, (3, 30, "complete", 1), (77, 31, "complete", 1))
    assert state() == ([*want[0][:3], (3, "completed"), want[0][4]], [(0, "answer 10"), (3, "answer 30")], [(0, 1), (0, 2), (3, 1), (3, 2)])


def test_an_unwritten_projection_is_empty(spark, projection):
    assert projection.read("chunks").count() == 0 and projection.read("chunks").columns == ["tenant_id", "document_id", "text", "part"]
