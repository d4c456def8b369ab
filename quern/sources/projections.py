"""Projections that readers always see whole: parts of tables, replaced together by one published manifest.

A projection is a folder. Each write puts the rows of the parts it replaces into a build of its own, by Spark's commit
protocol; then one small file, the manifest, which tells the build of every part of every table, is replaced in one step.
A write that dies before that leaves the old projection as it was, and its build is never read. The manifest has an entry
a part: choose parts (tenants, buckets of documents) so that they are thousands, not millions. One writer at a time.

On it stand the full rebuild, the consumer of access changes, and the persisting of answers with their guarded runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


class Projection:
    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        """schemas: of each table, without the column part, which is a string and names a row's part."""
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    def _files(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """{"parts": {table: {part: build}}, "batches": {consumer: the last batch it has published}}."""
        where, files = self._files(MANIFEST)
        if not files.exists(where):
            return {"parts": {}, "batches": {}}
        stream = files.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """The new manifest is written beside the old one and then renamed onto it, which is one step."""
        new, files = self._files(f"{MANIFEST}.{uuid.uuid4().hex}")
        stream = files.create(new, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._files(MANIFEST)[0], options)

    def read(self, table: str, parts: list[str] | None = None) -> DataFrame:
        """The rows published, with part; of some parts only, if they are named."""
        of = self.manifest()["parts"].get(table, {})
        builds = sorted({b for p, b in of.items() if parts is None or p in set(parts)})
        schema = f"{self.schemas[table]}, part string, build string"
        if not builds:
            return self.spark.createDataFrame([], schema).drop("build")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/build={b}" for b in builds])
        # a build may hold parts that a later one has replaced
        live = self.spark.createDataFrame([(p, b) for p, b in of.items() if parts is None or p in set(parts)], "part string, build string")
        return rows.join(F.broadcast(live), ["part", "build"], "left_semi").drop("build")

    def replace(self, tables: dict[str, tuple[DataFrame, list[str]]], consumer: str | None = None, batch: int | None = None) -> bool:
        """Of each table, the parts named become what is given (rows with part; a part without rows is empty then), all at
        once. With a consumer, a batch that it has published before is not published again; False tells so."""
        manifest = self.manifest()
        if consumer is not None and batch is not None and manifest["batches"].get(consumer, -1) >= batch:
            return False
        build = uuid.uuid4().hex
        for name, (rows, parts) in tables.items():
            rows.write.partitionBy("part").parquet(f"{self.path}/{name}/build={build}")
            manifest["parts"].setdefault(name, {}).update(dict.fromkeys(parts, build))
        if consumer is not None and batch is not None:
            manifest["batches"][consumer] = batch
        self._publish(manifest)
        return True


def part_of(tenant: Column, document: Column, buckets: int = 64) -> Column:
    return F.concat_ws("-", tenant.cast("string"), F.pmod(F.xxhash64(document), F.lit(buckets)))


def _names(rows: DataFrame) -> list[str]:
    """Parts that occur; there is an entry of the manifest for each anyway."""
    return [r.part for r in rows.select("part").distinct().collect()]


def current(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Ready versions with text that are current in a published document that isn't deleted."""
    live = documents.filter("status = 'published' and not deleted").select("tenant_id", "document_id", F.col("current_version_id").alias("version_id"))
    return versions.filter("ingestion_status = 'ready' and markdown is not null").join(live, ["tenant_id", "document_id", "version_id"])


def rebuild(projection: Projection, table: str, versions: DataFrame, documents: DataFrame, chunker: Callable[[DataFrame], DataFrame], tenant: str | None = None) -> None:
    """Builds a table anew from the Markdown of current versions, of one tenant or all, and publishes it at the end.

    chunker makes the table's rows, with tenant_id and document_id. Parts that were there and have no rows now are empty.
    """
    own = current(versions, documents)
    if tenant is not None:
        own = own.filter(F.col("tenant_id") == tenant)
    rows = chunker(own).withColumn("part", part_of(F.col("tenant_id"), F.col("document_id")))
    old = [p for p in projection.manifest()["parts"].get(table, {}) if tenant is None or p.rsplit("-", 1)[0] == tenant]
    projection.replace({table: (rows, sorted({*old, *_names(rows)}))})


def project_access(projection: Projection, table: str, jobs: DataFrame, documents: DataFrame, indexed: Callable[[DataFrame], DataFrame], batch: int, consumer: str = "access") -> DataFrame:
    """A batch of jobs (tenant_id, document_id, acl_version), each document's latest only: documents that are gone are
    skipped, rows of unpublished ones go, those of others are replaced by indexed(documents). For foreachBatch: the same
    batch again changes nothing.

    Gives (tenant_id, document_id, status). A document whose access version is behind the job's fails the batch, so that
    it is tried again.
    """
    latest = jobs.groupBy("tenant_id", "document_id").agg(F.max("acl_version").alias("wanted"))
    state = latest.join(documents, ["tenant_id", "document_id"], "left")
    status = F.when(F.col("deleted").isNull() | F.col("deleted"), "missing").when(F.col("acl_version") < F.col("wanted"), "behind").when((F.col("status") != "published") | F.col("current_version_id").isNull(), "not-published").otherwise("projected")
    state = state.withColumn("outcome", status).withColumn("part", part_of(F.col("tenant_id"), F.col("document_id")))
    late = state.filter("outcome = 'behind'").select("document_id").limit(5).collect()
    if late:
        raise RuntimeError(f"access versions of documents are behind their jobs: {[r.document_id for r in late]}")
    touched = state.filter("outcome in ('projected', 'not-published')")
    parts = _names(touched)
    gone = touched.select("tenant_id", "document_id")
    stay = projection.read(table, parts).join(gone, ["tenant_id", "document_id"], "left_anti")
    fresh = indexed(touched.filter("outcome = 'projected'").select(*documents.columns)).withColumn("part", part_of(F.col("tenant_id"), F.col("document_id")))
    projection.replace({table: (stay.unionByName(fresh), parts)}, consumer, batch)
    return state.select("tenant_id", "document_id", F.col("outcome").alias("status"))


#: What an outcome makes of a running run.
ENDS = {"complete": "completed", "fail": "failed", "cancel": "cancelled"}


def decided_runs(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(run_id, tenant_id, outcome_id, status): the first outcome (run_id, tenant_id, outcome_id, kind, ts) of each run that
    is still running. Later ones, and those of runs that have ended, change nothing."""
    first = Window.partitionBy("run_id", "tenant_id").orderBy("ts", "outcome_id")
    won = outcomes.filter(F.col("kind").isin(*ENDS)).withColumn("n", F.row_number().over(first)).filter("n = 1")
    running = runs.filter("status = 'running'").select("run_id", "tenant_id")
    status = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in ENDS.items()))
    return won.join(running, ["run_id", "tenant_id"], "left_semi").select("run_id", "tenant_id", "outcome_id", status.alias("status"))


def persist_answers(projection: Projection, outcomes: DataFrame, messages: DataFrame, citations: DataFrame, batch: int, consumer: str = "answers") -> None:
    """Ends runs and keeps the answers of those that completed: the tables runs (run_id, tenant_id, status), messages and
    citations (each with run_id, tenant_id and outcome_id) change together or not at all.

    A run is compared and set: only a running one ends. Messages and citations belong to an outcome; those of an outcome
    that came too late are dropped. The same batch again changes nothing.
    """
    named = outcomes.withColumn("part", part_of(F.col("tenant_id"), F.col("run_id")))
    parts = _names(named)
    runs = projection.read("runs", parts)
    decided = decided_runs(runs, outcomes)
    ended = runs.join(decided.select("run_id", "tenant_id", F.col("status").alias("new")), ["run_id", "tenant_id"], "left").withColumn("status", F.coalesce("new", "status")).drop("new")
    kept = decided.filter("status = 'completed'").select("run_id", "tenant_id", "outcome_id")
    tables = {"runs": (ended, parts)}
    for name, rows in (("messages", messages), ("citations", citations)):
        new = rows.join(kept, ["run_id", "tenant_id", "outcome_id"], "left_semi").withColumn("part", part_of(F.col("tenant_id"), F.col("run_id")))
        tables[name] = (projection.read(name, parts).unionByName(new), parts)
    projection.replace(tables, consumer, batch)
