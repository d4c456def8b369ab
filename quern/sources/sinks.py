"""Sinks: projections replaced by partition, upserts, purges, append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Writes rows, replacing only the partitions they are in."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def upsert(current: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The rows of both, of each key the first in order, new ones before old."""
    both = new.withColumn("__old", F.lit(0)).unionByName(current.withColumn("__old", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("__old", *order)
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__old")


def insert_absent(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(new.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


def purge(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of these ids."""
    return {name: df.join(ids.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def append(rows: DataFrame, path: str, *by: str) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def checksums(rows: DataFrame, keys: list[str], order: str, line: Column) -> DataFrame:
    """SHA-256 of each key's lines in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("checksum"))


def next_version(spark: SparkSession, settings: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Settings with the changes as new versions, by key."""
    last = settings.groupBy(*keys).agg(F.max("version").alias("__v"))
    return settings.unionByName(changes.join(last, keys, "left").withColumn("version", F.coalesce("__v", F.lit(0)) + 1).drop("__v").select(*settings.columns))
