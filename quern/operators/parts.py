"""How many parts a shuffle has: as many as its rows ask for, so that a task's memory doesn't grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def parts(rows: DataFrame, per_task: int) -> int:
    """So many parts that one has about per_task of the rows, and not fewer than other shuffles have. Counts the rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_task))
