"""Places in documents: equal locations, boxes, paragraphs that a table repeats, contents merged by offsets, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a location of each type is equal by.
LOCATED_BY = {"document": (), "section": ("heading",), "page": ("page",), "slide": ("slide",), "sheet": ("sheet", "row_start", "row_end", "range")}


def same_location(left: Column, right: Column) -> Column:
    """Whether two location structs are of one type and equal in its fields; missing equals missing."""
    equal = F.lit(False)
    for kind, fields in LOCATED_BY.items():
        same = left["type"] == kind
        for f in fields:
            same = same & left[f].eqNullSafe(right[f])
        equal = equal | same
    return F.coalesce(left["type"].eqNullSafe(right["type"]) & equal, F.lit(False))


def union_boxes(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, x, y, width, height): the box around the boxes x, top, width, height of a group."""
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("top") + F.col("height"))
    return lines.groupBy(*keys).agg(F.min("x").alias("x"), F.min("top").alias("y"), (right - F.min("x")).alias("width"), (bottom - F.min("top")).alias("height"))


def share_of_page(length: Column, page: Column) -> Column:
    """A length as a part of the page's, 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), length / F.greatest(F.lit(1), page)))


def _terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) > 1)


def repeated_paragraphs(paragraphs: DataFrame, tables: DataFrame, share: float = 0.65) -> DataFrame:
    """(page, element): paragraphs (page, element, text) of which that share of terms is in a table (page, cells) of
    their page: they are not searched again."""
    own = tables.select("page", F.array_distinct(F.flatten(F.transform("cells", _terms))).alias("of"))
    both = paragraphs.select("page", "element", _terms(F.col("text")).alias("terms")).filter(F.size("terms") > 0).join(own, "page")
    found = F.size(F.filter("terms", lambda t: F.array_contains("of", t)))
    return both.filter((F.size("of") > 0) & (found >= F.size("terms") * share)).select("page", "element").distinct()


def synthetic_id(value: Column) -> Column:
    """An id in the shape of a UUID from the first half of a SHA-256."""
    h = F.sha2(value.cast("string"), 256)
    variant = F.substring(F.lit("89ab"), F.pmod(F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1)) - 1, F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def merge_contents(chunks: DataFrame, *keys: str) -> DataFrame:
    """(keys, content, offset_start, offset_end, chunk_id, n): the chunks of a group in order, without what overlaps by
    their offsets; a blank line stands between others. chunk_id is that of the best score, the first of ties.

    A group is a run of neighbouring candidates of a recall, and is one row."""
    order = Window.partitionBy(*keys).orderBy("ordinal", "chunk_id")
    before, size = order.rowsBetween(Window.unboundedPreceding, -1), F.length("content")
    rows = chunks.withColumn("reached", F.max("offset_end").over(before)).withColumn("overlap", F.greatest(F.lit(0), F.col("reached") - F.col("offset_start")).cast("int"))
    rows = rows.withColumn("added", F.col("reached").isNull() | (F.col("overlap") < size))
    ended = F.coalesce(F.last(F.when(F.col("added") & (size > 0), F.endswith("content", F.lit("\n"))), ignorenulls=True).over(before), F.lit(False))
    more = F.when(F.col("overlap") > 0, F.substr("content", F.col("overlap") + 1)).otherwise(F.concat(F.when(ended, "").otherwise("\n\n"), "content"))
    rows = rows.withColumn("piece", F.when(F.col("reached").isNull(), F.col("content")).when(~F.col("added"), "").otherwise(more))
    # the pieces are joined once, so a long group costs what it is long
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "chunk_id", "piece"))), lambda x: x["piece"]), "")
    best = F.max_by("chunk_id", F.struct("score", (-F.col("ordinal")).alias("o")))
    return rows.groupBy(*keys).agg(whole.alias("content"), F.min("offset_start").alias("offset_start"), F.max("offset_end").alias("offset_end"), best.alias("chunk_id"), F.count("*").alias("n"))


def settled(used: Column, reserved: Column, actual: Column) -> Column:
    """A quota counter after a reservation: what was used beyond it, or less, is added; not below 0."""
    return F.greatest(F.lit(0), used + F.greatest(F.lit(0), F.floor(actual)) - reserved).cast("long")


def run_costs(runs: DataFrame, usage: DataFrame) -> DataFrame:
    """(run_id, cost): the sum of a run's priced usage in its tenant, else its fallback."""
    spent = usage.groupBy("run_id", "tenant_id").agg(F.sum("estimated_cost_usd").cast("double").alias("spent"))
    return runs.join(spent, ["run_id", "tenant_id"], "left").select("run_id", F.round(F.coalesce("spent", "fallback"), 6).alias("cost"))
