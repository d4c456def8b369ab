"""Layout of pages and sheets: repeated margins, page classes, regions of cells, quality scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.parts import parts


def repeated_margins(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc, role, fingerprint, pages): texts of the top and bottom 12 % of pages, digits as '#', that are on enough of
    a document's pages: the share, rounded up, and two at least. lines: doc, page, text, top,
    height, page_height. Bare page numbers at the foot count wherever they are."""
    role = F.when(F.col("top") <= F.col("page_height") * 0.12, "header").when(F.col("top") + F.col("height") >= F.col("page_height") * 0.88, "footer")
    own = lines.withColumn("role", role).filter("role is not null").withColumn("fingerprint", F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"\d+", "#"), r"\s+", " ")))
    pages = lines.groupBy("doc").agg(F.count_distinct("page").alias("of"))
    seen = own.groupBy("doc", "role", "fingerprint").agg(F.count_distinct("page").alias("pages")).join(pages, "doc")
    bare = (F.col("role") == "footer") & F.col("fingerprint").rlike(r"^(page\s*)?#(\s*(of|/)\s*#)?$")
    return seen.filter((F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("of") * share))) | bare).select("doc", "role", "fingerprint", "pages")


def page_class(chars: Column, images: Column, least: int = 40) -> Column:
    return F.when(chars < least, "scanned").when(images > 0, "mixed").otherwise("native")


def quality_score(unread: Column, unsure: Column, empty: Column, warnings: Column) -> Column:
    """100 less 35, 20 and 25 for unread, unsure and empty pages, and 3 for each warning up to 15; not below 0."""
    flag = lambda c, n: F.when(c > 0, n).otherwise(0)
    return F.greatest(F.lit(0), F.lit(100) - flag(unread, 35) - flag(unsure, 20) - flag(empty, 25) - F.least(F.lit(15), warnings * 3)).cast("int")


def islands(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the number of the run of consecutive values that a value is in: the value less its rank is the same."""
    w = Window.partitionBy(*keys).orderBy(value)
    return rows.withColumn(name, F.col(value) - F.dense_rank().over(w))


#: Cells of a task, about.
CELLS = 500_000


def regions(cells: DataFrame) -> DataFrame:
    """(sheet, row_start, row_end, column_start, column_end, n): runs of rows, in each the runs of columns. cells: sheet, r, c.

    A cell given more than once is one. Rows are numbered with their columns as one array each, and columns within a band
    with their counts, so that no window is over cells; sheets are dealt to as many tasks as there are cells for.
    """
    rows = cells.repartition(parts(cells, CELLS), "sheet").groupBy("sheet", "r").agg(F.collect_set(F.struct("c")).alias("cs"))
    own = islands(rows, ["sheet"], "r", "band").select("sheet", "band", "r", F.explode("cs").alias("x")).select("sheet", "band", "r", "x.c")
    own = own.groupBy("sheet", "band", "c").agg(F.min("r").alias("r1"), F.max("r").alias("r2"), F.count("*").alias("k"))
    own = islands(own, ["sheet", "band"], "c", "block")
    return own.groupBy("sheet", "band", "block").agg(F.min("r1").alias("row_start"), F.max("r2").alias("row_end"), F.min("c").alias("column_start"), F.max("c").alias("column_end"), F.sum("k").alias("n")).drop("band", "block")


def body_font(lines: DataFrame, *keys: str, default: float = 10.0) -> DataFrame:
    """(keys, body): the page's median of the smaller 60 % of font sizes, rounded down, one at least, over the lines that
    are no margin (margin: true for headers and footers). A page without others, or with a median of 0, has the default.
    keys are doc and page unless given."""
    keys = keys or ("doc", "page")
    w = Window.partitionBy(*keys).orderBy(F.when(~F.col("margin"), 0).otherwise(1), "size", "line")
    own = lines.withColumn("margin", F.coalesce("margin", F.lit(False)))
    own = own.withColumn("n", F.count_if(~F.col("margin")).over(Window.partitionBy(*keys))).withColumn("k", F.row_number().over(w))
    small = ~F.col("margin") & (F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.6)))
    median = F.median(F.when(small, F.col("size").cast("double")))
    return own.groupBy(*keys).agg(F.coalesce(F.nullif(median, F.lit(0.0)), F.lit(default)).alias("body"))


def heading_level(size: Column, body: Column, text: Column) -> Column:
    """1, 2 or 3 by the ratio to the body font (1.5, 1.25, 1.12); numbered lines 3; null for body text."""
    # The ratios and the pattern of numbered headings.
    ratio = size / F.greatest(F.lit(1.0), body)
    numbered = text.rlike(r"^(?:第[一二三四五六七八九十百千\d]+[章节篇]|(?:\d+\.){0,3}\d+\s+\S+)")
    plain = (F.length(F.trim(text)) == 0) | (F.length(text) > 160) | F.contains(text, F.lit("\t"))
    return F.when(plain, F.lit(None).cast("int")).when(ratio >= 1.5, 1).when(ratio >= 1.25, 2).when((ratio >= 1.12) | numbered, 3)
