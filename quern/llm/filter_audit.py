"""Filter interaction audit by direct relational replay (operator 11).

Each document is a row (part, flags, good, toxic): one bit of flags a filter that the document fails. Rows are crossed
with the orders of the filters (120 for five, broadcast), and each pair is exploded into its steps. The first failure
of a document in an order is the earliest step whose filter it fails; from it and the step follow all counts, as one
conditional aggregation by (part, order, step), which combines before its shuffle: a task sends one row a part, order
and step, however many documents it has read and however unequal parts are.

Texts are read once, into a narrow table of facts. Whether a smaller doc_id has the same text is decided on SHA-256
digests: digests held by more than 1/HOT of the rows (fewer than HOT) are broadcast, the others joined, so no key of
that join is hot. Labels join by doc_id; adaptive execution splits a doc_id that repeats very often.

Edge cases: null text counts as empty and fails A alone (and E as a copy of another empty text). A null source is part
''. A null doc_id is neither smaller nor larger than another, so such a row never fails E, makes none fail, and has no
label. Rows of one doc_id each count; they never make each other fail E. Of several labels of a doc_id, 1 wins; null
labels count as 0. Very long texts are counted whole. Other columns are ignored, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import UPPER, materialize

LETTERS = "ABCDE"
#: More filters have too many orders to replay.
MOST_FILTERS = 6
#: A digest with more than 1/HOT of the rows is broadcast; there are fewer than HOT.
HOT = 2000
WORD = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """Failure conditions A to D: few words, repeated words, upper case, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [F.size(words) < 200, F.size(F.array_distinct(words)) * 100 < F.size(words) * 50, upper.cast("long") * 100 > F.length(text).cast("long") * 2, text.rlike("[#$%&*|]")]


def mask(failures: list[Column]) -> Column:
    """One bit a condition; null counts as passed."""
    return reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures)])


def flagged(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, part, flags) of each row, with the bits of A to E."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    facts = materialize(spark, rows.select("doc_id", "part", mask(text_failures(F.col("text"))).alias("flags"), F.unhex(F.sha2("text", 256)).alias("digest")), "facts")
    firsts = facts.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = materialize(spark, firsts, "firsts")
    hot = max(2, facts.count() // HOT + 1)
    near = facts.join(F.broadcast(firsts.filter(F.col("n") >= hot).select("digest", F.col("first").alias("hot"))), "digest", "left")
    known = near.filter("hot is not null").withColumnRenamed("hot", "first")
    others = near.filter("hot is null").drop("hot").join(firsts.filter(F.col("n") < hot).drop("n"), "digest", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << LETTERS.index("E")).otherwise(0)
    return known.unionByName(others).select("doc_id", "part", (F.col("flags") + copy).alias("flags"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic booleans."""
    bad = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["quality"] == 1).alias("good"), (labels["toxic"] == 1).alias("toxic"))
    bad = bad.filter("doc_id is not null and (good or toxic)").groupBy("doc_id").agg(F.bool_or(F.coalesce("good", F.lit(False))).alias("good"), F.bool_or(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    no = F.lit(False)
    return rows.join(bad, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})


def orders(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """(filter_order, masks array<int>): all orders of the filters and their bits, step by step."""
    rows = [("".join(p), [1 << letters.index(c) for c in p]) for p in permutations(letters)]
    return spark.createDataFrame(rows, "filter_order string, masks array<int>")


def replay(spark: SparkSession, rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Counts of each (part, filter_order, step) from rows of (part, flags, good, toxic); bit i of flags is letter i."""
    if len(set(letters)) != len(letters) or not 0 < len(letters) <= MOST_FILTERS:
        raise ValueError(f"one to {MOST_FILTERS} distinct filters are replayed")
    n = len(letters)
    crossed = rows.select("part", "flags", "good", "toxic").crossJoin(F.broadcast(orders(spark, letters)))
    fails = [F.col("flags").bitwiseAND(F.col("masks")[i]) != 0 for i in range(n)]
    first = F.coalesce(*(F.when(c, i + 1) for i, c in enumerate(fails)), F.lit(n + 1))
    steps = crossed.select("part", "filter_order", "masks", "flags", "good", "toxic", first.alias("first"), F.explode(F.array(*map(F.lit, range(1, n + 1)))).alias("step"))
    own = F.element_at("masks", F.col("step"))
    here, count = F.col("first") == F.col("step"), lambda c: F.count_if(c)
    counts = steps.groupBy("part", "filter_order", "step").agg(
        count(F.col("first") > F.col("step")).alias("kept"),
        count(here).alias("removed"),
        count((F.col("first") < F.col("step")) & (F.col("flags").bitwiseAND(own) != 0)).alias("redundant"),
        count(F.col("flags") == own).alias("unique_fails"),
        count(here & F.col("good")).alias("good_lost"),
        count(here & F.col("toxic")).alias("toxic_lost"),
    )
    of_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counts.withColumn("shapley", F.sum("removed").over(of_filter))


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters on docs, replayed in all orders, by source."""
    return replay(spark, labelled(flagged(spark, docs), labels))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part, doc_id,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS failed FROM w),
y AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
p AS (SELECT part, failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS c FROM f LEFT JOIN y USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier FROM o, unnest(range(1, 6)) AS u(step)),
r AS (SELECT part, filter_order, step, letter,
    sum(CASE WHEN translate(failed, earlier || letter, '') = failed THEN c ELSE 0 END) AS kept,
    sum(CASE WHEN translate(failed, earlier, '') = failed AND contains(failed, letter) THEN c ELSE 0 END) AS removed,
    sum(CASE WHEN translate(failed, earlier, '') <> failed AND contains(failed, letter) THEN c ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = letter THEN c ELSE 0 END) AS unique_fails,
    sum(CASE WHEN translate(failed, earlier, '') = failed AND contains(failed, letter) THEN c * good ELSE 0 END) AS good_lost,
    sum(CASE WHEN translate(failed, earlier, '') = failed AND contains(failed, letter) THEN c * toxic ELSE 0 END) AS toxic_lost
  FROM p, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""
