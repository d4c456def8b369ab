"""Line deduplication in DataFrame functions only (operator 4).

Keys of lines are hashed to 128 bits. Rows (hash, document, position) are range-partitioned by hash with a
secondary sort by document and position, and each hash's stream of documents is counted as it passes. What
leaves is no text but one compressed bitmap a document: the 64-line words that hold a dropped line, as a map
from word number to bits. The bitmaps meet the texts by document in one join.

A frequent-items sketch of fixed size finds the hot hashes, HOT_KEYS at most. Those are pre-aggregated and
broadcast, so that their lines go round the exchange. What the sketch misses is counted on the long way, so
results don't depend on it.

Two modes: min_docs = k drops all lines of a key found in k documents or more (the contract's); first = True
keeps the first line of each key, by document and position, and drops the later ones.

Edge cases: null or empty text is one empty line. Keys shorter than min_chars code points are never dropped. Rows
that repeat a doc_id count as one document for min_docs, and each gets its own result; rows alike in id and text
share their bitmap. A null doc_id is one document like another. Very long texts, of any number of lines, take time in
proportion to their length. Ties of document and position are rows alike. An empty table gives no rows. Other columns
are ignored, whatever their names; no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import SPACE, ascii_lower, mark, materialize, size_partitions

#: The sketch's foremost hashes are counted apart and broadcast; any other has under 1/HOT_KEYS of the lines.
HOT_KEYS = 4000
SKETCH_ITEMS = 40_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, mark, pos, h, g): lines that may be dropped. h and g are two hashes of the key, mark one of the text."""
    own = docs.select(docs["doc_id"].alias("doc"), mark(docs).alias("mark"), docs["text"].cast("string").alias("text"))
    # the text is hashed below the generator, once a row
    out = own.select("doc", "mark", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    out = out.withColumn("line", key_of(F.col("line")))
    if min_chars == 1:
        out = out.filter("line != ''")
    elif min_chars > 1:
        out = out.filter(F.length("line") >= min_chars)
    return out.select("doc", "mark", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.reverse("line"), F.length("line")).alias("g"))


def dropped_lines(spark: SparkSession, docs: DataFrame, min_docs: int | None, min_chars: int) -> DataFrame:
    """(doc, mark, pos) of each line that goes."""
    lines = materialize(spark, _lines(docs, min_chars), "lines")
    found = lines.agg(F.expr(f"approx_top_k(h, {HOT_KEYS}, {SKETCH_ITEMS})").alias("t")).select(F.explode("t").alias("t")).select("t.item", "t.count")
    hot = spark.createDataFrame([(r[0],) for r in found.collect() if r[1] > 1], "hot_h long")  # at most HOT_KEYS rows
    marked = lines.join(F.broadcast(hot), lines["h"] == hot["hot_h"], "left")
    near = marked.filter("hot_h is not null").drop("hot_h")
    # the long way: hashes in ranges, each with its documents and positions in order
    far = marked.filter("hot_h is null").drop("hot_h").repartitionByRange(size_partitions(spark), "h", "g")
    w = Window.partitionBy("h", "g").orderBy("doc", "mark", "pos")
    if min_docs is None:
        far = far.withColumn("n", F.rank().over(w)).filter("n > 1")
        firsts = near.groupBy("h", "g").agg(F.min(F.struct("doc", "mark", "pos")).alias("first"))
        near = near.join(F.broadcast(firsts), ["h", "g"]).filter(~F.struct("doc", "mark", "pos").eqNullSafe(F.col("first")))
    else:
        new = F.when((F.row_number().over(w) > 1) & F.lag("doc").over(w).eqNullSafe(F.col("doc")), 0).otherwise(1)
        far = far.withColumn("n", new).withColumn("n", F.sum("n").over(Window.partitionBy("h", "g"))).filter(F.col("n") >= min_docs)
        each = near.groupBy("h", "g", "doc").agg(F.lit(1).alias("one")).groupBy("h", "g").agg(F.sum("one").alias("n"))
        near = near.join(F.broadcast(each.filter(F.col("n") >= min_docs)), ["h", "g"], "left_semi")
    return far.select("doc", "mark", "pos").unionByName(near.select("doc", "mark", "pos"))


def drop_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, mark, gone map<int, long>): bit i of word k says that line 64 k + i goes. Words without any are left out."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
    words = dropped.groupBy("doc", "mark", (F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc", "mark").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("gone"))


def kept_lines(lines: Column, gone: Column) -> Column:
    bit = lambda i: F.getbit(gone[(i / 64).cast("int")], (i % 64).cast("int"))
    return F.filter(lines, lambda _, i: F.coalesce(bit(i), F.lit(0)) == 0)


def bitmaps(spark: SparkSession, docs: DataFrame, min_docs: int | None = 10, min_chars: int = 1) -> DataFrame:
    return drop_bitmaps(dropped_lines(spark, docs, min_docs, min_chars))


def apply(spark: SparkSession, docs: DataFrame, min_docs: int | None = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): the texts without the lines that go, from texts and bitmaps."""
    own = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).withColumn("own_mark", F.xxhash64("text"))
    maps = bitmaps(spark, docs, min_docs, min_chars)
    both = own.join(maps, own["doc_id"].eqNullSafe(maps["doc"]) & (own["own_mark"] == maps["mark"]), "left")
    n = F.size(lines_of(F.col("text"))).cast("long")
    left = kept_lines(lines_of(F.col("text")), F.col("gone"))
    return both.select(
        "doc_id",
        n.alias("n_lines"),
        F.coalesce(F.aggregate(F.map_values("gone"), F.lit(0).cast("long"), lambda s, x: s + F.bit_count(x)), F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"),
    )


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return apply(spark, docs).select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH s AS (SELECT chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS space),
d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, pos, line, translate(trim(line, (SELECT space FROM s)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d)),
hot AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, hot.k IS NOT NULL AS gone FROM l LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
