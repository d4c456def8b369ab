"""Benchmark decontamination by spaced seeds, in DataFrame functions only (operator 9).

A document overlaps a benchmark item if some WINDOW consecutive tokens of both agree but for SUBSTITUTIONS of them
at most; an item of fewer tokens (SHORTEST at least) is one window of its own, with SUBSTITUTIONS / WINDOW of its
length. Tokens are words without ASCII punctuation, with A-Z in lower case.

A mask picks tokens of a stretch and ignores the others, so that a substitution in an ignored place leaves the hash
as it is. Hashes of all stretches of a document meet those of the benchmark, and each hit is verified around its
place. The masks are lossless: a window has more stretches than its substitutions can touch. For the default,
13 - 5 + 1 = 9 stretches of weight 4, of which two substitutions touch 8 at most. Items shorter than a window are
held to the stretches they have.

Texts are cut into pieces of PIECE tokens that overlap by what a window around a hit needs, so a hit carries a piece
and never a whole text. The benchmark side is broadcast while its hashes number BROADCAST_SEEDS at most, so that
documents never shuffle and common passages make no hot key; beyond that, hashes meet in a shuffled join and hits
fetch their pieces.

Edge cases: null text or fewer tokens than a mask: no overlap. Items of fewer than SHORTEST tokens never flag anything.
Very long texts are cut as any other, in linear time. Null and repeated items are harmless. Rows may repeat; each gets
its own result. An empty table gives no rows, an empty benchmark flags nothing. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import SPACE, ascii_lower, mark, materialize, without

MASKS = ("11011",)
WINDOW = 13
SUBSTITUTIONS = 2
SHORTEST = 6
BROADCAST_SEEDS = 200_000
#: Tokens whose stretches a piece of a text is for.
PIECE = 256
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: Column) -> Column:
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACE[1:] + _PUNCTUATION, " " * (len(SPACE) - 1))
    return F.array_remove(F.split(ascii_lower(plain), " ", -1), "")


def _stretches(words: Column, mask: str) -> Column:
    """Array of the masked tokens of each stretch of the mask's length, in order of position."""
    picked = [i for i, c in enumerate(mask) if c == "1"]
    n = F.greatest(F.size(words) - len(mask) + 1, F.lit(0))
    return F.arrays_zip(*(F.slice(words, F.lit(i + 1), n).alias(f"t{i}") for i in picked)) if len(picked) > 1 else F.transform(F.slice(words, F.lit(1), n), lambda x: F.struct(x.alias("t0")))


def _pieces(rows: DataFrame, window: int, span: int) -> DataFrame:
    """(doc_id, mark, piece, w): a piece begins a window before its first own token, and goes on for a window and a
    mask after its last."""
    last = F.greatest(F.ceil(F.size("w") / PIECE).cast("int") - 1, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("w", F.greatest(k * PIECE - window, F.lit(0)) + 1, PIECE + 2 * window + span))
    return rows.select("doc_id", "mark", F.posexplode(cut).alias("piece", "w"))


def _seeds(rows: DataFrame, masks: tuple[str, ...], *keep: str) -> DataFrame:
    """(keep..., pos, h) for each mask and stretch of rows' column w."""
    out = None
    for mask in masks:
        picked = [f"s.t{i}" for i, c in enumerate(mask) if c == "1"]
        own = rows.select(*keep, F.posexplode(_stretches(F.col("w"), mask)).alias("pos", "s")).select(*keep, "pos", F.xxhash64(F.lit(mask), *picked).alias("h"))
        out = own if out is None else out.unionByName(own)
    return out


def _verified(hits: DataFrame, window: int, substitutions: int, span: int) -> DataFrame:
    """Of hits with w, pos, item_id, b, bpos: those with a window that agrees, around the hit."""
    size = F.least(F.size("b"), F.lit(window))
    # the alignment's stretch in which a window could hold the hit, cut to both texts
    low = F.greatest(F.col("bpos") - size, F.col("bpos") - F.col("pos"), F.lit(0))
    high = F.least(F.col("bpos") + size + span, F.size("b"), F.size("w") - F.col("pos") + F.col("bpos"))
    hits = hits.withColumn("size", size).withColumn("low", low).withColumn("n", high - low).filter("n >= size")
    same = F.zip_with(F.slice("b", F.col("low") + 1, F.col("n")), F.slice("w", F.col("low") + F.col("pos") - F.col("bpos") + 1, F.col("n")), lambda x, y: (x == y).cast("int"))
    least = F.col("size") - F.floor(F.lit(substitutions) * F.col("size") / window).cast("int")
    hits = hits.withColumn("m", same).withColumn("least", least).filter(F.aggregate("m", F.lit(0), lambda s, x: s + x) >= F.col("least"))
    at = F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)
    return hits.filter(F.exists(at, lambda i: F.aggregate(F.slice("m", i, F.col("size")), F.lit(0), lambda s, x: s + x) >= F.col("least")))


def overlaps(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, substitutions: int = SUBSTITUTIONS, limit: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, mark, item_id), distinct: documents (by id and hash of the text) and the items they overlap."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("b")).filter(F.size("b") >= SHORTEST)
    items = materialize(spark, items, "items")
    seeds = _seeds(items.withColumn("w", F.col("b")), masks, "item_id").select("h", "item_id", F.col("pos").alias("bpos"))
    span = max(map(len, masks))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark(docs).alias("mark"), tokens(docs["text"]).alias("w"))
    rows = _pieces(rows, window, span)
    if seeds.limit(limit + 1).count() <= limit:
        hits = _seeds(rows, masks, "doc_id", "mark", "w").join(F.broadcast(seeds), "h").join(F.broadcast(items), "item_id")
    else:
        key = ["doc_id", "mark", "piece"]
        found = _seeds(rows, masks, *key).join(seeds, "h").drop("h").distinct()
        pieces = rows.dropDuplicates(key).withColumnsRenamed({c: f"own_{c}" for c in key})
        hits = found.join(items, "item_id").join(pieces, F.col("doc_id").eqNullSafe(F.col("own_doc_id")) & (F.col("mark") == F.col("own_mark")) & (F.col("piece") == F.col("own_piece")))
    return _verified(hits, window, substitutions, span).select("doc_id", "mark", "item_id").distinct()


def report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row a row of docs: doc_id, contaminated, n_items, item_ids (in order, joined by commas)."""
    found = overlaps(spark, docs, benchmark, **options).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = found.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "items")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark(docs).alias("mark"))
    out = own.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("item_ids"))


def keep(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without overlap, with their columns."""
    found = overlaps(spark, docs, benchmark, **options).select(F.col("doc_id").alias("d"), F.col("mark").alias("m")).distinct()
    found = materialize(spark, found, "flags")
    return without(docs, found, found.limit(0))
