"""Fill-in-middle transformation over a distinct-text index (operator 12).

Texts are cut into units: runs of Latin letters, and single other characters. Identical texts have the same boundaries,
so these are computed once a text. Rows are placed by the SHA-256 of their text; there they are grouped by the text
itself, so that a group is one content and not one hash. Each group's boundaries, as offsets in code points, become one
Elias-Fano list (about two bits a unit and what the density asks for), with the count of ones before each 64 bytes of
its upper bits, so that any boundary is read without decoding the list. The index joins back to the documents where
they are, and two reads of the list give a document's seeded cut. Texts are shuffled once, for both uses.

A text held by more than 1/HOT of the rows (there are fewer than HOT) is dealt by doc_id over as many parts as it has
shares of that size; each part has its own entry of the index.

Edge cases: null text counts as empty; an empty text has no units, stays plain and restores as empty. A null doc_id
counts as the empty string in the seed. Rows that repeat get equal results; rows alike in doc_id and text share a part.
Very long texts go through whole. Texts that hold a marker stay plain, so that restoring never meets one in a piece.
Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize, size_partitions
from quern.llm.words import parts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text with more than 1/HOT of the rows is dealt over several parts; there are fewer than HOT.
HOT = 2000
_HEAD = struct.Struct("<QBQ")
#: Bytes of upper bits between two counts of ones.
STRIDE = 64
#: Bytes of texts that are cut into units together.
SLICE = 4_000_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def elias_fano(values: np.ndarray) -> bytes:
    """A list of ascending numbers, not empty: size u64, low bits u8, bytes of upper bits u64, counts u64[...], upper
    bits, low bits."""
    m, top = len(values), int(values[-1])
    low = max(0, ((top + 1) // m).bit_length() - 1)
    upper = np.zeros((top >> low) + m, np.uint8)
    upper[(values >> low) + np.arange(m)] = 1
    high = np.packbits(upper, bitorder="little")
    ones = np.add.reduceat(np.bitwise_count(high).astype(np.int64), np.arange(0, len(high), STRIDE))
    counts = (np.cumsum(ones) - ones).astype("<u8")
    rest = np.packbits((values[:, None] >> np.arange(low) & 1).astype(np.uint8).ravel(), bitorder="little")
    return _HEAD.pack(m, low, len(high)) + counts.tobytes() + high.tobytes() + rest.tobytes()


def select(data: bytes, i: int) -> int:
    """The i-th number of a list, counted from 0."""
    m, low, size = _HEAD.unpack_from(data)
    if not 0 <= i < m:
        raise IndexError(i)
    n = -(-size // STRIDE)
    counts = np.frombuffer(data, "<u8", n, _HEAD.size)
    at = int(np.searchsorted(counts, i, side="right")) - 1
    first = _HEAD.size + 8 * n
    some = np.frombuffer(data, np.uint8, min(STRIDE, size - at * STRIDE), first + at * STRIDE)
    place = at * STRIDE * 8 + int(np.flatnonzero(np.unpackbits(some, bitorder="little"))[i - int(counts[at])])
    if not low:
        return place - i
    bit = i * low
    begin = first + size + bit // 8
    word = int.from_bytes(data[begin : begin + (bit % 8 + low + 7) // 8], "little")
    return (place - i) << low | word >> bit % 8 & ((1 << low) - 1)


def boundaries(texts: pa.Array) -> list[np.ndarray]:
    """Of each text, where its units begin and where the last one ends, in code points."""
    offsets, data = parts(texts.cast(pa.large_binary()))
    letter = _LETTER[data]
    begins = (data & 0xC0) != 0x80
    points = np.append(0, np.cumsum(begins))
    begins[1:] &= ~(letter[1:] & letter[:-1])
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = True
    at = np.flatnonzero(begins)
    cuts = np.searchsorted(at, offsets)
    of = points[at]
    return [np.append(of[a:b] - points[i], points[j] - points[i]) for a, b, i, j in zip(cuts, cuts[1:], offsets, offsets[1:], strict=False)]


def _index_entry(texts: pa.Array) -> pa.Array:
    """(n, cuts) of each text."""
    n, cuts, step = [], [], max(1, len(texts) * SLICE // max(1, texts.nbytes))
    for i in range(0, len(texts), step):
        for x in boundaries(texts.slice(i, step)):
            n.append(len(x) - 1)
            cuts.append(elias_fano(x))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(cuts, pa.binary())], ["n", "cuts"])


def _cut(cuts: pa.Array, i: pa.Array, j: pa.Array) -> pa.Array:
    """The i-th and j-th boundary of each list; null where i is."""
    out = [(None, None) if a is None else (select(x, a), select(x, b)) for x, a, b in zip(cuts.to_pylist(), i.to_pylist(), j.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def placed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest, deal), partitioned by digest and deal: all rows of a text are together, or its share of them."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    share = docs.count() // HOT + 1
    hot = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > share)
    hot = materialize(spark, hot.select("digest", F.ceil(F.col("n") / share).alias("deals")), "hot-texts")
    # the deal is derived from doc_id beyond the exchange: so all readers of the exchange ask for the same columns, and share it
    deal = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("deals")), F.lit(0).cast("long"))
    dealt = rows.join(F.broadcast(hot), "digest", "left").repartition(size_partitions(spark), "digest", deal)
    return dealt.select("doc_id", "text", "digest", deal.alias("deal"))


def indexed(rows: DataFrame) -> DataFrame:
    """placed() rows with their entry of the index (n, cuts), which has one row a distinct text and deal."""
    entry = F.arrow_udf(_index_entry, "n long, cuts binary")
    index = rows.select("digest", "deal", "text").distinct().select("digest", "deal", entry("text").alias("entry"))
    return rows.join(index.select("digest", "deal", "entry.*").hint("shuffle_hash"), ["digest", "deal"]).select("doc_id", "text", "n", "cuts")


def output(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    """The document as it is written."""
    p, s, m = map(F.lit, (PREFIX, SUFFIX, MIDDLE))
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restored(out: Column, form: Column) -> Column:
    """The text, from what output() gave and its form."""
    piece = F.split(out, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", out).otherwise(F.when(form == "psm", F.concat(piece[1], piece[3], piece[2])).otherwise(F.concat(piece[2], piece[3], piece[1])))


def transform(spark: SparkSession, docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row.

    Of a hundred documents about rate are transformed, and of these spm_rate begin with the suffix.
    """
    rows = indexed(placed(spark, docs))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    text = F.col("text")
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (drawn[2] % 100 >= rate)
    form = F.when(plain, "plain").when(drawn[3] % 100 < spm_rate, "spm").otherwise("psm")
    i, j = drawn[0] % (F.col("n") + 1), drawn[1] % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", "cuts", form.alias("form"), i.alias("i"), j.alias("j"))
    chosen = F.col("form") != "plain"
    cut = F.arrow_udf(_cut, "a long, b long")("cuts", F.when(chosen, F.least("i", "j")), F.greatest("i", "j"))
    rows = rows.select("doc_id", "text", "n", "form", cut.alias("cut")).select("doc_id", "text", "n", "form", F.col("cut.a").alias("a"), F.col("cut.b").alias("b"))
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    size = F.length("text")
    pieces = [F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, size - b)]
    return rows.select("doc_id", "n", "form", F.col("a").alias("prefix_chars"), (F.col("b") - F.col("a")).alias("middle_chars"), output(F.col("form"), *pieces, F.col("text")).alias("output"))


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """transform() with hashes of the output and of the text restored from it."""
    out = transform(spark, docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, [CAST('0x' || h[1 + 8 * k : 8 + 8 * k] AS BIGINT) FOR k IN [0, 1, 2, 3]] AS r FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS i, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS j,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain' WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:i], '') AS prefix, array_to_string(units[i + 1:j], '') AS middle, array_to_string(units[j + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
