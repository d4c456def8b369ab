"""Exact n-gram Jaccard self-join by token-combination prefixes, and its components (operator 8).

Sets are distinct word shingles, as 64-bit hashes, in hash order: the global order of the prefix filter. Identical
sets are one node. Two sets whose Jaccard similarity is PERCENT/100 at least must share a signature of their
prefixes. A rare token is a signature by itself. A frequent token (FREQUENT nodes or more, and more than
1/FREQUENT_TOKENS of all prefix places, so that the list of them has a fixed bound) signs together with its successor
in the set: a 2-combination, which a passage that many documents share rarely has whole. Combinations break more
easily, as a differing token may touch two of them, so prefixes that hold frequent tokens are extended until some
signature must survive (see prefix_length).

Pairs that share a signature are checked by size, then by parity bitmaps (each differing token flips one bit, so more
flipped bits than differences allowed exclude a pair; there are BITS times as many bits as tokens), then verified on the
texts. Only links between what isn't yet connected matter, in three rounds:

1. in each signature's bucket, by bands of size, the node that meets most others is a hub; each node is verified
   against the hub that it meets in most buckets, which connects a family of near copies by fewer links than nodes;
2. in buckets that still hold several components each node is paired with its nearest of each other component, NEAREST
   of them at most, and one pair for each pair of components is verified;
3. where that did not connect two components, or a node had more than NEAREST, all pairs across components that the
   bitmaps do not exclude are found; the nearest of each two components is verified, then those of components that are
   apart even so.

No link between different components is left unverified, no pair inside a component is made: copies don't grow
with the square of their number. Nothing about documents is collected but the bounded list of frequent tokens.

Signatures with more than 1/HOT of all postings are hot; a sketch of fixed size finds them, HOT at most. What is known
of them comes from aggregations with map-side combining and is broadcast, so that no task gets their rows; windows see
the others only. In buckets of more than BLOCK rows those of the largest component are dealt
out, and where more than BLOCK others remain, bands of size and blocks are cut that meet pairwise.
For verification a hub's text travels once for each CROWD of its nodes, and each other text once.

Edge cases: null text counts as empty; a document without words has no set and is its own component. With fewer words
than a shingle has, the whole sequence is one. Rows may repeat; rows of equal sets share a component, whose id is the
smallest doc_id (nulls ignored; null if there is no other). keep() leaves one row of each component, that of the smallest
doc_id (null last), then of the smallest hash of its text; documents without words all stay. Very long texts are one set
each, of any size. Other columns are ignored, whatever their names. Nodes are known by 64 bits of a hash of their set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import lean, mark, materialize, size_partitions, small, without
from quern.llm.words import distinct

#: What near-duplicate stages take by default; a contract may ask for others.
WIDTH = 5
PERCENT = 80
#: Tokens of fewer prefix places than this are rare, whatever their share.
FREQUENT = 16
#: Bound of the list of frequent tokens that goes to all workers.
FREQUENT_TOKENS = 500_000
#: A signature (or node) with more than 1/HOT of all postings (or rows) is hot; there are fewer than HOT.
HOT = 1000
SKETCH_ITEMS = 10_000
#: Rows of a bucket that are compared with each other at once.
BLOCK = 2000
#: Other components to which a row of a cell names its nearest node at once.
NEAREST = 8
#: Signatures that a row of a cell knows its node by: two nodes that share one of them are paired in its bucket only.
FIRSTS = 4
#: Bits of a bitmap for each token of its set, at least. In the first comparison of a bucket's rows a quarter is used.
BITS = 4
#: Nodes that are verified against one copy of their hub's text.
CROWD = 500
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. Bytes split and lower-case exactly as the contract's classes say."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    x = h[:n].copy()
    for i in range(1, width):
        x = x * _A + h[i : n + i] * _B + _C
    return distinct(_mix(x))


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def allowed(n: np.ndarray | int, m: np.ndarray | int, percent: int = PERCENT):
    """Most tokens that two similar sets of these sizes may differ in."""
    total = n + m
    return total - 2 * (-(-percent * total // (100 + percent)))


def zone_length(n: int, percent: int = PERCENT) -> int:
    """Places that the longest prefix of a set of n tokens can need: twice the removals, and two."""
    return min(n, 2 * n * (100 - percent) // 100 + 2)


def prefix_length(frequent: np.ndarray, n: int, percent: int = PERCENT) -> int:
    """Signatures needed, given which places hold frequent tokens.

    A similar set lacks r of our tokens and has i others, where 100 r + percent i <= (100 - percent) n. A lacking
    token touches the signatures it is in (two if the one before it combines), another token touches the combination
    that it falls into. The most that can be touched, as the best filling of that budget, must be less than all.
    """
    budget = (100 - percent) * n / 100
    most = np.arange(1, len(frequent) + 1)
    pairs = np.cumsum(frequent)
    twice = np.minimum(budget, pairs)
    rest = budget - twice
    inside = np.minimum(rest, pairs * percent / 100)
    touched = 2 * twice + inside * 100 / percent + (rest - inside)
    enough = np.flatnonzero(most > np.floor(touched + 1e-9))
    return int(enough[0]) + 1 if len(enough) else len(frequent)


def signatures(zone: np.ndarray, n: int, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of the signatures of a set of n tokens, of which zone has the first. frequent: sorted tokens."""
    if not len(zone):
        return zone
    at = np.searchsorted(frequent, zone)
    often = np.zeros(len(zone), bool) if not len(frequent) else frequent[np.minimum(at, len(frequent) - 1)] == zone
    p = prefix_length(often, n, percent)
    following = np.append(zone[1:], np.uint64(0))[:p]  # 0 ends a set
    return distinct(np.where(often[:p], _mix(zone[:p] * _A + following * _B + _C), zone[:p]))


def parity(x: np.ndarray) -> np.ndarray:
    """Bitmap in which each token flips a bit; at least BITS for each token, 64 to 262144, so that few differing tokens
    meet in a bit and cancel out, and sets that aren't similar differ in more bits than are allowed."""
    bits = 64
    while bits < BITS * len(x) and bits < 262144:
        bits *= 2
    odd = np.bincount((x >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def fold(x: np.ndarray, words: int) -> np.ndarray:
    """The bitmap with its halves laid over each other until it has so many words at most: still a bound."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def flipped(x: np.ndarray, y: np.ndarray) -> int:
    """Bits that differ between two bitmaps, the longer one folded."""
    words = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, words) ^ fold(y, words)).sum())


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, mark, node, n, place, zone, bits, short) of each row; the last three are left out where the task has met the
    node. short is bits folded to a quarter, 512 bits or more."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), mark(docs).alias("mark"), F.monotonically_increasing_id().alias("place"), docs["text"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            nodes, sizes, zones, bits, shorts = [], [], [], [], []
            for t in _texts(b.column(3)):
                x = shingle_set(t, width)
                node = xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63)
                new = len(x) > 0 and node not in met
                if len(met) > 200_000:
                    met.clear()
                met.add(node)
                nodes.append(node)
                sizes.append(len(x))
                zones.append(x[: zone_length(len(x), percent)].tobytes() if new else None)
                full = parity(x) if new else None
                bits.append(full.tobytes() if new else None)
                shorts.append(fold(full, max(8, len(full) // 4)).tobytes() if new else None)
            columns = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), b.column(2), *(pa.array(c, pa.binary()) for c in (zones, bits, shorts))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "node", "n", "place", "zone", "bits", "short"])

    return rows.mapInArrow(lean(run), "doc_id long, mark long, node long, n long, place long, zone binary, bits binary, short binary")


def _nodes(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """(node, n, zone, bits, short), each node once. Only the places of those that several tasks met are compared."""
    own = sets.filter("zone is not null")
    first = own.groupBy("node").agg(F.min("place").alias("first"), F.count("*").alias("k")).filter("k > 1")
    again = own.select("node", "place").join(first, "node").filter("place <> first").select("place")
    return own.join(small(materialize(spark, again, "again")), "place", "left_anti").select("node", "n", "zone", "bits", "short")


def _frequent_tokens(nodes: DataFrame, percent: int) -> np.ndarray:
    """Sorted tokens of many prefix places: FREQUENT_TOKENS at most, by the threshold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zones = [np.frombuffer(z, "<u8")[: n * (100 - percent) // 100 + 1] for z, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if zones:
                t, k = np.unique(np.concatenate(zones), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view("<i8")), pa.array(k)], ["t", "k"])

    own = nodes.select("zone", "n")
    total = own.agg(F.sum(F.floor(F.col("n") * (100 - percent) / 100) + 1).alias("t")).first().t or 0
    least = max(FREQUENT, int(total) // FREQUENT_TOKENS + 1)
    often = own.mapInArrow(lean(count), "t long, k long").groupBy("t").agg(F.sum("k").alias("k")).filter(F.col("k") >= least).select("t")
    return np.sort(often.toArrow()["t"].to_numpy().view(np.uint64))


def _postings(nodes: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """(sig, node, n)."""
    shared = nodes.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            names, sizes = b.column(1).to_numpy(), b.column(2).to_numpy()
            out = [signatures(np.frombuffer(z, "<u8"), int(n), often, percent) for z, n in zip(b.column(0).to_pylist(), sizes, strict=True)]
            k = [len(x) for x in out]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view("<i8")), pa.array(np.repeat(names, k)), pa.array(np.repeat(sizes, k))], ["sig", "node", "n"])

    return nodes.select("zone", "node", "n").mapInArrow(lean(run), "sig long, node long, n long")


def _buckets(spark: SparkSession, postings: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sig, node, n, rows) of the postings that may pair with another of their bucket, by size, rows being the
    bucket's; and the hot signatures, to be broadcast."""
    found = postings.agg(F.expr(f"approx_top_k(sig, {HOT}, {SKETCH_ITEMS})").alias("t"), F.count("*").alias("n")).first()
    hot = F.broadcast(spark.createDataFrame([(r["item"],) for r in found.t or [] if r["count"] > max(2, found.n // HOT)], "sig long"))
    w = Window.partitionBy("sig").orderBy("n", "node")
    cold = postings.join(hot, "sig", "left_anti").select("sig", "node", "n", F.lag("n").over(w).alias("nb"), F.lead("n").over(w).alias("na"), F.count("*").over(Window.partitionBy("sig")).alias("rows"))
    cold = cold.filter((F.col("nb") * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.col("na") * percent)).drop("nb", "na")
    many = postings.join(hot, "sig", "left_semi")
    many = many.join(F.broadcast(many.groupBy("sig").agg(F.count("*").alias("rows"))), "sig")
    return materialize(spark, cold.unionByName(many.select("sig", "node", "n", "rows")), "buckets"), hot


def _band(n: Column, percent: int, shift: float = 0.0) -> Column:
    """Number of a band of sizes. Sizes of similar sets fall into a band or two neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) * 0.999 + shift)


def _hub_pairs(live: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """(a, b): of each node b that has met a hub, the hub that it meets in most buckets. A hub is, in a bucket and band of
    sizes, the node that meets most others over all its buckets: of a text and its edited copies, which resemble it
    more than each other, that is the text."""
    weight = live.groupBy("node").agg(F.sum("rows").alias("w"))
    # bands of twice the width, from two places on: similar sizes share one of them
    cell = lambda shift: (2 * F.floor(_band(F.col("n"), percent) / 2 + shift) + int(2 * shift)).cast("long")
    own = live.join(weight, "node").select("sig", "node", "w", cell(0.0).alias("c0"), cell(0.5).alias("c1"))
    top = F.max(F.struct("w", "node"))
    cold = own.join(hot, "sig", "left_anti").repartition(size_partitions(live.sparkSession), "sig")
    cold = cold.select("node", *(top.over(Window.partitionBy("sig", c))["node"].alias(a) for c, a in (("c0", "a0"), ("c1", "a1"))))
    cold = cold.select(F.col("node").alias("b"), F.explode(F.array("a0", "a1")).alias("a"))
    cells = own.join(hot, "sig", "left_semi").select("sig", "node", "w", F.explode(F.array("c0", "c1")).alias("c"))
    hubs = cells.groupBy("sig", "c").agg(top["node"].alias("a"))
    many = cells.join(F.broadcast(hubs), ["sig", "c"]).select(F.col("node").alias("b"), "a")
    met = cold.unionByName(many).filter("a <> b").groupBy("a", "b").count()
    return met.groupBy("b").agg(F.max(F.struct("count", "a"))["a"].alias("a")).select("a", "b")


def _by_bitmap(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps do not differ in too many bits."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "xa", "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            d = np.array([flipped(np.frombuffer(s, "<u8"), np.frombuffer(t, "<u8")) for s, t in zip(p.column(4).to_pylist(), p.column(5).to_pylist(), strict=True)], np.int64)
            keep = pa.array(d <= allowed(p.column(2).to_numpy(), p.column(3).to_numpy(), percent))
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(1)], ["a", "b"]).filter(keep)

    return both.mapInArrow(lean(run), "a long, b long")


def _verified(spark: SparkSession, pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar by their texts. pairs is materialized."""
    crowds = pairs.groupBy("a").agg(F.ceil(F.count("*") / CROWD).alias("crowds"))
    # what each text is needed for: its own comparison with a hub, or to be one for a crowd
    crowd = F.pmod(F.xxhash64("b"), F.col("crowds"))
    nodes = pairs.join(crowds, "a").select(F.col("b").alias("node"), F.col("a").alias("hub"), crowd.alias("crowd"), F.lit(1).alias("role"))
    hubs = crowds.select(F.col("a").alias("node"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("crowds") - 1)).alias("crowd"), F.lit(0).alias("role"))
    roles = materialize(spark, nodes.unionByName(hubs), "roles")
    ends = small(materialize(spark, roles.select("node").distinct(), "ends"))
    one = sets.select("node", "doc_id", "mark").join(ends, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("r"))
    wanted = roles.join(one, "node").select(F.col("r.doc_id").alias("d"), F.col("r.mark").alias("m"), "node", "hub", "crowd", "role")
    wanted = small(materialize(spark, wanted, "wanted"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), mark(docs).alias("mark"), docs["text"].cast("string").alias("text"))
    rows = texts.join(wanted, texts["doc_id"].eqNullSafe(F.col("d")) & (texts["mark"] == F.col("m"))).select("hub", "crowd", "role", "node", "text")
    rows = rows.repartition(size_partitions(spark), "hub", "crowd").sortWithinPartitions("hub", "crowd", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for p in batches:
            ok = []
            for role, text in zip(p.column(1).to_pylist(), _texts(p.column(3)), strict=True):
                x = shingle_set(text, width)
                if role == 0:
                    hub = x
                ok.append(role == 1 and similar(hub, x, percent))
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(2)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # rows repeated under one doc_id and text give a pair more than once
    return materialize(spark, rows.select("hub", "role", "node", "text").mapInArrow(lean(run), "a long, b long").distinct(), "links")


def components(spark: SparkSession, links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, lab): the smallest node that links (a, b), and those that gave known, connect to it.

    Each node goes to its smallest neighbour, by pointer jumping to the end of that way; then links are between these ends,
    of which there are half as many nodes at most. Links within one are gone, so all rounds together are about one."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("lab"))
    labels = ends if known is None else known.select("node", "lab").unionByName(ends)
    labels = materialize(spark, labels.groupBy("node").agg(F.min("lab").alias("lab")), "labels")
    edges, moved = links.select("a", "b"), None if known is None else labels
    while True:
        if moved is not None:
            to = small(moved)
            for c in ("a", "b"):
                edges = edges.join(to.select(F.col("node").alias(c), F.col("lab").alias(f"l{c}")), c)
            edges = edges.select(F.col("la").alias("a"), F.col("lb").alias("b"))
        edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = materialize(spark, edges, "edges")
        if not edges.limit(1).count():
            return labels
        # of the larger node of a link; the smaller one needs no link of its own to stay where it is
        smaller = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("lab")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("lab")))
        moved = materialize(spark, smaller.groupBy("node").agg(F.min("lab").alias("lab")), "moved")
        while True:
            to = small(moved).select(F.col("node").alias("lab"), F.col("lab").alias("far"))
            jump = materialize(spark, moved.join(to, "lab").select("node", F.col("lab").alias("old"), F.col("far").alias("lab")), "moved")
            moved = jump.select("node", "lab")
            if not jump.filter("lab <> old").limit(1).count():
                break
        to = small(moved).select(F.col("node").alias("lab"), F.col("lab").alias("far"))
        labels = materialize(spark, labels.join(to, "lab", "left").select("node", F.coalesce("far", "lab").alias("lab")), "labels")


def _nearest(pairs: DataFrame) -> DataFrame:
    """(a, b): of the pairs of each two components the one with the fewest bits between."""
    return pairs.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min(F.struct("d", "a", "b")).alias("x")).select("x.a", "x.b")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose components ca and cb are still two by labels."""
    for c in ("ca", "cb"):
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("lab").alias(f"l{c}")), c, "left")
    return pairs.filter(F.coalesce("lca", "ca") != F.coalesce("lcb", "cb")).drop("lca", "lcb")


def _mixed(spark: SparkSession, live: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components, with their component lab."""
    own = live.join(small(labels), "node", "left").select("sig", "node", "n", "rows", F.coalesce("lab", "node").alias("lab"))
    own = materialize(spark, own, "labelled")
    w = Window.partitionBy("sig")
    cold = own.join(hot, "sig", "left_anti").select("*", F.min("lab").over(w).alias("l1"), F.max("lab").over(w).alias("l2")).filter("l1 <> l2").drop("l1", "l2")
    many = own.join(hot, "sig", "left_semi")
    many = many.join(F.broadcast(many.groupBy("sig").agg(F.min("lab").alias("l1"), F.max("lab").alias("l2")).filter("l1 <> l2").select("sig")), "sig", "left_semi")
    return materialize(spark, cold.unionByName(many), "mixed")


def _cells(spark: SparkSession, mixed: DataFrame, percent: int) -> DataFrame:
    """(sig, band, i, j, side, guest, node, n, lab): rows that are compared with each other share (sig, band, i, j).

    A bucket of BLOCK rows at most is one cell. In another the rows of its largest component, which need not meet each
    other, are dealt to cells once each, and the other rows, BLOCK at most, come to every cell, as guests to all but the
    first. With more other rows it is cut by bands of size, to each of which the next lower band comes as guests, and a
    band into blocks of about BLOCK rows, each pair of which is a cell.
    """
    whole = mixed.filter(F.col("rows") <= BLOCK).select("sig", F.lit(-1).cast("long").alias("band"), *(F.lit(0).alias(c) for c in ("i", "j", "side", "guest")), "node", "n", "lab")
    big = mixed.filter(F.col("rows") > BLOCK)
    most = big.groupBy("sig", "lab").agg(F.count("*").alias("c")).groupBy("sig").agg(F.max(F.struct("c", "lab")).alias("m"), F.sum("c").alias("all"))
    most = materialize(spark, most.select("sig", F.col("m.lab").alias("main"), (F.col("all") - F.col("m.c")).alias("others"), F.ceil(F.col("all") / BLOCK).cast("int").alias("parts")), "large")
    big = big.join(small(most), "sig")
    dealt = big.filter(F.col("others") <= BLOCK)
    each = lambda rows, guest: rows.select("sig", F.lit(-2).cast("long").alias("band"), F.col("part").alias("i"), F.col("part").alias("j"), F.lit(0).alias("side"), guest.alias("guest"), "node", "n", "lab")
    whole = whole.unionByName(each(dealt.filter("lab = main").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), F.lit(0)))
    whole = whole.unionByName(each(dealt.filter("lab <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), (F.col("part") > 0).cast("int")))
    band = _band(F.col("n"), percent)
    cut = big.filter(F.col("others") > BLOCK).select("sig", "node", "n", "lab", F.explode(F.array(F.struct(band.alias("band"), F.lit(0).alias("guest")), F.struct((band + 1).alias("band"), F.lit(1).alias("guest")))).alias("x"))
    cut = cut.select("sig", "x.band", "x.guest", "node", "n", "lab")
    sizes = materialize(spark, cut.groupBy("sig", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("guest").alias("g")).filter("g = 0").drop("g"), "cells")
    cut = cut.join(small(sizes), ["sig", "band"])
    cut = cut.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return whole.unionByName(cut.select("sig", "band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "guest", "node", "n", "lab"))


def _cell_pairs(rows: list[tuple], percent: int, most: int | None) -> Iterator[list[np.ndarray]]:
    """[a, b, ca, cb, d] of the pairs of a cell, whose rows are in order of size. With most only the nearest of each other
    component for each row, so many of the nearest, and of those one pair for each two components; if there are more, (sig, sig, 0, 0, -1) is given once for the cell.

    Near copies share most of their buckets. A pair that is known to share a smaller signature is left to that bucket: the
    smallest that two nodes share always has them. It still counts among a row's nearest, so that other buckets do not
    name others in its place."""
    sig, i, j = rows[0][0], rows[0][2], rows[0][3]
    side, guest = np.array([r[4] for r in rows]), np.array([r[5] for r in rows], bool)
    node, n, lab = (np.array([r[k] for r in rows]) for k in (6, 7, 8))
    first = np.array([r[10:] for r in rows])
    words = np.array([len(r[9]) // 8 for r in rows])  # ascending, as sizes are
    maps, begins, width = np.zeros((0, 0), np.uint64), 0, 0
    ends = np.searchsorted(n, n * 100 // percent, side="right")
    out: list[list[np.ndarray]] = []
    held, cut = 0, False

    def give() -> list[np.ndarray]:
        x, y, d = (np.concatenate(c) for c in zip(*out, strict=True))
        turned = node[x] > node[y]
        a, b = np.where(turned, y, x), np.where(turned, x, y)
        if most is not None:  # one pair for each pair of components
            low, high = np.minimum(lab[a], lab[b]), np.maximum(lab[a], lab[b])
            order = np.lexsort((d, high, low))
            order = order[np.append(True, (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0))]
            a, b, d = a[order], b[order], d[order]
        return [node[a], node[b], lab[a], lab[b], d]

    for k in range(len(rows)):
        if words[k] != width:  # similar sets have as many bits, or twice as many: these are folded
            width, begins = int(words[k]), k
            maps = np.stack([fold(np.frombuffer(r[9], "<u8"), width) for r in rows[k : int(np.searchsorted(words, 2 * width, side="right"))]])
        some = slice(k + 1, int(ends[k]))
        ok = lab[some] != lab[k]
        if i != j:
            ok &= side[some] != side[k]
        if guest[k]:
            ok &= ~guest[some]
        found = np.flatnonzero(ok) + k + 1
        if not len(found):
            continue
        d = np.bitwise_count(maps[found - begins] ^ maps[k - begins]).sum(axis=1).astype(np.int64)
        close = d <= allowed(n[found], n[k], percent)
        found, d = found[close], d[close]
        before = first[k][first[k] < sig]
        own = ~(first[found][:, :, None] == before).any(axis=(1, 2))
        if not own.any():
            continue
        if most is not None:
            order = np.argsort(d, kind="stable")
            found, d, own = found[order], d[order], own[order]
            firsts = np.sort(np.unique(lab[found], return_index=True)[1])
            named = np.isin(lab[found], lab[found[firsts[:most]]])
            cut |= bool((own & ~named).any())
            found, d = found[own & named], d[own & named]
            firsts = np.sort(np.unique(lab[found], return_index=True)[1])
            found, d = found[firsts], d[firsts]
        else:
            found, d = found[own], d[own]
        if not len(found):
            continue
        out.append([np.full(len(found), k), found, d])
        held += len(found)
        if held > 200_000:
            yield give()
            out, held = [], 0
    if out:
        yield give()
    if cut:
        yield [np.array([v]) for v in (rows[0][0], rows[0][0], 0, 0, -1)]


def _across(spark: SparkSession, mixed: DataFrame, nodes: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Distinct pairs (a, b, ca, cb, d) of nodes of different components that share a bucket and pass size and bitmap;
    with most also (sig, sig, 0, 0, -1) of the buckets that have more."""
    firsts = mixed.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, FIRSTS).alias("s"))
    known = nodes.select("node", F.col("bits" if most is None else "short").alias("bits")).join(firsts, "node").select("node", "bits", *(F.coalesce(F.get("s", F.lit(k)), F.get("s", F.lit(0))).alias(f"s{k}") for k in range(FIRSTS)))
    own = _cells(spark, mixed, percent).join(known, "node").select("sig", "band", "i", "j", "side", "guest", "node", "n", "lab", "bits", *(f"s{k}" for k in range(FIRSTS)))
    key = ["sig", "band", "i", "j"]
    own = own.repartition(size_partitions(spark), *key).sortWithinPartitions(*key, "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                for columns in _cell_pairs(rows, percent, most):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "ca", "cb", "d"])
            rows.clear()

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and rows[0][:4] != r[:4]:
                    yield from close()
                rows.append(r)
        yield from close()

    return own.mapInArrow(lean(run), "a long, b long, ca long, cb long, d long").groupBy("a", "b", "ca", "cb").agg(F.min("d").alias("d"))


def join(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sets, labels): sets (doc_id, mark, node, n) of each row, labels (node, lab) of the nodes with links."""
    sets = materialize(spark, _sets(docs, width, percent), "sets")
    nodes = _nodes(spark, sets)
    postings = materialize(spark, _postings(nodes, _frequent_tokens(nodes, percent), percent), "postings")
    live, hot = _buckets(spark, postings, percent)
    stars = materialize(spark, _by_bitmap(_hub_pairs(live, hot, percent), nodes, percent), "stars")
    links = _verified(spark, stars, docs, sets, width, percent)
    labels = components(spark, links)
    mixed = _mixed(spark, live, labels, hot)
    across = materialize(spark, _across(spark, mixed, nodes, percent, NEAREST), "across")
    pairs, more = across.filter("d >= 0"), across.filter("d < 0").select(F.col("a").alias("sig"))
    labels = components(spark, _verified(spark, materialize(spark, _nearest(pairs), "once"), docs, sets, width, percent), labels)
    # what is left: components (of round 1) that met and are still apart, and buckets with more than was named
    now = small(labels)
    apart = _apart(pairs.select("ca", "cb").distinct(), now)
    apart = materialize(spark, apart.select(F.explode(F.array("ca", "cb")).alias("lab")).distinct(), "apart")
    left = mixed.join(small(apart), "lab", "left_semi").unionByName(mixed.join(small(more), "sig", "left_semi")).distinct()
    left = materialize(spark, left.select("sig", "node", "n", "rows", "lab"), "left")
    if left.limit(1).count():
        # by the components of now
        own = left.drop("lab").join(now, "node", "left").withColumn("lab", F.coalesce("lab", "node"))
        across = materialize(spark, _across(spark, own, nodes, percent, None), "across")
        # the nearest of two components first: where it connects them, no other pair of theirs is needed
        for some in (lambda: _nearest(across), lambda: _apart(across, small(labels)).select("a", "b")):
            pairs = materialize(spark, some(), "pairs")
            if not pairs.limit(1).count():
                break
            labels = components(spark, _verified(spark, pairs, docs, sets, width, percent), labels)
    return sets.select("doc_id", "mark", "node", "n"), labels


def decided(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, mark, n, keep_id, keep_mark: the row that its component leaves, itself if it has no words."""
    sets, labels = join(spark, docs, width, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "mark"))
    words = sets.filter("n > 0")
    own = words.groupBy("node").agg(first.alias("r"), F.count("*").alias("k")).join(labels, "node", "left").filter("lab is not null or k > 1").withColumn("lab", F.coalesce("lab", "node"))
    own = materialize(spark, own, "firsts")
    known = own.join(own.groupBy("lab").agg(F.min("r").alias("best")), "lab").select("node", "k", F.col("best.doc_id").alias("keep_id"), F.col("best.mark").alias("keep_mark"))
    known = materialize(spark, known, "known")
    # rows of hot nodes, which many rows share, go round the shuffled join
    least = max(2, sets.count() // HOT + 1)
    hot = F.broadcast(known.filter(F.col("k") >= least).drop("k").withColumnsRenamed({"keep_id": "hot_id", "keep_mark": "hot_mark"}).withColumn("is_hot", F.lit(True)))
    near = words.join(hot, "node", "left")
    done = near.filter("is_hot").select("doc_id", "mark", "n", F.col("hot_id").alias("keep_id"), F.col("hot_mark").alias("keep_mark"))
    rest = near.filter("is_hot is null").select("doc_id", "mark", "n", "node").join(small(known.filter(F.col("k") < least).select("node", "keep_id", "keep_mark")), "node", "left")
    itself = lambda c: F.when(F.col("keep_mark").isNull(), F.col(c)).otherwise(F.col("keep_id" if c == "doc_id" else "keep_mark"))
    rest = rest.select("doc_id", "mark", "n", itself("doc_id").alias("keep_id"), itself("mark").alias("keep_mark"))
    return done.unionByName(rest).unionByName(sets.filter("n = 0").select("doc_id", "mark", "n", F.col("doc_id").alias("keep_id"), F.col("mark").alias("keep_mark")))


def report(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id; mark (a hash of the text) follows."""
    return decided(spark, docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("keep_id").alias("component_id"), "mark")


def keep(spark: SparkSession, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with their columns: one of each component."""
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark"))
    rows = decided(spark, docs, width, percent).filter("n > 0").groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m"), stays.alias("stays")).count().filter("not stays or count > 1")
    rows = materialize(spark, rows, "members")
    return without(docs, rows.filter("not stays").select("d", "m"), rows.filter("stays").select("d", "m"))
