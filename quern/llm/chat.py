"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only (operator 5).

A log that stores the whole conversation after each exchange holds every conversation many times, as prefixes of its
last state. Each conversation's turns get a rolling hash: that of turn k covers turns 1 to k. A conversation whose
last hash is an inner hash of another is a prefix of it; an anti-join leaves the maximal ones, which are rendered.

Turns are hashed where they are read, so that grouping moves digests and no texts. Only conversations with different
texts under one turn and role, whose order the texts decide, are grouped again with theirs. Texts move once, for
rendering, and while the maximal conversations number BROADCAST_ROWS at most, only those of these.

Equal conversations are merged before the join (smallest conv_id stays) and inner hashes are distinct, both after
pre-aggregation, so neither side of the join has a hot key: a first turn or a conversation that a third of the log
shares is one row there. A conversation itself is one row, in the result too, and must fit a task.

Edge cases: turns are ordered by turn (null first), then role, then text; null role or text counts as empty but
hashes apart from it; repeated rows are turns of their own. Rows with a null conv_id are one conversation. Whole texts
are hashed and rendered, of any length. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, small

#: A conversation's id as two columns without nulls: plain equality joins on them, and grouping reuses that exchange.
KEYS = ["conv_key", "no_conv"]


def _turn_digest() -> Column:
    """Of role and text, length-prefixed so that no other pair gives the same bytes; null apart from empty."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(part(F.col("role")), F.lit("|"), part(F.col("text"))), 256))


def _own(turns: DataFrame) -> DataFrame:
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.select(F.coalesce("conv_id", F.lit(0)).alias("conv_key"), F.col("conv_id").isNull().alias("no_conv"), "turn", "role", "text")


def _in_order(*columns: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*columns)))


def rolling(digests: Column) -> Column:
    """Array of hashes: the k-th covers the first k turns.

    An array is copied when it grows, so hashes are gathered in blocks of the root of their number."""
    n = F.size(digests)
    block = F.ceil(F.sqrt(n)).cast("int")
    step = lambda a, d: F.concat(a, F.array(F.unhex(F.sha2(F.concat(F.element_at(a, -1), d), 256))))

    def one(done: Column, b: Column) -> Column:
        last = F.coalesce(F.try_element_at(F.try_element_at(done, F.lit(-1)), F.lit(-1)), F.lit("").cast("binary"))
        run = F.aggregate(F.slice(digests, b * block + 1, block), F.array(last), step)
        return F.concat(done, F.array(F.slice(run, F.lit(2), block)))

    whole = F.flatten(F.aggregate(F.sequence(F.lit(0), F.ceil(n / block).cast("int") - 1), F.array().cast("array<array<binary>>"), one))
    return F.when(n > 0, whole).otherwise(F.array().cast("array<binary>"))


def _tied(ts: Column) -> Column:
    """Whether neighbours of the ordered turns have the same turn and role and different texts."""
    before = lambda i: F.get(ts, i - 1)
    same = lambda t, i: (i > 0) & t["turn"].eqNullSafe(before(i)["turn"]) & t["role"].eqNullSafe(before(i)["role"]) & (t["d"] != before(i)["d"])
    return F.size(F.filter(ts, same)) > 0


def _hashes(turns: DataFrame) -> DataFrame:
    """(KEYS, hashes): the rolling hashes of each conversation."""
    spark, own = turns.sparkSession, _own(turns)
    digests = lambda: F.transform("ts", lambda t: t["d"])
    by_digest = own.select(*KEYS, "turn", "role", _turn_digest().alias("d")).groupBy(*KEYS).agg(_in_order("turn", "role", "d").alias("ts"))
    convs = materialize(spark, by_digest.select(*KEYS, _tied(F.col("ts")).alias("tied"), digests().alias("ds")).select(*KEYS, "tied", rolling(F.col("ds")).alias("hashes")), "chat-hashes")
    sure, tied = convs.filter("not tied").select(*KEYS, "hashes"), convs.filter("tied").select(*KEYS)
    if not tied.limit(1).count():
        return sure
    by_text = own.join(small(tied), KEYS, "left_semi").withColumn("d", _turn_digest()).groupBy(*KEYS).agg(_in_order("turn", "role", "text", "d").alias("ts"))
    return sure.unionByName(materialize(spark, by_text.select(*KEYS, digests().alias("ds")).select(*KEYS, rolling(F.col("ds")).alias("hashes")), "chat-tied"))


def _maximal(turns: DataFrame) -> DataFrame:
    """(KEYS, n_turns, n_copies)"""
    convs = _hashes(turns)
    inner = convs.select(F.explode(F.slice("hashes", F.lit(1), F.size("hashes") - 1)).alias("whole")).distinct()
    first = F.min(F.struct("no_conv", "conv_key"))  # null last
    kinds = convs.groupBy(F.element_at("hashes", -1).alias("whole")).agg(first.alias("id"), F.count("*").alias("n_copies"), F.max(F.size("hashes")).cast("long").alias("n_turns"))
    return kinds.join(inner, "whole", "left_anti").select("id.*", "n_turns", "n_copies")


def _id() -> Column:
    return F.when(~F.col("no_conv"), F.col("conv_key")).alias("conv_id")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that are no prefix of a longer one, one of each kind."""
    return _maximal(turns).select(_id(), "n_turns", "n_copies")


def render(turns: Column) -> Column:
    say = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))
    return F.concat(F.array_join(F.transform(turns, say), ""), F.lit("<|end|>"))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of each maximal conversation."""
    top = small(materialize(turns.sparkSession, _maximal(turns), "chat-maximal"))
    mine = _own(turns).join(top, KEYS).groupBy(*KEYS).agg(F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), _in_order("turn", "role", "text").alias("turns"))
    return mine.select(_id(), "n_turns", "n_copies", render(F.col("turns")).alias("rendered"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
p AS (
  SELECT conv_id, k, n, string_agg(length(role) || ':' || role || '|' || length(text) || ':' || text, ';') OVER (PARTITION BY conv_id ORDER BY k) AS head FROM t),
whole AS (SELECT head, min(conv_id) AS conv_id, count(*) AS n_copies, max(n) AS n_turns FROM p WHERE k = n GROUP BY head),
top AS (SELECT * FROM whole WHERE head NOT IN (SELECT head FROM p WHERE k < n))
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, n_copies, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY k) || '<|end|>' AS rendered
FROM top JOIN t USING (conv_id) GROUP BY conv_id, n_turns, n_copies
"""
