"""Answering from evidence: extraction, citations, grounding, history, prompt packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

# Words that don't count as question terms.
STOP_WORDS = ("and", "are", "for", "from", "how", "in", "is", "of", "the", "to", "what", "with")


def question_terms(question: Column) -> Column:
    return F.filter(F.array_distinct(T.words(question)), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def plain_sentences(content: Column) -> Column:
    """Sentences of Markdown without headings, links and images as their texts."""
    out = F.regexp_replace(content, r"(?m)^#{1,6}\s+.*$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"!\[([^\]]*)\]\([^)]+\)", "$1"), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.transform(F.regexp_extract_all(T.collapse(out), F.lit("([^。！？.!?]+[。！？.!?]?)"), F.lit(1)), lambda x: F.trim(x))


def extractive_answer(hits: DataFrame, questions: DataFrame, most: int = 3, chars: int = 400) -> DataFrame:
    """(qid, answer): of each of the best hits the sentence with most letters of matched terms (the first of ties),
    with its citation."""
    own = hits.filter(F.col("rank") <= most).join(questions.select("qid", question_terms(F.col("query")).alias("terms")), "qid")
    s = own.select("qid", "rank", "content", "terms", F.posexplode_outer(plain_sentences(F.col("content"))).alias("at", "sentence"))
    score = F.aggregate(F.filter("terms", lambda t: F.contains(F.lower("sentence"), t)), F.lit(0), lambda n, t: n + F.length(t))
    best = s.groupBy("qid", "rank").agg(F.max_by(F.coalesce("sentence", F.lit("")), F.struct(score.alias("s"), (-F.col("at")).alias("a"))).alias("sentence"))
    line = F.concat(F.substring("sentence", 1, chars), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    return best.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("answer"))


def grounding(answers: DataFrame) -> DataFrame:
    """Of (…, answer, n_hits): the ordinals it cites and why it isn't grounded (null: it is)."""
    body = F.regexp_replace(F.regexp_replace("answer", r"[\[【]\d+(?:\s*[,，、]\s*\d+)*[\]】]", ""), r"[\s#>*_`~\-|:：]", "")
    out = answers.withColumn("ordinals", T.citations(F.col("answer")))
    bad = F.filter("ordinals", lambda n: (n < 1) | (n > F.col("n_hits")))
    reason = F.when(F.col("n_hits") == 0, "no_evidence").when(F.size(bad) > 0, "invalid_citations").when(F.size("ordinals") == 0, "missing_citations").when(F.length(body) == 0, "empty_answer")
    return out.withColumn("reason", reason).withColumn("grounded", F.col("reason").isNull())


def history(messages: DataFrame, most: int, tokens: int) -> DataFrame:
    """The latest messages of each conversation that fit the budget, counted back from the newest; the first that
    doesn't fit ends them."""
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    out = messages.withColumn("tokens", T.estimate_tokens(F.col("text"))).withColumn("back", F.row_number().over(back)).filter(F.col("back") <= most)
    return out.withColumn("so_far", F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("so_far") <= tokens)


def pack_prompt(evidence: DataFrame, budget: int) -> DataFrame:
    """(qid, rank, taken): whole blocks in rank order while they fit, then one cut to what is left, then no more.

    A question's evidence (50 blocks at most) is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = budget, []
        for r in pdf.sort_values("rank").itertuples():
            take = min(left, int(r.tokens))
            if take <= 0:
                break
            out.append((r.qid, r.rank, take))
            left -= take
            if take < r.tokens:
                break
        return pd.DataFrame(out, columns=["qid", "rank", "taken"])

    return evidence.groupBy("qid").applyInPandas(run, "qid long, rank int, taken int")


def contained_duplicates(hits: DataFrame) -> DataFrame:
    """Hits that a longer text at the same location contains (of equal texts all but the best rank) go."""
    other = hits.select(F.col("qid").alias("q"), F.col("location").alias("l"), F.col("content").alias("c"), F.col("rank").alias("r"))
    longer = (F.length("c") > F.length("content")) | ((F.length("c") == F.length("content")) & (F.col("r") < F.col("rank")))
    return hits.join(other, (F.col("qid") == F.col("q")) & (F.col("location") == F.col("l")) & F.contains("c", F.col("content")) & longer, "left_anti")


# How questions name places.
PAGE = r"(?i)第\s*(\d+)\s*页|page\s*(\d+)"
SLIDE = r"(?i)第\s*(\d+)\s*(?:张|页)?\s*幻灯片|slide\s*(\d+)"
SECTION = r"""(?iu)(?:章节|小节|标题|section)\s*[:：]?\s*[“"'《]?([^”"'》,，。?？]{1,80})"""
CELLS = r"(?iu)(?<![\p{L}\p{N}_])(?:(?:'([^']+)'|([\p{L}\p{N}_-]+))!)?\$?([A-Z]{1,3})\$?(\d+)(?:\s*(?::|到|-)\s*\$?([A-Z]{1,3})\$?(\d+))?(?![\p{L}\p{N}_])"


def _number(question: Column, pattern: str) -> Column:
    """The first group that took part, as a number above 0; null without one."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(question, pattern, i), F.lit("")) for i in (1, 2))).try_cast("int")
    return F.when(found > 0, found)


def page_of(question: Column) -> Column:
    return _number(question, PAGE)


def slide_of(question: Column) -> Column:
    return _number(question, SLIDE)


def section_of(question: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(question, SECTION, 1)), F.lit(""))


def cells_of(question: Column) -> Column:
    """(sheet, letters, row, letters, row) of the first A1 range, a single cell being a range; null without one."""
    g = [F.regexp_extract(question, CELLS, i) for i in range(1, 7)]
    sheet = F.trim(F.when(g[0] != "", g[0]).otherwise(g[1]))
    end = [F.when(g[i] == "", g[i - 2]).otherwise(g[i]) for i in (4, 5)]
    rows = [x.try_cast("int") for x in (g[3], end[1])]
    found = F.struct(F.nullif(sheet, F.lit("")).alias("sheet"), F.upper(g[2]).alias("c1"), rows[0].alias("r1"), F.upper(end[0]).alias("c2"), rows[1].alias("r2"))
    return F.when((g[2] != "") & rows[0].isNotNull() & rows[1].isNotNull(), found)


def ranges_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of cell ranges of the same sheet that share a cell."""
    on = (F.col("a.sheet") == F.col("b.sheet")) & (F.col("a.r1") <= F.col("b.r2")) & (F.col("b.r1") <= F.col("a.r2")) & (F.col("a.c1") <= F.col("b.c2")) & (F.col("b.c1") <= F.col("a.c2"))
    return a.alias("a").join(b.alias("b"), on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
