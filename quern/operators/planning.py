"""Query planning as columns: intent, variants, candidate windows and channel weights of a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import clamp
from quern.functions.text import collapse

# Cue words and patterns of the planner.
POLITE = r"(?i)^(?:请问|请帮我|麻烦(?:帮我)?|帮我(?:查找|查|找|看看|了解)?|我想(?:知道|了解)|please|could you|can you)\s*"
CANONICAL = ((r"咋办|怎么办", "处理方案"), (r"咋样|怎样|怎么", "如何"), (r"[?？]+\s*$", ""))
QUESTION_HEAD = r"(?i)^(?:什么是|如何|为什么|是否|哪些|哪里|何时|谁|what is|how to|why is|which)\s*"
QUESTION_TAIL = r"(?i)(?:是什么|有哪些|如何处理|如何操作|吗|呢)\s*$"
QUOTED = r"[\"“”']([^\"“”']{2,80})[\"“”']"
#: \b of ASCII words; Java's own takes letters of any script, and up to which version depends on the JVM.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
EXACT = _EDGE + r"([A-Z]{2,}[A-Z0-9._/-]*|[A-Za-z0-9_-]+\.(?:pdf|docx?|xlsx?|pptx?|md|txt)|[A-Za-z]+-[0-9]{2,})" + _EDGE
COMPARING = r"(?i)(区别|差异|不同|对比|比较|优缺点|vs\.?|versus|difference|compare)"
COMPARING_CUTS = (
    (r"^(?:请)?(?:比较|对比|分析)\s*", ""),
    (r"(?:之间)?(?:的)?(?:区别|差异|不同|对比|比较|优缺点)(?:是什么|有哪些|如何)?\s*$", ""),
    (r"(?i)(?:what is|what are)?\s*the\s*differences?\s*between\s*", ""),
    (r"(?i)\s*(?:differences?|compare)\s*$", ""),
)
COMPARED = r"(?i)\s*(?:和|与|跟|及|以及|vs\.?|versus|and)\s*"
ANALYSIS = r"(?i)(分析|原因|影响|趋势|总结|归纳|综合|多方面|分别说明|为什么|how does|analy[sz]e|compare the impact|summari[sz]e)"
#: intent: candidate factor, keyword weight, vector weight, results of an answer (null: as asked)
BY_INTENT = {"exact": (0.6, 1.5, 0.7, 3), "fact": (1.0, 1.0, 1.1, 5), "comparison": (1.5, 1.0, 1.2, None), "analysis": (1.75, 0.9, 1.3, None)}


def rewrite(text: Column) -> Column:
    """Without polite beginnings and closing question marks, colloquial forms as canonical ones."""
    out = F.regexp_replace(text, POLITE, "")
    for pattern, to in CANONICAL:
        out = F.regexp_replace(out, pattern, to)
    return collapse(out)


def keywords(text: Column) -> Column:
    return collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, QUESTION_HEAD, ""), QUESTION_TAIL, ""), "[?？]", " "))


def _distinct_folded(values: Column) -> Column:
    """Without empty values and those that an earlier one equals but for case."""
    firsts = F.filter(values, lambda v: v != "")
    return F.filter(firsts, lambda v, i: F.array_position(F.transform(firsts, F.lower), F.lower(v)) == i + 1)


def exact_terms(text: Column) -> Column:
    """Quoted phrases, then acronyms, file names and numbered codes."""
    quoted = F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), lambda x: F.trim(x))
    return _distinct_folded(F.concat(quoted, F.regexp_extract_all(text, F.lit(EXACT), F.lit(1))))


def compared_subjects(text: Column) -> Column:
    """Up to two things that the text compares."""
    clean = text
    for pattern, to in COMPARING_CUTS:
        clean = F.regexp_replace(clean, pattern, to)
    parts = F.filter(F.transform(F.split(clean, COMPARED), lambda x: F.trim(x)), lambda p: F.length(p).between(2, 100))
    return F.when(text.rlike(COMPARING), F.slice(_distinct_folded(parts), 1, 2)).otherwise(F.array().cast("array<string>"))


def plan(queries: DataFrame, base: int = 200, results: int = 8, source: str | None = None, enabled: bool = True) -> DataFrame:
    """Adds the plan of each row's query: intent, variants and limits."""
    out = queries.withColumn("original", collapse(F.col("query"))).withColumn("normalized", rewrite(F.col("original")))
    out = out.withColumn("terms", exact_terms(F.col("original"))).withColumn("subjects", compared_subjects(F.col("normalized")))
    many = F.size(F.regexp_extract_all(F.col("original"), F.lit("([?？])"), F.lit(1))) > 1
    intent = F.when(F.size("subjects") >= 2, "comparison").when(F.size("terms") > 0, "exact").when((F.length("original") >= 80) | F.col("original").rlike(ANALYSIS) | many, "analysis").otherwise("fact")
    out = out.withColumn("intent", intent)
    window, wanted = min(500, max(20, round(base))), min(50, max(1, round(results)))
    variant = lambda text, kind, weight, vector: F.struct(text.alias("text"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), F.lit(vector).alias("use_vector"))
    all_ = F.array(variant(F.col("original"), "original", 1.0, True))
    by_intent = lambda i: F.coalesce(*(F.when(F.col("intent") == k, F.lit(v[i])) for k, v in BY_INTENT.items()))
    if enabled:
        keyword = keywords(F.col("normalized"))
        more = (
            F.when(F.col("intent") == "comparison", F.transform("subjects", lambda s: variant(s, "subquery", 0.85, True)))
            .when(F.col("intent") == "exact", F.transform(F.slice("terms", 1, 2), lambda s: variant(s, "exact", 1.1, False)))
            .otherwise(F.array(variant(keyword, "keyword", 0.85, False)))
        )
        all_ = F.filter(F.concat(all_, F.array(variant(F.col("normalized"), "normalized", 0.95, True)), more), lambda v: v["text"] != "")
        folded = F.transform(all_, lambda v: F.lower(v["text"]))
        all_ = F.slice(F.filter(all_, lambda v, i: F.array_position(folded, F.lower(v["text"])) == i + 1), 1, 4)
        limits = clamp(F.floor(by_intent(0) * window + 0.5).cast("int"), 20, 500), by_intent(1), by_intent(2)
        k = F.least(F.lit(wanted), F.coalesce(by_intent(3), F.lit(wanted))) if source == "answer" else F.lit(wanted)
    else:
        limits, k = (F.lit(window), F.lit(1.0), F.lit(1.0)), F.lit(wanted)
    return out.select(*queries.columns, "intent", all_.alias("variants"), limits[0].alias("candidate_limit"), k.alias("result_limit"), limits[1].alias("keyword_weight"), limits[2].alias("vector_weight"))
