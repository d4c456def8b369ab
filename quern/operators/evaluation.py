"""Evaluation of retrieval: recall, nDCG, distributions, bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.numbers import half_up, ratio
from quern.sources import structure as S

# Multiplier and increment of the linear congruential generator, modulo 2**32.
LCG = (1664525, 1013904223)
MASK = np.uint64(0xFFFFFFFF)


def recall_at(hits: DataFrame, queries: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(k, recall): share of queries whose first relevant hit is among the first k."""
    first = hits.filter("relevant").groupBy("qid").agg(F.min("rank").alias("first"))
    each = queries.join(first, "qid", "left").select("first", F.explode(F.array(*map(F.lit, cutoffs))).alias("k"))
    return each.groupBy("k").agg(F.avg(F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)).alias("recall"))


def ndcg_at(hits: DataFrame, k: int) -> DataFrame:
    """(qid, ndcg): gain 2**relevance - 1, discount log2(rank + 1); 1 where nothing is relevant; four digits."""
    gain = F.pow(F.lit(2.0), F.col("relevance").cast("double")) - 1
    ideal = Window.partitionBy("qid").orderBy(F.desc("relevance"))
    own = hits.withColumn("place", F.row_number().over(ideal))
    sums = own.groupBy("qid").agg(F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("best"))
    return sums.select("qid", F.when(F.col("best") == 0, 1.0).otherwise(half_up(F.col("dcg") / F.nullif(F.col("best"), F.lit(0.0)), 4)).alias("ndcg"))


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts, sums, extremes and nearest-rank percentiles."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(*keys).agg(F.count(value).alias("samples"), F.round(F.sum(value), 2).alias("total"), half_up(F.avg(value), 2).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"))


def nearest_rank(ordered: np.ndarray, share: float) -> float:
    return float(ordered[max(0, int(np.ceil(len(ordered) * share)) - 1)]) if len(ordered) else 0.0


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and increments of 1 to n steps of the generator at once."""
    m, c = np.array([LCG[0]], np.uint64), np.array([LCG[1]], np.uint64)
    while len(m) < n:  # the steps so far, and after them as many again
        last_m, last_c = m[-1], c[-1]
        m, c = np.concatenate([m, (m * last_m) & MASK]), np.concatenate([c, (m * last_c + c) & MASK])
    return m[:n], c[:n]


def uniform(seed: int, n: int) -> np.ndarray:
    """The generator's next n numbers in [0, 1)."""
    m, c = _steps(n)
    return ((m * np.uint64(seed & 0xFFFFFFFF) + c) & MASK) / 2**32


def bootstrap(rows: DataFrame, statistic: str, samples: int, seed: int) -> DataFrame:
    """(group, low, high): 2.5 and 97.5 % of a statistic over resamples drawn by the generator. A group is one metric's
    values over an evaluation set; a task holds them and one resample."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("position")["value"].to_numpy(float)
        (m, c), state, s = _steps(len(v)), np.uint64(seed & 0xFFFFFFFF), np.empty(samples)
        for i in range(samples):
            states = (m * state + c) & MASK
            state = states[-1]
            drawn = v[(states / 2**32 * len(v)).astype(int)]
            s[i] = drawn.mean() if statistic == "mean" else np.sort(drawn)[max(0, int(np.ceil(len(v) * 0.95)) - 1)]
        s = np.sort(s)
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "low": [round(nearest_rank(s, 0.025), 6)], "high": [round(nearest_rank(s, 0.975), 6)]})

    return rows.groupBy("group").applyInPandas(run, "group long, low double, high double")


#: Share of searchable elements that must have a place for structures to pass.
LOCATABLE = 0.8
#: Terms of a case, and the part of a page in which each kind is looked for.
_TERMS = (("required_text", "text"), ("expected_cells", "cells"), ("visual_terms", "seen"))


def structure_report(structures: DataFrame, cases: DataFrame) -> DataFrame:
    """One row a version with cases: n_cases, classification_accuracy, text_recall, cell_recall, visual_recall,
    locatable_rate (1 where nothing is asked), and passed: all are 1, and the last one at least LOCATABLE.

    cases: (version_id, case_no, page, classification or null, required_text, expected_cells, visual_terms: arrays or
    null, boxes boolean). Terms are contained in a page's texts, in the cells of its tables, in the texts of elements that
    vision gave, without regard to case and white space. A case whose page isn't there counts as a case and asks nothing.
    """
    e = F.col("unit.elements")
    text = lambda xs: T.normalize_for_compare(F.array_join(F.transform(xs, lambda x: x["text"]), " "))
    shown = F.filter(e, lambda x: x["searchable"])
    # of a unit only what is compared travels: no Markdown, no places
    narrow = {
        "whole": S.is_page(F.col("unit")), "class": F.col("unit.classification"), "text": text(e), "seen": text(F.filter(e, lambda x: x["source"] == "vision")),
        "shown": F.size(shown), "placed": F.size(F.filter(shown, lambda x: x["bbox"].isNotNull())),
    }
    units = S.units(structures).filter("unit.location.type = 'page'").select("version_id", F.col("unit.location.page").alias("page"), "unit_no", F.struct(*(v.alias(k) for k, v in narrow.items())).alias("own"))
    page = units.groupBy("version_id", "page").agg(F.min_by("own", "unit_no").alias("own")).filter("own.whole").select("version_id", "page", "own.*")
    cells = F.array_join(F.flatten("table.rows"), " ")
    wanted = cases.select("version_id", "page").distinct()
    tables = S.tables(structures).filter("table.location.type = 'page'").select("version_id", F.col("table.location.page").alias("page"), "table_no", cells.alias("cells")).join(wanted, ["version_id", "page"], "left_semi")
    joined = tables.groupBy("version_id", "page").agg(F.sort_array(F.collect_list(F.struct("table_no", "cells"))).alias("all"))
    joined = joined.select("version_id", "page", T.normalize_for_compare(F.array_join(F.transform("all", lambda x: x["cells"]), " ")).alias("cells"))
    rows = cases.join(page, ["version_id", "page"], "left").join(joined, ["version_id", "page"], "left").withColumn("cells", F.coalesce("cells", F.lit("")))
    here = F.col("text").isNotNull()

    def counts(column: str, where: str) -> list[Column]:
        asked = F.coalesce(F.col(column), F.array().cast("array<string>"))
        met = F.filter(asked, lambda x: F.contains(F.col(where), T.normalize_for_compare(x)))
        return [F.sum(F.when(here, F.size(met)).otherwise(0)).alias(f"{column}_met"), F.sum(F.when(here, F.size(asked)).otherwise(0)).alias(f"{column}_asked")]

    typed = here & F.col("classification").isNotNull()
    boxed = here & F.col("boxes")
    number = lambda c, v: F.sum(F.when(c, v).otherwise(0))
    sums = rows.groupBy("version_id").agg(
        F.count("*").alias("n_cases"), number(typed & (F.col("class") == F.col("classification")), 1).alias("typed_met"), number(typed, 1).alias("typed_asked"),
        *(c for pair in _TERMS for c in counts(*pair)), number(boxed, F.col("placed")).alias("boxes_met"), number(boxed, F.col("shown")).alias("boxes_asked"),
    )
    share = lambda name: ratio(F.col(f"{name}_met"), F.col(f"{name}_asked"), 1.0)
    out = sums.select("version_id", "n_cases", share("typed").alias("classification_accuracy"), share("required_text").alias("text_recall"), share("expected_cells").alias("cell_recall"), share("visual_terms").alias("visual_recall"), share("boxes").alias("locatable_rate"))
    whole = [F.col(c) == 1 for c in ("classification_accuracy", "text_recall", "cell_recall", "visual_recall")]
    return out.withColumn("passed", whole[0] & whole[1] & whole[2] & whole[3] & (F.col("locatable_rate") >= LOCATABLE))
