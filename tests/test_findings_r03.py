"""Cases of the third round's findings."""

from __future__ import annotations

import json
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import ngram_join
from quern.operators import chunking, evaluation, layout, planning, retrieval, vectors
from quern.operators.parts import parts
from quern.plans import pages, requests, tools
from quern.sources import structure
from quern.streaming import gates
from tests.oracle import compare


def test_an_acronym_may_end_at_a_letter_that_is_not_ascii(spark):
    df = spark.createDataFrame([(1, "SSö tzßzu"), (2, "aSS tz"), (3, "öAB-12ä x"), (4, "ABö1")], "id int, query string")
    got = {r.id: r.intent for r in planning.plan(df, 200, 8, "answer").collect()}
    assert got == {1: "exact", 2: "fact", 3: "exact", 4: "exact"}


def test_structure_report_of_letters_without_a_capital(spark, tmp_path):
    lines = ["Einßst.", *"abcdefghi", "Einßst.", "x"]
    pq.write_table(pa.table({"doc_id": pa.array([2, 6], pa.int64()), "text": ["\n".join(lines)] * 2}), tmp_path / "documents.parquet")
    compare(spark, requests.structure_report, requests.ORACLE["structure_report"], str(tmp_path))


class Handle:
    """A handle of state that counts its calls."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def registerTimer(self, at):
        self.timers.append(at)

    def getMapState(self, name, key, value=None):
        return State(self)

    getValueState = getMapState


class State:
    def __init__(self, handle):
        self.handle, self.rows = handle, {}

    def _row(self, key=()):
        self.handle.calls += 1
        return self.rows.get(key)

    def exists(self):
        return self._row() is not None

    def get(self):
        return self._row()

    def update(self, value):
        self.updateValue((), value)

    def clear(self):
        self.rows.clear()

    def containsKey(self, key):
        return self._row(key) is not None

    def getValue(self, key):
        return self._row(key)

    def updateValue(self, key, value):
        self.handle.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.handle.calls += 1
        del self.rows[key]

    def iterator(self):
        return iter(list(self.rows.items()))


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


@pytest.mark.parametrize("quota", [True, False])
def test_calls_of_state_and_timers_are_few(quota):
    n, handle = 3000, Handle()
    gate = gates._Quota(3_600_000) if quota else gates._Breaker(3, 300_000, 1, 2, 90_000)
    gate.init(handle)
    ids = range(n)
    rows = pd.DataFrame({"gate": "g", "id": ids, "ts": pd.Timestamp(0), "at": [i * 10_000 for i in ids], "kind": ["reserve" if quota else "acquire" for _ in ids]})
    entry = '[{"kind":"token","key":"tokens","limit":1000000}]'
    rows = rows.assign(shape=entry, amounts="3", entries=[[{"kind": "token", "key": "tokens", "amount": 3, "limit": 1000000}]] * n, reservation=None, tokens=3) if quota else rows.assign(permit=None)
    out = pd.concat(list(gate.handleInputRows(("g",), iter([rows[:1000], rows[1000:]]), None)))
    assert list(out["id"]) == list(ids)
    assert len(handle.timers) == 1 and handle.calls < 100
    # one timer drops all that is over, and wakes again for the rest
    held = gate.held if quota else gate.permits
    list(gate.handleExpiredTimer(("g",), Now(20_000_000), None))
    rest = [r for _, (text,) in held.state.iterator() for r in json.loads(text)]
    ends = 3_600_000 if quota else 180_000
    assert sorted(r[0] for r in rest) == [i for i in ids if i * 10_000 + ends > 20_000_000]
    assert len(handle.timers) == 2 and handle.timers[1] == min(r[-1] for r in rest)


def test_a_scan_of_vectors_holds_one_bounded_product(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(4000, 8)), 1)
    x[100:140], x[7] = x[99], 0
    ids = np.arange(4000)
    peak = []
    scan = vectors.scan(spark.createDataFrame([], "chunk_id long, embedding array<double>"), ids[:3000], x[:3000], 5)
    assert scan.count() == 0
    tracemalloc.start()
    got = vectors.best(ids[:3000], x[:3000], ids, x, 5, True)
    peak.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert peak[0] < 6 * 8 * vectors.CELLS  # all at once are 12 million numbers, several times over
    n = np.linalg.norm(x, axis=1)
    scale = np.outer(n[:3000], n)
    s = np.round(np.where(scale > 0, x[:3000] @ x.T / np.where(scale > 0, scale, 1), 0), 6)
    s[ids[:3000], ids[:3000]] = -9
    want = [(q, c) for q in range(3000) for c in np.lexsort((ids, -s[q]))[:5]]
    top = vectors.fewest(got, 5)
    assert list(zip(top["qid"].to_pylist(), top["chunk_id"].to_pylist(), strict=True)) == want
    chunks = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "chunk_id long, embedding array<double>")
    near = retrieval.nearest(chunks, chunks.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("query_vector")), 5)
    assert sorted((r.qid, r.chunk_id) for r in near.collect()) == sorted((q, c) for q, c in want if q % 20 == 0) + sorted((q, int(c)) for q in range(3000, 4000, 20) for c in _nearest(q, x, n, ids))


def _nearest(q, x, n, ids):
    scale = n * n[q]
    s = np.round(np.where(scale > 0, x @ x[q] / np.where(scale > 0, scale, 1), 0), 6)
    s[q] = -9
    return np.lexsort((ids, -s))[:5]


def test_a_bootstrap_holds_one_resample():
    v = np.random.default_rng(3).normal(size=20_000)
    pdf = pd.DataFrame({"group": 1, "position": range(len(v)), "value": v})
    rows = type("Rows", (), {"groupBy": lambda self, _: self, "applyInPandas": lambda self, run, _: run})()
    tracemalloc.start()
    for statistic in ("mean", "p95"):
        got = evaluation.bootstrap(rows, statistic, 50, 42)(pdf)
    assert tracemalloc.get_traced_memory()[1] < 5_000_000  # all resamples at once are a million numbers, several times
    tracemalloc.stop()
    state, at = 42, []
    for _ in range(50 * len(v)):
        state = (state * evaluation.LCG[0] + evaluation.LCG[1]) % 2**32
        at.append(int(state / 2**32 * len(v)))
    drawn = np.sort(v[np.array(at).reshape(50, -1)], axis=1)[:, 18_999]
    assert got.values.tolist() == [[1, round(np.sort(drawn)[1], 6), round(np.sort(drawn)[48], 6)]]


def test_parts_follow_rows(spark, monkeypatch):
    rows = spark.range(1000)
    assert parts(rows, 100) == 10 and parts(rows, 1000) == 4
    monkeypatch.setattr(layout, "CELLS", 10)
    cells = spark.createDataFrame([(s, r, c) for s in range(9) for r in (1, 2, 4) for c in (1, 3)] * 2, "sheet int, r int, c int")
    got = layout.regions(cells)
    assert sorted(map(tuple, got.collect())) == [(s, *x) for s in range(9) for x in ((1, 2, 1, 1, 2), (1, 2, 3, 3, 2), (4, 4, 1, 1, 1), (4, 4, 3, 3, 1))]


def test_keyword_recall_shuffles_no_scores_of_all_pairs(spark):
    texts = spark.createDataFrame([(i, f"a b{i % 7} c") for i in range(50)], "chunk_id long, content string")
    found = retrieval.bm25(texts, spark.createDataFrame([(1, "a c"), (2, "b3 a")], "qid long, query string"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning(qid" in x and "chunk_id" in x]
    assert sorted((r.qid, r.chunk_id) for r in found.collect()) == [(1, 0), (1, 1), (1, 2), (2, 3), (2, 10), (2, 17)]


def test_families_that_meet_in_the_last_round_need_one_link(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*words[: i * 9], f"x{i}", *words[i * 9 + 1 :], *["y"] * (i % 2)]) for i in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    checked, verified, across = [], ngram_join._verified, ngram_join._across

    def counted(spark, pairs, *args):
        checked.append(pairs.count())
        return verified(spark, pairs, *args)

    def stars(live, *_):
        own = live.select("node", "n").distinct()
        return own.join(own.groupBy("n").agg(F.min("node").alias("a")), "n").filter("a <> node").select("a", F.col("node").alias("b"))

    def late(spark, mixed, nodes, percent, most):
        if most is None:
            return across(spark, mixed, nodes, percent, most)
        return mixed.select(F.col("sig").alias("a"), F.col("sig").alias("b"), *(F.lit(x).cast("long").alias(c) for c, x in (("ca", 0), ("cb", 0), ("d", -1)))).distinct()

    # two families by size, which the second round leaves apart
    monkeypatch.setattr(ngram_join, "_hub_pairs", stars)
    monkeypatch.setattr(ngram_join, "_across", late)
    monkeypatch.setattr(ngram_join, "_verified", counted)
    got = ngram_join.report(spark, docs, 3, 90).collect()
    assert {r.component_id for r in got} == {0}
    assert sum(checked) == 23  # 22 in the families; all across are 144


def test_components_go_over_few_links(spark, monkeypatch):
    seen, write = [], ngram_join.materialize

    def counted(spark, df, name):
        out = write(spark, df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    chain, star = [(i, i + 1) for i in range(60)], [(100, i) for i in range(101, 160)] + [(200, 199), (199, 100)]
    got = ngram_join.components(spark, spark.createDataFrame(chain + star + chain[:5], "a long, b long"))
    assert dict(map(tuple, got.collect())) == {**dict.fromkeys(range(61), 0), **dict.fromkeys([*range(100, 160), 199, 200], 100)}
    n = len(chain) + len(star)
    assert sum(k for name, k in seen if name == "edges") <= 2 * n
    links = spark.createDataFrame([(100, 60), (300, 301), (160, 160)], "a long, b long")
    more = dict(map(tuple, ngram_join.components(spark, links, got).collect()))
    assert more == {**dict.fromkeys([*range(61), *range(100, 160), 199, 200], 0), 300: 300, 301: 300, 160: 160}


def test_structures_are_parsed_once_for_their_problems(spark, tmp_path):
    lines = "\n".join("abcdefg")
    pq.write_table(pa.table({"doc_id": pa.array([1, 3, 5, 7], pa.int64()), "text": [lines, None, lines, ""]}), tmp_path / "documents.parquet")
    found = tools.structure_problems(spark, str(tmp_path))
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()  # the filter holds no parsing
    assert {tuple(r) for r in found.collect()} == {("5", "malformed"), ("7", "checksum")}


def test_structures_are_written_and_upgraded_without_json_of_places(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array([1, 3], pa.int64()), "text": ["a\nb", "c"]}), tmp_path / "documents.parquet")
    files = tools._files(spark, str(tmp_path))
    assert files._jdf.queryExecution().optimizedPlan().toString().count("StructField(version,") == 1
    files = spark.createDataFrame(files.collect(), "version_id string, content string, sha256 string")
    rows = structure.read(files)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert {(r.version_id, r.unit.location.type, r.unit.location.page) for r in structure.units(rows).collect()} == {("1", "page", 1), ("3", "page", 1)}


def test_chunks_are_given_on_before_a_batch_is_through():
    rows = type("Rows", (), {"select": lambda self, *_: self, "__getitem__": lambda self, _: Plain(), "mapInArrow": lambda self, run, _: run, "mapInPandas": lambda self, run, _: run})()
    text = "# Head\n" + "word " * 2000
    ids, texts = list(range(300)), [text] * 300
    got = list(chunking.chunk_documents(rows)(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["document_id", "markdown"])])))
    assert max(b.num_rows for b in got) <= 2000 and len(got) > 1
    want = [(d, *c) for d, t in zip(ids, texts, strict=True) for c in chunking.chunk(str(d), t, [chunking.Anchor("heading", 0, len(t), "Head")])]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want


class Plain:
    def cast(self, _):
        return self

    alias = cast


def test_a_pair_of_nodes_is_made_in_one_bucket():
    rng = np.random.default_rng(7)
    few, k = 25, ngram_join.FIRSTS

    def cells(own, most):
        """What the cells give, when node x is in the buckets own[x], all maps alike."""
        for sig in sorted(set().union(*own)):
            rows = [(sig, -1, 0, 0, 0, 0, x, 50, x, bytes(64), *(sorted(s)[min(i, len(s) - 1)] for i in range(k))) for x, s in enumerate(own) if sig in s]
            for columns in ngram_join._cell_pairs(rows, 90, most) if len(rows) > 1 else ():
                yield from zip(*(c.tolist() for c in columns), strict=True)

    family = [set(range(-10, 10))] * few
    assert len([*cells(family, None)]) == few * (few - 1) // 2  # 20 times as many before
    assert len([*cells(family, 8)]) <= 8 * few + 1
    odd = [set(rng.choice(40, 12, replace=False).tolist()) for _ in range(few)]
    pairs = {(x, y) for x in range(few) for y in range(x) if odd[x] & odd[y]}
    assert {(max(p[:2]), min(p[:2])) for p in cells(odd, None)} == pairs
    got = [*cells(odd, 3)]
    named, cut = {(max(p[2:4]), min(p[2:4])) for p in got if p[4] >= 0}, {p[0] for p in got if p[4] < 0}
    assert all((x, y) in named or odd[x] & odd[y] & cut for x, y in pairs)


def test_texts_of_search_pages_are_not_shuffled_to_their_vectors(spark, monkeypatch):
    sf, mode = "/root/testdata/sf0.001", spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    whole = sorted(map(tuple, pages.search_page(spark, sf).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 3)  # nothing is broadcast by count
    assert sorted(map(tuple, pages.search_page(spark, sf).collect())) == whole
    monkeypatch.undo()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        said = pages.search_fusion(spark, sf)._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sent = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)\nArguments: hashpartitioning\((.*)", said)
    assert sent and not [x for x in sent if re.search(r"\b(text|content)#", x[0]) and re.match(r"\w+_id#", x[1])]
