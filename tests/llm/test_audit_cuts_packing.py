"""Filter audit, fill-in-middle and packing against brute-force versions, on odd rows, hot groups and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import fill_middle, filter_audit, packing
from tests.llm.test_llm import DOCS, empty, library_ids, odd, rows_of  # noqa: F401  fixtures

# 11: filter audit


def audit_brute(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    seen, got = defaultdict(list), Counter()
    for i, t, _ in rows:
        if i is not None:
            seen[t or ""].append(i)
    docs = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j < i for j in seen[t]),
        }
        own = [y for y in labels if y[0] is not None and y[0] == i]
        docs.append((part or "", {x for x in bad if bad[x]}, any(y[1] == 1 for y in own), any(y[2] == 1 for y in own)))
    shapley = Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            for step in range(1, 6):
                row = Counter()
                for p, bad, good, toxic in docs:
                    if p != part:
                        continue
                    first = next((k for k, x in enumerate(order, 1) if x in bad), 6)
                    row["kept"] += first > step
                    row["removed"] += first == step
                    row["redundant"] += order[step - 1] in bad and first < step
                    row["unique"] += bad == {order[step - 1]}
                    row["good"] += first == step and good
                    row["toxic"] += first == step and toxic
                shapley[part, order[step - 1]] += row["removed"]
                got[part, "".join(order), step] = tuple(row[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic"))
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in got.items()}


def audit_case(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["X" * 9, "a#b", "É", "日本"]
    texts = [None, "", "A", " \t\n", "x" * 3000, "AB " * 300, *(" ".join(rng.choices(words[: rng.choice([3, 300, 404])], k=rng.choice([5, 199, 200, 201, 400]))) for _ in range(25))]
    rows = [(i, rng.choice(texts), rng.choice([None, "", "s", "t"])) for i in range(90)]
    rows += [(None, rows[3][1], "s"), (None, rows[3][1], "s"), (5, rows[5][1], "s"), (5, rows[5][1], "t"), (6, "other", "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(60), *range(10), None, 999]]
    return rows, labels


@pytest.mark.parametrize("hot", [2000, 20])
def test_audit_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(filter_audit, "HOT", hot)
    rows, labels = audit_case(hot)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, source string, flags int, part string, step int")
    named = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, good string")
    got = filter_audit.audit(spark, docs, named)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) == 3 * 600 and set(got) == audit_brute(rows, labels)


def test_audit_of_an_empty_table_and_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark, docs.limit(0), labels).count() == 0
    got = filter_audit.audit(spark, docs, labels).collect()
    assert len(got) == 600 and {r.good_lost + r.toxic_lost for r in got} == {0} and sum(r.removed for r in got) == 120


def test_replay_takes_other_filters(spark):
    rows = spark.createDataFrame([("p", 3, True, False), ("p", 0, False, False), ("p", 2, False, True)], "part string, flags int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.replay(spark, rows, "XY").collect()}
    assert got == {("XY", 1): (2, 1, 0, 0, 1, 0, 1), ("XY", 2): (1, 1, 1, 1, 0, 1, 3), ("YX", 1): (1, 2, 0, 1, 1, 1, 3), ("YX", 2): (1, 0, 1, 0, 0, 0, 1)}
    with pytest.raises(ValueError):
        filter_audit.replay(spark, rows, "ABCDEFG")


# 12: fill in the middle


def cut_brute(i, text):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, sha(t), sha(t)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return i, n, form, len(p), len(m), sha(out), sha(t)


@pytest.mark.parametrize("hot", [2000, 3])
def test_cuts_against_brute_force(spark, odd, monkeypatch, hot):  # noqa: F811
    monkeypatch.setattr(fill_middle, "HOT", hot)
    rng = random.Random(hot)
    pieces = ["word", "Z", " ", "\n", "é", "日本", "𝄞", "<P", "<S>", "P>", "<", "12", "S>"]
    extra = [(1000 + i, "".join(rng.choices(pieces, k=rng.randint(0, 40)))) for i in range(150)]
    extra += [(2000 + i, extra[0][1] + "many copies") for i in range(300)] + [(3000 + i, "a<P>b") for i in range(5)]
    rows = rows_of(odd) + extra
    docs = spark.createDataFrame([(i, t, 1, "c", 5) for i, t in rows], "doc_id long, text string, n int, cuts string, key int")
    got = Counter(map(tuple, fill_middle.digests(spark, docs).collect()))
    assert got == Counter(cut_brute(i, t) for i, t in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_cuts_of_an_empty_table_and_other_rates(spark, odd, empty):  # noqa: F811
    assert fill_middle.digests(spark, empty).count() == 0
    got = fill_middle.transform(spark, odd, seed=7, rate=100, spm_rate=100).collect()
    assert {r.form for r in got if r.n} == {"spm"}
    texts = Counter(t or "" for _, t in rows_of(odd))
    back = lambda out: (lambda x: x[2] + x[3] + x[1])(re.split("<[PSM]>", out)) if out else out
    assert Counter(back(r.output) for r in got) == texts


def test_texts_move_once(spark, odd):  # noqa: F811
    out = fill_middle.digests(spark, odd)
    out.write.format("noop").mode("overwrite").save()
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1


@pytest.mark.parametrize("values", [[0], [7], [0, 0, 0], [0, 1, 2, 3], [0, 50_000], [5, 5, 9, 100_000, 100_000], list(range(0, 30_000, 3)), [0, *range(1_000_000, 1_003_000)]])
def test_lists_give_back_their_numbers(values):
    data = fill_middle.elias_fano(np.array(values))
    assert [fill_middle.select(data, i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        fill_middle.select(data, len(values))


def test_boundaries_of_slices():
    texts = pa.array(["ab", "", "1b", "é日x y"])
    assert [x.tolist() for x in fill_middle.boundaries(texts.slice(1))] == [[0], [0, 1, 2], [0, 1, 2, 3, 4, 5]]


# 13: packing


def packed_brute(lengths, size):
    """Best-fit decreasing by looking at every sequence."""
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i in range(len(room)) if room[i] >= x]
        if fits:
            i = min(fits, key=room.__getitem__)
        else:
            room.append(size)
            i = len(room) - 1
        room[i] -= x
    return sorted(room)


@pytest.mark.parametrize("size", [1, 2, 3, 10, 64, 100, 4096])
def test_best_fit_equals_the_plain_search(size):
    rng = np.random.default_rng(size)
    for n in (0, 1, 5, 200):
        lengths = rng.integers(1, size + 1, n)
        _, _, filled = packing.best_fit(lengths, size)
        assert sorted(size - filled) == packed_brute(lengths.tolist(), size)
    for bad in (0, size + 1):
        with pytest.raises(ValueError):
            packing.BestFit(size).place(bad)


def places_are_gapless(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_equals_the_library_and_loses_nothing(spark, odd, empty):  # noqa: F811
    got = packing.packed(spark, odd).collect()
    want = Counter()
    for (i, _), ids in zip(rows_of(odd), library_ids([t or "" for _, t in rows_of(odd)]), strict=True):
        for start in range(0, len(ids), packing.SIZE):
            own = ids[start : start + packing.SIZE]
            want[(i, start // packing.SIZE, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert places_are_gapless(got, packing.SIZE) == len(packed_brute([r.length for r in got], packing.SIZE))
    assert packing.packed(spark, empty).count() == 0


def test_rounds_cost_few_sequences(spark):
    rng = random.Random(1)
    lengths = [rng.randint(1, 300) if rng.random() < 0.7 else rng.randint(300, 1000) for _ in range(4000)]
    rows = spark.createDataFrame([(i % 7 if i % 3 else None, i, x) for i, x in enumerate(lengths)], "doc_id long, piece int, length long")
    got = packing.pack(spark, rows, size=1000, group=200, tail=4).collect()
    assert sorted(r.piece for r in got) == list(range(4000))
    assert places_are_gapless(got, 1000) <= len(packed_brute(lengths, 1000)) * 1.01 + 1


def test_sequences_hold_the_tokens(spark, odd):  # noqa: F811
    got = packing.sequences(spark, odd).collect()
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in got]
    assert all(len(x) == r.n_tokens <= packing.SIZE for x, r in zip(ids, got, strict=True))
    want = library_ids([t or "" for _, t in rows_of(odd)])
    assert Counter(itertools.chain(*ids)) == Counter(itertools.chain(*want))
