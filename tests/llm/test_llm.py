"""The training-data operators against brute-force versions, round trips and held-out labels, with odd inputs."""

from __future__ import annotations

import base64
import hashlib
import random
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, chat, decontaminate, exact_dedup, license_scan, line_dedup, ngram_join, quality, queries, rans, toxicity
from tests.oracle import DATA, compare

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, mark string, n int, h string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names operators may use themselves."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "One line"), (5, "one LINE "), (5, "one LINE "), (None, "nobody's text"), (None, None), (6, "x" * 50_000), (7, "two\n\nlines \n"), (8, "İstanbul ß ΣΑΣ 日本語 é\x1c\x85 end"), (9, "a b"), (10, "A  B"), (11, "a")]
    base = [rng.choice(words) for _ in range(400)]
    for i in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 14)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((100 + i, " ".join(own)))
    passage = " ".join(rng.choice(words) for _ in range(60))
    for i in range(60):
        rows.append((200 + i, " ".join([*(f"u{rng.random()}" for _ in range(rng.randint(40, 160))), passage])))
    rows += [(300 + i, rows[20][1]) for i in range(12)]
    rows.append((400, "long " + " ".join(rng.choice(words) for _ in range(30_000))))
    return spark.createDataFrame([(i, t, "en", "m", 7, "h") for i, t in rows], DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name])


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# 1, 3: classifiers


def held_out_accuracy(scored, labels, folds, held, label):
    y = {r.doc_id: r[label] for r in labels.collect()}
    got = [(r.score, r.predicted, r.held_out, y[r.doc_id]) for r in scored.collect() if r.doc_id in y]
    assert all(0 <= s <= 1 and p == int(s >= 0.5) for s, p, _, _ in got)
    out = [(p, t) for _, p, h, t in got if h]
    assert out
    return np.mean([p == t for p, t in out])


def test_quality_and_toxicity_on_held_out_rows(spark):
    data = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert held_out_accuracy(queries.op1_quality(spark, data), labels, 3, 1, "quality") > 0.95
    assert held_out_accuracy(queries.op3_toxicity(spark, data), labels, 5, 0, "toxic") > 0.93


def test_folds_follow_the_crc(spark):
    got = queries.op3_toxicity(spark, DATA).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


@pytest.mark.parametrize("op", [quality, toxicity])
def test_classifiers_take_odd_rows(spark, odd, empty, op):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (6, 0, 1), (None, 1, 1), (9, None, None), (7, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    assert op.scores(odd, labels).count() == odd.count()
    assert op.scores(empty, labels).count() == 0
    assert {r.score for r in op.scores(odd, labels.limit(0)).collect()} <= {0.0, 0.5}


def test_toxicity_stage_keeps_columns_and_clean_rows(spark, odd):
    labels = spark.createDataFrame([(6, 1, 1)], "doc_id long, quality int, toxic int")
    kept = toxicity.keep(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_non_negative_risk_separates():
    rng = random.Random(2)
    text = lambda bad: " ".join(rng.choice(["idiot", "moron"]) if bad and rng.random() < 0.1 else f"w{rng.randrange(500)}" for _ in range(80))
    pos, unl = [text(True) for _ in range(60)], [text(i % 10 == 0) for i in range(400)]
    pos, unl = [[toxicity.document_features(t) for t in ts] for ts in (pos, unl)]
    names = toxicity.candidates(pos)
    m = toxicity.fit(names, *([toxicity.among(r, names) for r in rows] for rows in (pos, unl)), 0.1)
    assert m.score(text(True)) > 0.5 > m.score(text(False)) and m.score("") < 0.5


# 2: rANS


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 600_000])
def test_rans_round_trip_and_checkpoints(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49408).astype(np.uint16)
    table = rans.Table.from_counts(np.bincount(ids, minlength=49408))
    block = rans.encode_block(ids, table)
    assert (rans.decode_block(block, table) == ids).all()
    parts = [rans.decode_block(block, table, part=i) for i in range(-(-n // (rans.EVERY * rans.LANES)))]
    assert not n or (np.concatenate(parts) == ids).all()


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint16)
    table = rans.Table.from_counts(np.bincount(ids))
    block = bytearray(rans.encode_block(ids, table))
    block[-5] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(block), table)


def test_a_stretch_needs_no_other():
    ids = (np.random.default_rng(4).zipf(1.3, 300_000) % 49408).astype(np.uint16)
    table = rans.Table.from_counts(np.bincount(ids, minlength=49408))
    block = bytearray(rans.encode_block(ids, table))
    block[-1000:] = bytes(1000)  # the last stretch's words
    size = rans.EVERY * rans.LANES
    for i in range(300_000 // size):
        assert (rans.decode_block(bytes(block), table, part=i) == ids[i * size : (i + 1) * size]).all()
    for part in (None, 300_000 // size):
        with pytest.raises(ValueError):
            rans.decode_block(bytes(block), table, part=part)
    other = rans.Table.from_counts(np.bincount(ids[:1000], minlength=49408))
    with pytest.raises(ValueError):
        rans.decode_block(rans.encode_block(ids, table), other)


def test_files_hold_all_that_decoding_needs(spark, odd, tmp_path):
    rans.write_files(spark, odd, str(tmp_path))
    files, table, bases = rans.open_files(spark.newSession(), str(tmp_path))
    got = sorted((bases[r.part] + r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rans.decode_documents(files, table).collect())
    want = library_ids([t or "" for _, t in rows_of(odd)])
    assert Counter(map(tuple, want)) == Counter(tuple(x) for _, x in got)
    assert [at for at, _ in got] == np.cumsum([0, *(len(x) for _, x in got)])[:-1].tolist()


@pytest.mark.parametrize("cut", [1, 7, 300])
def test_word_encoder_equals_the_library(cut):
    rng = random.Random(cut)
    pieces = ["the", "Cat", "don't", "x.", "a,b", "É", "ñandú.", "×", "÷.", "µm", "ª", "...", "?!", ".", "12", "3.4", "ß", "İ", "\xa0", "\t", "\x1c", "\x85", "日本", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "ſ", "Ǆ", "_a_", "naïve;", "x:y:"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", "  ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    e = rans.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for i in range(0, len(texts), cut):
        assert [[*np.frombuffer(x, "<u2"), 1] for x in e.encode(texts[i : i + cut])] == library_ids(texts[i : i + cut])


def test_special_strings_encode_as_the_library_does():
    rng = random.Random(9)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "x", "the cat", "é", "日", "."]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(1, 6))) for _ in range(10_000)]
    e = rans.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert [[*np.frombuffer(x, "<u2"), 1] for x in e.encode(texts)] == library_ids(texts)
    assert np.frombuffer(e.encode(["x <|endoftext|> y"])[0], "<u2").tolist() == [343, 49407, 344]


def test_frequencies_fill_the_table():
    counts = np.zeros(49408, np.int64)
    counts[:40000] = 1
    counts[7] = 10**12
    t = rans.Table.from_counts(counts)
    assert int(t.freq.sum()) == 1 << rans.SCALE and t.freq[:40000].min() >= 1


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_rans_query_equals_the_library(spark, odd, empty):
    rows = sorted(((i, t or "") for i, t in rows_of(odd)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    ids = library_ids([t for _, t in rows])
    at, want = 0, Counter()
    for (i, _), x in zip(rows, ids, strict=True):
        want[(i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))] += 1
        at += len(x)
    assert Counter(map(tuple, rans.digests(spark, odd).collect())) == want
    assert rans.digests(spark, empty).count() == 0
    files, table, _ = rans.write(spark, odd)
    assert Counter(zlib.crc32(r.ids) for r in rans.decode_documents(files, table).collect()) == Counter(c for (_, _, _, c), n in want.items() for _ in range(n))


def test_word_encoder_forgets_and_stays_right():
    e = rans.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), cache_bytes=5)
    texts = ["the cat sat.", "don't x's!", "A <|endoftext|> b", "ok ok, ok.", "é ñandú, 12 3.4"]
    for _ in range(3):
        assert [[*np.frombuffer(x, "<u2"), 1] for x in e.encode(texts)] == library_ids(texts)


# 4: lines


def line_brute(rows, min_docs):
    key = lambda s: s.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    seen = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    hot = {k for k, d in seen.items() if k and len(d) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize(("min_docs", "hot_keys"), [(2, 4000), (10, 4000), (2, 1)])
def test_lines_against_brute_force(spark, odd, monkeypatch, min_docs, hot_keys):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", hot_keys)
    monkeypatch.setattr(line_dedup, "SKETCH_ITEMS", max(1, hot_keys * 2))
    rng = random.Random(1)
    extra = [(500 + i, "\n".join(rng.choice(["Foo", " foo", "bar ", "BAZ", "", f"own{i}"]) for _ in range(150))) for i in range(15)]
    rows = rows_of(odd) + extra
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, line_dedup.apply(spark, df, min_docs).collect())) == line_brute(rows, min_docs)


def test_lines_of_a_very_long_text(spark):
    long = "\n".join(["same"] * 50_000 + [f"line {i}" for i in range(50_000)])
    df = spark.createDataFrame([(1, long), (2, "same\nother")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, len(r.text)) for r in line_dedup.apply(spark, df, 2).collect()}
    assert got == {1: (100_000, 50_000, len(long) - 5 * 50_000), 2: (2, 1, 5)}
    plan = line_dedup._lines(df, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("xxhash64(coalesce(text")


def test_first_lines_stay(spark):
    df = spark.createDataFrame([(1, "a\nb\na"), (2, "B\nc"), (2, "B\nc"), (3, "c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in line_dedup.apply(spark, df, None).collect())
    assert got == [(1, "a\nb"), (2, "c"), (2, "c"), (3, "")]


def test_lines_of_an_empty_table(spark, empty):
    assert line_dedup.digests(spark, empty).count() == 0


# 5: chats


def test_snapshots_collapse(spark):
    turns = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "x"), (4, 1, None, None), (5, 0, "user", "x"), (5, 1, "", ""), (None, 0, "user", "z")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, n int")
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 4, 5, None} and got[2][:2] == (2, 2) and got[2][2] == "<|user|>\na\n<|assistant|>\nb\n<|end|>"
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chats_against_brute_force(spark):
    rng = random.Random(4)
    convs = {i: [(rng.choice("ua"), rng.choice("xy")) for _ in range(rng.randint(1, 5))] for i in range(120)}
    df = spark.createDataFrame([(i, k, r, t) for i, c in convs.items() for k, (r, t) in enumerate(c)], "conv_id long, turn long, role string, text string")
    whole = {tuple(c) for c in convs.values()}
    top = {c for c in whole if not any(len(o) > len(c) and o[: len(c)] == c for o in whole)}
    assert {(r.conv_id, r.n_copies) for r in chat.maximal(df).collect()} == {(min(i for i, c in convs.items() if tuple(c) == t), sum(tuple(c) == t for c in convs.values())) for t in top}


def chats_brute(rows):
    """conv_id -> (n_turns, n_copies, rendered) of the maximal ones."""
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:2]) + tuple((x is not None, x or "") for x in r[2:])
    convs = defaultdict(list)
    for r in sorted(rows, key=key):
        convs[r[0]].append(r[2:])
    kinds = defaultdict(list)
    for i, c in convs.items():
        kinds[tuple(c)].append(i)
    out = {}
    for c, ids in kinds.items():
        if not any(len(o) > len(c) and o[: len(c)] == c for o in kinds):
            text = "".join(f"<|{r or ''}|>\n{t or ''}\n" for r, t in c) + "<|end|>"
            out[min(ids, key=lambda i: (i is None, i or 0))] = (len(c), len(ids), text)
    return out


@pytest.mark.parametrize("rows", [500_000, 0])
def test_odd_chats_against_brute_force(spark, rows, monkeypatch):
    """Ties in turn and role that texts decide, repeated rows, nulls, long texts, many turns, names that clash."""
    monkeypatch.setattr(chat, "small", lambda df: df if not rows else F.broadcast(df))
    rng = random.Random(9)
    turns = [(i, rng.choice([None, 0, 1]), rng.choice([None, "", "u"]), rng.choice([None, "", "x", "y"])) for i in range(80) for _ in range(rng.randint(1, 4))]
    turns += [(200 + i, *t) for i in range(3) for t in [(0, "u", "b"), (0, "u", "a"), (1, "a", "c")][: i + 1] * (i + 1)]
    turns += [(300, 0, "u", "long " * 60_000), (301, 0, "u", "long " * 60_000), (301, 1, "a", "z" * 200_000), (None, 0, "u", "a"), (None, 1, "a", "b"), (302, 0, "u", "a"), (302, 1, "a", "b"), (0, 5, "u", "zero")]
    turns += [(400 + i, k, "u", str(k % 7)) for i in range(2) for k in range(900 + i)]
    df = spark.createDataFrame([(*t, "k", True, "d") for t in turns], "conv_id long, turn long, role string, text string, conv_key string, no_conv boolean, hashes string")
    got = [tuple(r) for r in chat.format_chats(df).collect()]
    want = chats_brute(turns)
    assert len(got) == len(want) and {i: rest for i, *rest in got} == {i: list(v) for i, v in want.items()}


# 6: exact copies


def exact_brute(rows):
    groups = defaultdict(list)
    norm = lambda t: (t or "").translate({ord(c): None for c in SPACE})
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    out = Counter()
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g)[3]
        out[(i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_copies_against_brute_force(spark, odd, empty, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    monkeypatch.setattr(exact_dedup, "FAN", 2)
    assert Counter(map(tuple, exact_dedup.dedup(spark, odd).collect())) == exact_brute(rows_of(odd))
    assert exact_dedup.dedup(spark, empty).count() == 0
    kept = exact_dedup.keep(spark, odd)
    groups = Counter(h for (_, _, _, _, h), n in exact_brute(rows_of(odd)).items() for _ in range(n))
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_runs_merge_where_first_words_collide():
    rng = np.random.default_rng(8)
    x = np.zeros(3000, exact_dedup.RECORD)
    x["d"] = rng.integers(0, 3, (3000, 4))
    x["norm_len"], x["worse"], x["null"] = rng.integers(0, 2, 3000), -rng.integers(0, 3, 3000), rng.integers(0, 2, 3000)
    x["doc_id"], x["mark"], x["n"] = rng.integers(0, 50, 3000), rng.integers(0, 9, 3000), 1
    want = defaultdict(list)
    for r in x.tolist():
        want[(*r[0], r[1])].append(r[2:])
    runs = [exact_dedup.merge([x[i : i + 1]]) for i in range(100)] + [exact_dedup.merge([x[i : i + 290]]) for i in range(100, 3000, 290)]
    got = exact_dedup.merge([exact_dedup.merge(runs[:40]), exact_dedup.merge(runs[40:])])
    assert [(*r[0], r[1], *r[2:]) for r in got.tolist()] == [(*k, *min(v)[:4], len(v)) for k, v in sorted(want.items())]


# 7: licences


def test_license_rules():
    s = license_scan.Scanner()
    mit = license_scan.SENTENCES
    text = "Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, " + mit["mit-grant"].split("free of charge ")[1] + ":\n\n" + mit["mit-notice"] + ".\n\nTHE SOFTWARE IS " + mit["as-is"].split("the software is ")[1].upper() + "."
    assert s.scan(text)[:2] == ("MIT", "mit-text")
    assert s.scan("x\nReleased under the MIT License.\ny. Licensed under CC BY-NC 4.0.")[:2] == ("CC-BY-NC-4.0,MIT", "mit-released,cc-by-nc-4")
    assert s.scan("") == ("", "", 0, None) and s.scan("the licence of nothing")[0] == ""


def test_license_query_against_plain_search(spark):
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary"}
    data = DATA.replace("0.001", "0.01")
    docs = {r.doc_id: r.text.split("\n") for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r.licenses for r in queries.op7_license_scan(spark, data).collect()}
    assert got == {i: ",".join(sorted({v for k, v in lines.items() if k in ls})) for i, ls in docs.items()}


def test_license_rules_need_their_order():
    s = license_scan.Scanner({"a": "alpha one", "b": "beta two"}, (("ab", "AB", ("a", "b")), ("b", "B", ("b",))), gap=1)
    assert s.scan("alpha one. beta two.")[0] == "AB" and s.scan("beta two. alpha one.")[0] == "B" and s.scan("alpha one. x. y. z. beta two.")[0] == "B"


MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""


@pytest.mark.parametrize("text, want", [(MIT, ("MIT", "mit-text")), (BSD, ("BSD-3-Clause", "bsd-3-text")), (GPL, ("GPL-3.0-or-later", "gpl-3-header"))], ids=["mit", "bsd-3", "gpl-3"])
def test_wrapped_licenses(text, want):
    s = license_scan.Scanner()
    assert s.scan(text)[:2] == want
    # as comments with empty lines, and wrapped narrowly
    assert s.scan("\n".join(f" * {line}" for line in text.split("\n")))[:2] == want
    for width in (45, 60, 72, 100):
        assert s.scan("\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in text.split("\n\n")))[:2] == want


HOPE = """{0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the {1} for more details.

You should have received a copy of the {1} along with {2}."""
FREE = "{} is free software; you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.\n\n"
LESSER, AFFERO, GENERAL = "GNU Lesser General Public License", "GNU Affero General Public License", "GNU General Public License"
DISCLAIMER = """\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_REST = """\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
KNOWN = {
    "mit-text": ("MIT", MIT), "bsd-3-text": ("BSD-3-Clause", BSD), "bsd-3-full": ("BSD-3-Clause", BSD + DISCLAIMER), "bsd-2-full": ("BSD-2-Clause", BSD[: BSD.index("3. Neither")] + DISCLAIMER), "gpl-3-header": ("GPL-3.0-or-later", GPL),
    "gpl-2-header": ("GPL-2.0-or-later", FREE.format("This program", GENERAL, 2) + HOPE.format("This program", GENERAL, "this program")), "lgpl-21-header": ("LGPL-2.1-or-later", FREE.format("This library", LESSER, 2.1) + HOPE.format("This library", LESSER, "this library")),
    "lgpl-3-header": ("LGPL-3.0-or-later", FREE.format("This program", LESSER, 3) + HOPE.format("This program", LESSER, "this program")), "agpl-3-header": ("AGPL-3.0-or-later", FREE.format("This program", AFFERO, 3) + HOPE.format("This program", AFFERO, "this program")),
    "isc-full": ("ISC", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + ISC_REST), "0bsd-full": ("0BSD", ISC_GRANT + "." + ISC_REST),
    "mpl-2-header": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "epl-2-made": ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "unlicense-text": ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
    "cc-by-nc-sa-4-work": ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "apache-2-header": ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    https://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    "agpl-3-title": ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007"),
}


@pytest.mark.parametrize("rule", KNOWN)
def test_licenses_at_any_wrap(rule):
    s, (licence, text) = license_scan.Scanner(), KNOWN[rule]
    assert s.scan(f"some words\n\n{text}\n\nother words")[:2] == (licence, rule)
    for width in range(20, 121):
        wrapped = "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n"))
        assert s.scan(wrapped)[:2] == (licence, rule), width
        assert s.scan("\n".join(f"// {line}" for line in wrapped.split("\n")))[:2] == (licence, rule), width


def plain_license_scan(text, known, rules, gap):
    """Every stretch of pieces is compared with every sentence, every chain of sentences is tried."""
    parts = license_scan.sentences(text)
    at = {}
    for i in range(len(parts)):
        for j in range(i, len(parts)):
            words = [w for p in parts[i : j + 1] for w in license_scan.plain(p).split()]
            if license_scan.plain(parts[i]) and license_scan.plain(parts[j]) and " ".join(words) in known:
                at[i] = (i, j, known[" ".join(words)])
    found = [at[i] for i in sorted(at)]
    counted = [bool(n) and not n.replace(" ", "").isdigit() for n in map(license_scan.plain, parts)]
    for i, j, _ in found:
        counted[i + 1 : j + 1] = [False] * (j - i)

    def chains(chain, rest):
        if not rest:
            return [chain]
        end = found[chain[-1]][1] + 1
        return [c for k in range(chain[-1] + 1, len(found)) if found[k][2] == rest[0] and found[k][0] >= end and sum(counted[end : found[k][0]]) <= gap for c in chains([*chain, k], rest[1:])]

    out, taken = set(), set()
    for name, licence, ids in sorted(rules, key=lambda r: -len(r[2])):
        for start, (_, _, key) in enumerate(found):
            whole = chains([start], ids[1:]) if key == ids[0] else []
            if whole and not taken.issuperset(whole[0]):
                taken.update(whole[0])
                out.add((name, licence))
    return out


def test_licenses_equal_plain_matching():
    import random

    known = {"a": "alpha one", "ab": "alpha one and two", "b": "beta two three", "c": "gamma"}
    rules = (("abc", "ABC", ("a", "b", "c")), ("ab-c", "AB-C", ("ab", "c")), ("bc", "BC", ("b", "c")), ("a", "A", ("a",)), ("c", "C", ("c",)))
    s, back, seen = license_scan.Scanner(known, rules, 1), {v: k for k, v in known.items()}, set()
    draw = random.Random(5)
    for _ in range(4000):
        words = [w for _ in range(draw.randint(1, 7)) for w in draw.choice([*known.values(), *known.values(), "alpha", "x", "7", "beta two"]).split() + draw.choice([["."], [".\n"], ["\n"], []])]
        text = "".join(w if w in (".", ".\n", "\n") else draw.choice([" ", " ", " ", "\n", "\n# "]) + draw.choice([w, w.upper()]) for w in words)
        parts, found = s.identifiers(text)
        got = {(r, x) for _, r, x in (s.matches(parts, found) if found else [])}
        assert got == plain_license_scan(text, back, rules, 1), text
        seen |= {r for r, _ in got}
    assert seen == {r[0] for r in rules}


def test_every_license_rule_has_its_sentences():
    between = {"gpl-see", "lgpl-see", "agpl-see"}
    assert {k for _, _, ids in license_scan.RULES for k in ids} == set(license_scan.SENTENCES) - between
    assert all(license_scan.normalize(v) == v for v in license_scan.SENTENCES.values()) and len(set(license_scan.SENTENCES.values())) == len(license_scan.SENTENCES)


def test_license_gaps_count_from_the_end():
    s = license_scan.Scanner({"a": "alpha one and two", "b": "beta two"}, (("ab", "AB", ("a", "b")),), gap=1)
    assert s.scan("alpha\none\nand\ntwo.\nx\n2.\n --\nbeta two.") == ("AB", "ab", 8, 0)
    assert s.scan("alpha\none\nand\ntwo.\nx\ny\nbeta two.") == ("", "", 7, None)


def test_license_words_far_into_a_line():
    s = license_scan.Scanner()
    for before in (" " * 36, " " * 80, "*" * 45 + " ", "# " + "-" * 40 + " ", "\t" * 200 + "__"):
        assert s.scan(before + "Released under the MIT License.")[:2] == ("MIT", "mit-released"), before


def test_licenses_of_odd_rows(odd, empty):
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(empty).count() == 0


# 8: n-gram join


def shingles(t, width):
    w = (t or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def join_labels(rows, width, percent):
    """A name of its component for each row."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    return [find(k) for k in range(len(rows))]


def join_brute(rows, width=3, percent=90):
    labels, least = join_labels(rows, width, percent), {}
    for c, (i, _) in zip(labels, rows, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    sizes = [len(shingles(t, width)) for _, t in rows]
    return Counter((i, n, least.get(c) if n else i) for n, c, (i, _) in zip(sizes, labels, rows, strict=True))


@pytest.mark.parametrize(("frequent", "block", "percent", "width"), [(16, 4000, 90, 3), (2, 5, 90, 3), (4, 3, 80, 5)])
def test_join_against_brute_force(spark, odd, monkeypatch, frequent, block, percent, width):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "NEAREST", 1 if block < 5 else 8)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.report(spark, odd, width, percent).collect())
    assert got == join_brute(rows_of(odd), width, percent)


def test_join_of_few_rows(spark, empty):
    assert ngram_join.report(spark, empty).count() == 0
    kept = ngram_join.keep(spark, spark.createDataFrame([(2, "a b c d"), (1, "A b C d"), (3, ""), (4, None)], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_one_row_of_each_component_stays(spark, odd, monkeypatch, limit):
    from quern.llm import common

    monkeypatch.setattr(common.small, "__defaults__", (limit,))
    base = [f"v{i}" for i in range(200)]
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (20, 60, 100)]
    rows = [(1, near[0], 1), (1, near[1], 2), (1, near[1], 3), (None, near[2], 4), (None, "alone in this", 5), (None, "alone in this", 6), (None, "a b c", 7), (None, "A B  C", 8), (2, "", 9), (2, "", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = ngram_join.keep(spark, df)
    assert got.columns == df.columns
    kept = sorted(r.n for r in got.collect())
    assert len(kept) == 5 and len({1, 2, 3} & set(kept)) == 1 and len({5, 6} & set(kept)) == 1 and len({7, 8} & set(kept)) == 1 and {9, 10} <= set(kept)
    # components are told apart by the row that stays; documents without words all stay
    whole = Counter(rows_of(ngram_join.keep(spark, odd)))
    rows = rows_of(odd)
    assert all(whole[r] == n for r, n in Counter(rows).items() if not (r[1] or "").encode().split())
    best = {}
    for r, c in zip(rows, join_labels(rows, 5, 80), strict=True):
        if (r[1] or "").encode().split():
            best[c] = min(best.get(c, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted(k for k in ((i is None, i or 0) for i, t in whole.elements() if (t or "").encode().split())) == sorted(best.values())


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        x = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        gone = rng.integers(0, len(x) * (100 - percent) // 100 + 1)
        y = np.unique(np.concatenate((rng.permutation(x)[gone:], rng.integers(1, 1 << 62, rng.integers(0, len(x) * (100 - percent) // 100 + 2)).astype(np.uint64))))
        if not ngram_join.similar(x, y, percent):
            continue
        often = np.sort(rng.permutation(np.union1d(x, y))[: int(rng.integers(0, len(x) + 1))])
        sign = lambda v: set(ngram_join.signatures(v[: ngram_join.zone_length(len(v), percent)], len(v), often, percent).tolist())  # noqa: B023, E731
        assert sign(x) & sign(y)
        assert ngram_join.flipped(ngram_join.parity(x), ngram_join.parity(y)) <= ngram_join.allowed(len(x), len(y), percent)


# 9: benchmark overlaps


def overlap_brute(text, items):
    drop = str.maketrans({c: None for c in decontaminate._PUNCTUATION} | {c: " " for c in SPACE})
    tok = lambda s: [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (s or "").translate(drop)).split(" ") if w]
    w, out = tok(text), set()
    for i, b in items:
        b = tok(b)
        if i is None or len(b) < decontaminate.SHORTEST:
            continue
        size = min(len(b), decontaminate.WINDOW)
        least = size - decontaminate.SUBSTITUTIONS * size // decontaminate.WINDOW
        if any(sum(x == y for x, y in zip(b[s : s + size], w[p : p + size], strict=False)) >= least for s in range(len(b) - size + 1) for p in range(len(w) - size + 1)):
            out.add(i)
    return ",".join(map(str, sorted(out)))


@pytest.mark.parametrize("limit", [200_000, 0])
def test_overlaps_against_brute_force(spark, limit):
    rng = random.Random(9)
    words = ["the", "of", *(f"t{i}" for i in range(200))]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 40)))) for i in range(8)] + [(50, "Six tokens, of an item here."), (51, "too short"), (None, None)]
    rows = [(1, None), (2, ""), (None, items[0][1]), (3, items[1][1].upper()), (4, "x six TOKENS of an item here"), (4, "x six TOKENS of an item here")]
    for i in range(120):
        b = [w if rng.random() > 0.15 else rng.choice(words) for w in items[i % 8][1].split()]
        k = rng.randint(8, len(b))
        rows.append((100 + i, " ".join([*("a b c".split()[: i % 4]), *b[:k], "end"])))
    df = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, mark string")
    bench = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, w string")
    got = Counter((r.doc_id, r.item_ids) for r in decontaminate.report(spark, df, bench, limit=limit).collect())
    assert got == Counter((i, overlap_brute(t, items)) for i, t in rows)
    kept = decontaminate.keep(spark, df, bench, limit=limit)
    assert kept.columns == df.columns and kept.count() == sum(n for (_, x), n in got.items() if not x)
    assert decontaminate.report(spark, df, bench.limit(0), limit=limit).filter("contaminated").count() == 0
    assert decontaminate.report(spark, df.limit(0), bench, limit=limit).count() == 0


@pytest.mark.parametrize("limit", [200_000, 0])
def test_overlaps_in_a_very_long_text(spark, limit):
    seed = "alpha beta gamma delta epsilon"
    text = " ".join(f"{seed} n{i}" for i in range(100_000))
    item = " ".join(f"p{k} q{k} {seed}" for k in range(6))
    whole = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, text), (2, f"{text} {whole}"), (3, " ".join(["x"] * (256 - 5) + [whole] + ["y"] * 600)), (4, " ".join(["x"] * (512 - 12) + [whole.replace("seven", "z")]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, whole)], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.report(spark, df, bench, limit=limit).collect()}
    assert got == {1: "", 2: "8", 3: "8", 4: "8"}


def test_masks_are_lossless():
    from itertools import combinations

    for gone in combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(all(s + i not in gone for i, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - len(m) + 1))


# 10: byte-level BPE


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query_equals_the_library(spark, odd, empty, reference):
    want = Counter()
    for i, t in rows_of(odd):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        want[(i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, bpe.digests(odd).collect())) == want
    assert bpe.digests(empty).count() == 0
    back = bpe.decode(bpe.encode(odd)).collect()
    assert Counter((r.doc_id, bytes(r.text).decode()) for r in back) == Counter((i, t or "") for i, t in rows_of(odd))


def test_merge_replay_on_odd_texts(reference):
    coder = bpe.MergeReplay.from_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), cache_bytes=10)
    texts = ["", " ", "\n", "  a  b\n\n c", "a\tb \n", " lead", "trail ", "aaaaaaa" * 50, "don't 've 12 34½ ²³", "日本語 テスト　x", "a\x1cb c", "\xa0 z", "x\x00 \x00y", "a\nb\nc", "é" * 3000]
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode_batch(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_merge_replay_where_ranks_precede_their_parts():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"aba": 290, b"bb": 310, b"abab": 305}
    coder = bpe.MergeReplay(ranks, r"\S+|\s+")

    def plain(word):
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            best = min(((ranks.get(parts[i] + parts[i + 1], 10**9), i) for i in range(len(parts) - 1)))
            if best[0] == 10**9:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [ranks[p] for p in parts]

    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(2, 14))).encode() for _ in range(300)]
    assert [np.frombuffer(x, "<u2").tolist() for x in coder.replay(words)] == [plain(w) for w in words]


# the pipeline


def test_pipeline_stages_keep_columns_and_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        rows = out.collect()
        assert out.columns == docs.columns, name
        before = {r.doc_id for r in docs.collect()}
        assert {r.doc_id for r in rows} <= before and len({r.doc_id for r in rows}) == len(rows) > 0.5 * len(before)
        docs = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == docs.count()
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect())
