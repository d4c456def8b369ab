"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from quern.functions import numbers, text, tokens, vectors
from quern.operators import access, answers, chunking, evaluation, layout, lifecycle, planning, retrieval
from quern.sources import markdown


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_planner_windows_and_answers(spark):
    df = spark.createDataFrame([(1, "年假有几天"), (2, '"ABC" 在哪里'), (3, "比较方案甲和方案乙的区别"), (4, "分析销售下降的原因")], "id int, query string")
    got = {r.id: (r.intent, r.candidate_limit, r.result_limit) for r in planning.plan(df, 200, 8, "answer").collect()}
    assert got == {1: ("fact", 200, 5), 2: ("exact", 120, 3), 3: ("comparison", 300, 8), 4: ("analysis", 350, 8)}


def test_planner_disabled_keeps_the_original_only(spark):
    r = planning.plan(spark.createDataFrame([("please find it?",)], "query string"), 200, 8, enabled=False).first()
    assert [v.kind for v in r.variants] == ["original"] and (r.candidate_limit, r.keyword_weight, r.vector_weight) == (200, 1.0, 1.0)


def test_planner_rewrites_and_focuses(spark):
    r = planning.plan(spark.createDataFrame([("please what is the leave policy?",)], "query string")).first()
    assert [(v.text, v.kind) for v in r.variants] == [("please what is the leave policy?", "original"), ("what is the leave policy", "normalized"), ("the leave policy", "keyword")]


def test_shared_item_ranks_first_in_fusion(spark):
    rows = [(1, "a", 1, 2.0), (1, "s", 2, 2.0), (1, "s", 1, 0.5), (1, "b", 2, 0.5), (1, "z", 1, 0.0)]
    got = retrieval.fuse(spark.createDataFrame(rows, "qid int, chunk_id string, rank int, weight double")).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["s", "a", "b"]


@pytest.mark.parametrize(("trade", "order"), [(0.6, [1, 3, 2]), (1.0, [1, 2, 3])])
def test_diversity(spark, trade, order):
    rows = [(1, 1, 1, 1.0, [1.0, 0.0]), (1, 2, 2, 0.95, [0.99, 0.01]), (1, 3, 3, 0.8, [0.0, 1.0])]
    got = retrieval.diversify(spark.createDataFrame(rows, "qid long, chunk_id long, rank int, score double, embedding array<double>"), trade, 3)
    assert [r.chunk_id for r in got.orderBy("position").collect()] == order


def test_consolidation_keeps_other_sources(spark):
    rows = [(1, 1, 0.9, "a", [1.0, 0.0]), (1, 2, 0.8, "a", [1.0, 0.01]), (1, 3, 0.7, "b", [1.0, 0.02])]
    got = retrieval.consolidate(spark.createDataFrame(rows, "qid long, chunk_id long, score double, source string, embedding array<double>")).orderBy("position").collect()
    assert [(r.chunk_id, r.cross_source) for r in got] == [(1, 0), (3, 1)]


def test_batches(spark):
    rows = [(1, 1, 1, 4), (1, 2, 2, 4), (1, 3, 3, 9)]
    got = retrieval.embedding_batches(spark.createDataFrame(rows, "group long, id long, position int, tokens int"), 2, 10).orderBy("id").collect()
    assert [r.batch for r in got] == [0, 0, 1]


def test_rerank_budget_cuts_the_last(spark):
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(1, "a", 1, "one two three", "h1", 1), (1, "b", 1, "one two three", "h1", 2), (1, "c", 2, "four five six", "h2", 3), (1, "d", 3, "seven", "h3", 4)]
    df = spark.createDataFrame([("", None, "", *r) for r in rows], "query string, title string, context string, qid long, chunk_id string, document_id long, content string, content_hash string, rank int")
    packed = lambda most: [(r.chunk_id, r.tokens, r.cut) for r in retrieval.pack_for_rerank(df, 1, 5, most, *vocabulary).orderBy("position").collect()]
    # each text has 4 tokens of framing
    assert packed(3 + 4 + 2 + 4) == [("a", 3, False), ("c", 2, True)]
    assert packed(4) == [] and packed(100) == [("a", 3, False), ("c", 3, False), ("d", 1, False)]
    # query and title count
    titled = df.withColumn("query", F.lit("one two")).withColumn("title", F.lit("one"))
    assert [(r.chunk_id, r.tokens, r.cut) for r in retrieval.pack_for_rerank(titled, 1, 1, 2 + 4 + 3, *vocabulary).collect()] == [("a", 3, True)]


def test_ndcg_of_second_place(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "qid int, rank int, relevance int")
    assert evaluation.ndcg_at(df, 3).first().ndcg == 0.6309


def test_nearest_rank_and_generator():
    assert [evaluation.nearest_rank([40, 100], p) for p in (0.5, 0.95, 0.99)] == [40, 100, 100]
    assert evaluation.uniform(42, 1)[0] == ((42 * 1664525 + 1013904223) % 2**32) / 2**32


def test_citations_and_grounding(spark):
    assert one(spark, text.citations(F.lit("x [1, 2][1]【3，1】"))) == [1, 2, 3]
    rows = [("a [1]", 2, None), ("a [4]", 2, "invalid_citations"), ("a", 2, "missing_citations"), ("## [1]", 2, "empty_answer"), ("a [1]", 0, "no_evidence")]
    got = answers.grounding(spark.createDataFrame([r[:2] for r in rows], "answer string, n_hits int")).collect()
    assert [r.reason for r in got] == [r[2] for r in rows]


def test_extraction_prefers_matching_sentences(spark):
    hits = spark.createDataFrame([(1, 1, "# Head\nNothing here. The [leave](x) policy grants days. More.")], "qid long, rank int, content string")
    assert answers.extractive_answer(hits, spark.createDataFrame([(1, "what is the leave policy")], "qid long, query string")).first().answer == "The leave policy grants days. [1]"


def test_question_places(spark):
    r = spark.createDataFrame([("see page 12 and B2:D9",), ("slide 3",)], "q string").select(answers.page_of(F.col("q")).alias("p"), answers.slide_of(F.col("q")).alias("s"), answers.cells_of(F.col("q")).alias("c")).collect()
    assert (r[0].p, r[0].s, tuple(r[0].c)) == (12, None, (None, "B", 2, "D", 9)) and (r[1].p, r[1].s) == (None, 3)
    want = {
        "第 3 章": (None, None, None, None), "第3页": (3, None, None, None), "p. 4": (None, None, None, None), "第2张幻灯片": (None, 2, None, None),
        "'Q1 plan'!$a$1到b3 please": (None, None, None, ("Q1 plan", "A", 1, "B", 3)), "Budget!C7": (None, None, None, ("Budget", "C", 7, "C", 7)), "section: Leave policy, now": (None, None, "Leave policy", None), "page 99999999999": (None, None, None, None),
    }
    places = lambda q: (answers.page_of(q), answers.slide_of(q), answers.section_of(q), answers.cells_of(q))
    got = spark.createDataFrame([(q,) for q in want], "q string").select("q", *(c.alias(n) for n, c in zip("pstc", places(F.col("q")), strict=True))).collect()
    assert {r.q: (r.p, r.s, r.t, tuple(r.c) if r.c else None) for r in got} == want


def test_lexical_rerank_takes_han_characters_and_pairs(spark):
    found = spark.createDataFrame([(1, 1, "检测 ｉｎｄｅｘ 索引"), (1, 2, "全文检索")], "qid long, chunk_id long, content string")
    got = retrieval.lexical_rerank(found, spark.createDataFrame([(1, "检索 Index")], "qid long, query string")).collect()
    assert {r.chunk_id: r.score for r in got} == {1: 0.6, 2: 0.6}


def test_vector_literals(spark):
    assert [one(spark, vectors.parse_literal(F.lit(v).cast("string"))) for v in ("[1,2.5]", None, "garbage")] == [[1.0, 2.5], [], []]


def test_similarity_of_odd_vectors(spark):
    a = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<double>")
    assert one(spark, vectors.similarity(a(1.0, 0.0), a(-1.0, 0.0))) == 0 and one(spark, vectors.similarity(a(0.0), a(1.0))) == 0 and one(spark, vectors.similarity(a(1.0), a(1.0, 2.0))) == 0


def test_rounding_and_bounds(spark):
    assert one(spark, numbers.half_up(F.lit(1.005), 2)) == 1.0 and one(spark, numbers.half_up(F.lit(-2.5), 0)) == -2.0
    assert one(spark, numbers.ratio(F.lit(1), F.lit(0), 1.0)) == 1.0
    assert one(spark, numbers.wilson(F.lit(0), F.lit(0), True)) == 1.0 and one(spark, numbers.wilson(F.lit(0), F.lit(0), False)) == 1.0


def test_tokens():
    assert tokens.tokenize("ＡＢ年假3天x") == ["ab年假3天x"] and tokens.tokenize("年假 x") == ["年", "假", "年假", "x"]


def test_tables():
    assert markdown.table([["a", "b|c"], ["1"]]) == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"


def test_blocks_and_section_paths():
    got = markdown.blocks("# A\ntext\nmore\n\n### B\n- x\n- y\n\n```\n# no\n```\n| a |\n| - |\n# C\n![i](x)")
    assert [(b["kind"], b["path"]) for b in got] == [("heading", ["A"]), ("paragraph", ["A"]), ("heading", ["A", "B"]), ("list", ["A", "B"]), ("code", ["A", "B"]), ("table", ["A", "B"]), ("heading", ["C"]), ("figure", ["C"])]


def test_chunks_reproduce_the_text():
    body = "Intro.\n\n# One\n" + "word " * 700 + "\n# Two\nshort"
    anchors = [chunking.Anchor("heading", a, b, t) for t, a, b in markdown.heading_anchors(body)]
    got = chunking.chunk("7", body, anchors, 400, 40)
    assert all(body[a:b] == c and c == c.strip() and len(c) <= 402 for _, _, c, _, _, a, b, _, _ in got)
    assert [g[1] for g in got] == list(range(1, len(got) + 1)) and got[-1][8] == "Two" and len({g[0] for g in got}) == len(got)


def test_table_chunks_keep_headers():
    rows = [f"| {i} | {'x' * 20} |" for i in range(20)]
    got = chunking.table_chunks("\n".join(("Title", "| a | b |", "| - | - |", *rows)), 200)
    assert all(g.startswith("Title\n\n| a | b |\n| - | - |\n") for g in got) and [r for g in got for r in g.split("\n")[4:]] == rows


def test_chunk_id_on_both_sides(spark):
    assert one(spark, text.chunk_id(F.lit("v"), F.lit(3))) == chunking.chunk_id("v", 3)


def test_owner_reads_only_where_nobody_else_may(spark):
    docs = spark.createDataFrame([(1, "user:1", 5, "s"), (2, "user:2", 6, "s2")], "document_id long, owner string, folder_id long, space_id string")
    folders = spark.createDataFrame([(5, 4), (4, None), (6, None)], "folder_id long, parent_id long")
    grants = spark.createDataFrame([("folder", "4", "group:a", "read"), ("folder", "5", "group:a", "read"), ("document", "2", "user:9", "manage")], "resource_type string, resource_id string, principal string, permission string")
    got = sorted(map(tuple, access.effective_readers(docs, folders, grants).collect()))
    assert got == [(1, "group:a", "folder", 10), (2, "user:2", "owner", 1000)]


def test_null_principals_never_grant(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, None), (3, ["b"])], "id int, principals array<string>")
    assert [r.id for r in df.filter(access.may_read(F.col("principals"), ["b"])).collect()] == [3]


def test_regions(spark):
    cells = [("s", 1, 1), ("s", 1, 2), ("s", 2, 1), ("s", 5, 4)]
    got = layout.regions(spark.createDataFrame(cells, "sheet string, r int, c int")).orderBy("row_start").collect()
    assert [(r.row_start, r.row_end, r.column_start, r.column_end, r.n) for r in got] == [(1, 2, 1, 2, 3), (5, 5, 4, 4, 1)]


def test_heading_levels(spark):
    rows = [(1, 1, i, s, False) for i, s in enumerate([10.0, 10.0, 10.0, 12.0, 18.0])] + [(1, 1, 9, 3.0, True), (1, 2, 0, 7.0, True), (1, 3, 0, 0.0, None), (2, 1, 0, 20.0, False)]
    lines = spark.createDataFrame(rows, "doc int, page int, line int, size double, margin boolean")
    assert {(r.doc, r.page): r.body for r in layout.body_font(lines).collect()} == {(1, 1): 10.0, (1, 2): 10.0, (1, 3): 10.0, (2, 1): 20.0}
    assert one(spark, layout.heading_level(F.lit(18.0), F.lit(10.0), F.lit("x"))) == 1 and one(spark, layout.heading_level(F.lit(10.0), F.lit(10.0), F.lit("2.1 Scope"))) == 3


def test_transitions_are_closed():
    assert all(b in lifecycle.TRANSITIONS for bs in lifecycle.TRANSITIONS.values() for b in bs)


def test_folders_are_trimmed_to_visible_spaces(spark):
    folders = spark.createDataFrame([(1, None, "s"), (2, 1, "s"), (3, None, "t")], "folder_id long, parent_id long, space_id string")
    grants = spark.createDataFrame([("space", "s", "user:1", "read"), ("folder", "1", "group:2", "read"), ("folder", "3", "user:1", "read"), ("folder", "2", "user:9", "manage")], "resource_type string, resource_id string, principal string, permission string")
    see = lambda own, admin=False: {r.folder_id: r.principals for r in access.visible_folders(folders, grants, own, admin).collect()}
    assert see(["user:1"]) == {1: ["group:2", "user:1"], 2: ["group:2", "user:1"]}
    assert see(["group:2"]) == {} and see([], True)[3] == ["user:1"]


def test_audit_pages(spark):
    events = spark.createDataFrame([(i, "t", "login" if i % 2 else "edit", "doc", i % 3 or None, i // 2) for i in range(9)] + [(99, "u", "edit", "doc", 1, 0)], "id long, tenant_id string, action string, resource_type string, actor_id long, created_at long")
    users = spark.createDataFrame([(1, "Ada")], "id long, name string")
    got = access.audit_page(events, users, "t", page=2, size=4).collect()
    assert sorted(((r.id, r.actor_name, r.total) for r in got), reverse=True) == [(4, "Ada", 9), (3, None, 9), (2, None, 9), (1, "Ada", 9)]
    assert access.audit_page(events, users, "t", "edit", "folder").count() == 0
    with pytest.raises(ValueError):
        access.audit_page(events, users, "t", page=0)
