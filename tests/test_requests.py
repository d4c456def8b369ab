"""Claims, active identities, look-ups of sources, answer plans and reports on structures, on cases with known results."""

import json

from pyspark.sql import functions as F

from quern.operators import access, evaluation, governance
from quern.sources import structure

TENANT, USER, OTHER = (f"00000000-0000-4000-8000-00000000000{i}" for i in range(3))


def test_claims_are_parted_or_refused(spark):
    cases = {
        "both": ([f"role:{OTHER}", "permission:documents.review", f"role:{OTHER}", f" tenant:{TENANT}"], None, [f"tenant:{TENANT}", f"user:{USER}", f"role:{OTHER}"], ["documents.review"]),
        "tenant": ([f"tenant:{OTHER}"], "foreign", [], []),
        "user": ([f"role:{OTHER}", f"user:{OTHER}", "permission:x"], "foreign", [], []),
        "key": (["permission:documents.read", f"user:{OTHER}"], "permission", [], []),
        "blank key": (["permission: access.manage"], "permission", [], []),
        "form": (["role:1"], "principal", [], []),
        "variant": ([f"role:{OTHER.replace('-8000', '-7000')}"], "principal", [], []),
        "null claim": ([f"role:{OTHER}", None], "principal", [], []),
        "none": ([], "empty", [], []),
        "null": (None, "empty", [], []),
    }
    rows = spark.createDataFrame([(k, TENANT, USER, c[0]) for k, c in cases.items()], "k string, tenant_id string, user_id string, claims array<string>")
    got = {r.k: (r.problem, r.principals, r.permissions) for r in access.partition_claims(rows).collect()}
    assert got == {k: c[1:] for k, c in cases.items()}
    assert access.partition_claims(rows.limit(0)).count() == 0


def test_only_active_users_of_active_tenants_pass(spark):
    sessions = spark.createDataFrame([("t", 1), ("t", 2), ("t", 3), ("u", 1), ("x", 4), (None, 1), ("t", 1)], "tenant_id string, user_id long")
    tenants = spark.createDataFrame([("t", "active"), ("u", "active"), ("x", "suspended"), (None, "active")], "tenant_id string, status string")
    users = spark.createDataFrame([(1, "t", "active"), (2, "t", "disabled"), (4, "x", "active"), (1, None, "active")], "user_id long, tenant_id string, status string")
    got = sorted(map(tuple, access.active(sessions, tenants, users).collect()), key=str)
    assert got == sorted([("t", 1, True), ("t", 1, True), ("t", 2, False), ("t", 3, False), ("u", 1, False), ("x", 4, False), (None, 1, False)], key=str)


def test_rows_have_one_owner(spark):
    rows = spark.createDataFrame([(1, "t", "u"), (2, "t", None), (3, "s", "u"), (4, None, "u")], "id long, tenant_id string, created_by string")
    assert [r.id for r in access.owned(rows, "t", "u").collect()] == [1]


def test_a_source_is_found_only_by_who_may_read_it(spark):
    chunks = spark.createDataFrame([(1, "t", 10, "v2", ["a"], "one"), (2, "t", 10, "v1", ["a"], "old"), (3, "t", 11, "w", ["a"], "draft"), (4, "t", 12, "x", ["a"], "deleted"), (5, "t", 10, "v2", None, "nobody's")], "chunk_id long, tenant_id string, document_id long, version_id string, principals array<string>, content string")
    documents = spark.createDataFrame([(10, "t", "published", False, "v2"), (11, "t", "draft", False, "w"), (12, "t", "published", True, "x")], "document_id long, tenant_id string, status string, deleted boolean, current_version_id string")
    asked = [(1, 1, "t", ["b", "a"]), (2, 1, "t", ["b"]), (3, 1, "s", ["a"]), (4, 2, "t", ["a"]), (5, 3, "t", ["a"]), (6, 4, "t", ["a"]), (7, 9, "t", ["a"]), (8, 5, "t", ["a", None]), (9, 1, "t", None)]
    wanted = spark.createDataFrame(asked, "request_id long, chunk_id long, tenant_id string, own array<string>")
    got = {r.request_id: (r.found, r.content) for r in access.source_chunks(chunks, documents, wanted).collect()}
    assert got == {1: (True, "one")} | {i: (False, None) for i in range(2, 10)}


def test_answers_within_a_budget(spark):
    calls = spark.createDataFrame([(1, "rich", "big", 5), (2, "poor", "big", 5), (3, "broke", "big", 2), (4, "new", "big", 5)], "call_id long, tenant_id string, model string, hits long")
    calls = calls.withColumn("input_tokens", F.lit(100_000)).withColumn("degraded_input_tokens", F.lit(1000)).withColumn("max_output_tokens", F.lit(1000))
    spent = spark.createDataFrame([("rich", 0.0, 0.0), ("poor", 0.0, 9.9), ("broke", 0.0, 10.0)], "tenant_id string, day_usd double, month_usd double")
    prices = F.create_map(F.lit("chat:big"), F.lit(1.0), F.lit("chat:small"), F.lit(0.1))

    def plan(action="degrade", fallback="small", limits=(1.0, 5.0, 10.0), **more):
        out = governance.answer_plan(calls, spent, prices, limits, action, fallback, 500, 1501, 4000, **more)
        return {r.call_id: tuple(r)[2:] for r in out.collect()}

    # with two retries a call costs 0.306 dollars; degraded, 0.0006
    whole = ("allowed", None, "big", 100_000, 1000, 4000, False, 5)
    assert plan() == {1: whole, 2: ("degraded", "monthly", "small", 1000, 500, 750, False, 5), 3: ("degraded", "monthly", "small", 1000, 500, 750, True, 2), 4: whole}
    assert plan(fallback=governance.EXTRACTIVE)[2] == ("degraded", "monthly", governance.EXTRACTIVE, 1000, 500, 750, True, 3)
    assert plan(fallback=None)[2][2] == "big"
    assert plan("reject")[2] == ("rejected", "monthly", "big", 100_000, 1000, 4000, False, 0)
    assert plan("warn")[2] == ("allowed", "monthly", "big", 100_000, 1000, 4000, False, 5)
    assert plan(limits=(0.3, 5.0, 10.0))[1] == ("degraded", "single_call", "small", 1000, 500, 750, False, 5)
    assert plan(gateway=False)[1] == ("allowed", None, "big", 100_000, 1000, 4000, True, 3)


def page(number, *elements, classification="native"):
    place = {"type": "page", "page": number}
    made = [{"id": f"e{i}", "kind": "paragraph", "location": place, "order": i, "text": t, "markdown": t, "offsetStart": 0, "offsetEnd": 1, "searchable": True, "source": "native", "sectionPath": []} | more for i, (t, more) in enumerate(elements)]
    return {"id": f"page-{number}", "location": place, "width": 1, "height": 1, "classification": classification, "textCharacters": 1, "textCoverage": 1, "imageCount": 0, "ocrApplied": False, "visionAnalyzedImages": 0, "elements": made}


def test_reports_on_structures(spark):
    box = {"bbox": {"x": 0, "y": 0, "width": 1, "height": 1}}
    pages = [page(1, ("Growth of\n 12 %", box), ("in Europe", box | {"source": "vision"}), ("note", {}), ("hidden", {"searchable": False})), page(2, ("A", box), classification="scanned")]
    tables = [{"id": f"t{i}", "location": {"type": "page", "page": p}, "rows": rows, "markdown": ""} for i, (p, rows) in enumerate([(1, [["North", "5"], ["South", "6"]]), (1, [["7"]]), (2, [["East"]])])]
    whole = json.dumps({"version": 2, "format": "pdf", "units": pages, "tables": tables, "quality": {"status": "pass", "score": 100, "reasons": [], "metrics": {}}})
    files = spark.createDataFrame([("v", whole, None), ("w", whole, None), ("broken", "{", None)], "version_id string, content string, sha256 string")
    stored = structure.read(files)
    assert structure.problems(stored).count() == 1
    schema = "version_id string, case_no int, page int, classification string, required_text array<string>, expected_cells array<string>, visual_terms array<string>, boxes boolean"
    cases = [
        ("v", 1, 1, "native", ["growth  OF 12", "12 % in europe", "absent"], ["south 6 7", "East"], ["EUROPE", "growth"], True), ("v", 2, 2, "native", None, ["east"], None, False), ("v", 3, 9, "native", ["x"], ["x"], ["x"], True),
        ("w", 1, 1, None, [], ["5"], None, None), ("w", 2, 2, "scanned", ["a"], None, None, True), ("broken", 1, 1, "native", ["x"], None, None, True),
    ]
    got = {r.version_id: tuple(r)[1:] for r in evaluation.structure_report(stored, spark.createDataFrame(cases, schema)).collect()}
    assert got == {"v": (3, 0.5, 2 / 3, 2 / 3, 0.5, 2 / 3, False), "w": (2, 1.0, 1.0, 1.0, 1.0, 1.0, True), "broken": (1, 1.0, 1.0, 1.0, 1.0, 1.0, True)}
