"""The driver contract, and that nothing but the entry knows the optional part."""

from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_each_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_library_does_not_import_the_optional_part():
    for path in (REPO / "quern").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quern.llm" not in path.read_text(), path


def test_queries_remain_without_the_optional_part(monkeypatch):
    import importlib.util

    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n in ("quern.llm", "corpus_pipeline") else found(n, *a))
    assert not [n for n in __spark_entry__.queries() if n.startswith("op") and n[2:3].isdigit() or n == "pipeline"]
