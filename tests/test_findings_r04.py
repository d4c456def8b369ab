"""Cases of the fourth round's findings."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.parquet as pq

from quern.operators import chunking
from quern.plans import documents
from quern.sources import markdown


def test_a_text_without_headings_is_one_range():
    assert markdown.heading_anchors("") == [(None, 0, 0)]
    assert markdown.heading_anchors("plain\n##\n#x") == [(None, 0, 11)]
    assert markdown.heading_anchors("plain\n# A\nb\n## C") == [("A", 6, 12), ("C", 12, 16)]


def test_texts_without_headings_are_chunked(spark, tmp_path):
    texts = [None, "", "\n", "\nplain text", "Head\nbody", "\n" + "word " * 300]
    pq.write_table(pa.table({"doc_id": pa.array(range(6), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    got = sorted(map(tuple, documents.chunk_documents(spark, str(tmp_path)).collect()), key=lambda r: (r[0], r[2]))
    long = "## \n" + "word " * 300

    def row(doc, n, text, tokens, start, heading=None):
        kind = "heading" if heading else "document"
        return doc, chunking.chunk_id(str(doc), n), n, hashlib.sha256(text.encode()).hexdigest(), tokens, start, start + len(text), kind, heading

    want = [
        *(row(d, 1, "##", 0, 0) for d in range(3)), row(3, 1, "## \nplain text", 2, 0), row(4, 1, "## Head\nbody", 2, 0, "Head"),
        row(5, 1, long[:1198], 239, 0), row(5, 2, long[1079:1503], 85, 1079),
    ]
    assert got == want
    plain = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "plain")], "document_id int, markdown string")
    assert [(r.document_id, r.content, r.anchor_type, r.heading) for r in chunking.chunk_documents(plain).collect()] == [(4, "plain", "document", None)]
