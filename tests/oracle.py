"""Runs a query and its SQL over the same tables and compares rows."""

from __future__ import annotations

import glob
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return v.isoformat() if hasattr(v, "isoformat") else "~" if v is None else str(v)


def compare(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    got = query(spark, data)
    names = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    assert rows == sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in want.fetchall())
