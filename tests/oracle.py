"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def normal(rows) -> list[tuple]:
    def one(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.9g}"
        return str(x)

    return sorted(tuple(map(one, r)) for r in rows)


def compare(spark, name: str, query, sql: str, sf_dir: str = DATA) -> None:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    assert sorted(con.sql(sql).columns) == cols, name
    want = normal(con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({sql})").fetchall())
    got = normal(df.select(*cols).collect())
    assert got == want, (name, sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3])
