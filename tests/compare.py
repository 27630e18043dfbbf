"""Run a registered query in Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import glob
import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def _kind(type_name: str) -> str:
    name = type_name.lower()
    if name in ("int", "integer", "bigint", "smallint", "tinyint"):
        return "whole"
    return {"varchar": "string"}.get(name, name)


def difference(spark_df, con, sql: str) -> str | None:
    """None if both results hold the same rows, else what differs."""
    theirs = con.execute(sql)
    kinds = {d[0]: _kind(str(d[1])) for d in theirs.description}
    ours = {f.name: _kind(f.dataType.simpleString()) for f in spark_df.schema.fields}
    odd = {c: (k, kinds.get(c)) for c, k in ours.items() if c in kinds and k != kinds[c]}
    if odd:
        return f"types differ {odd}"
    names = [d[0] for d in theirs.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(set(names) ^ set(spark_df.columns))}"
    expected = _rows(names, theirs.fetchall())
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(expected) != len(got):
        return f"{len(got)} rows, expected {len(expected)}"
    if not expected:
        return "no rows at all"
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    if bad:
        g, e = bad[0]
        where = [(n, x, y) for n, x, y in zip(sorted(names), g, e) if x != y]
        return f"{len(bad)} of {len(got)} rows differ, first {where[:6]} in {g[:4]}"
    return None
