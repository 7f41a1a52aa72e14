"""Compare a Spark result with DuckDB on the same parquet tables."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (v + 0.0)
    return v


def key(row):
    return tuple((v is None, type(v).__name__ if isinstance(v, (str, bool)) else "n", str(v) if isinstance(v, (str, bool)) else (v or 0) if not isinstance(v, str) else v) for v in row)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short text. Types are compared by kind, doubles exactly."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    expected = cur.fetchall()
    cols = sorted(spark_df.columns)
    if cols != sorted(names):
        return f"columns {cols} vs {sorted(names)}"
    simple = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    types = {c: t for c, t in spark_df.dtypes}
    odd = [(c, types[c], kinds[c]) for c in cols if simple.get(kinds[c], kinds[c]) != types[c]]
    got = sorted((tuple(normal(r[c]) for c in cols) for r in spark_df.collect()), key=key)
    want = sorted((tuple(normal(r[names.index(c)]) for c in cols) for r in expected), key=key)
    note = f" types {odd}" if odd else ""
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}{note}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {dict(zip(cols, bad[0][0]))} vs {dict(zip(cols, bad[0][1]))}"[:900] + note
    return f"equal but{note}" if odd else None
