"""Compare a query with its SQL in DuckDB: the same columns and the same rows in any order."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def compare(spark, sf_dir, query, sql):
    """None, or what differs."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    names, want = sorted(df.columns), sorted(rel.columns)
    if names != want:
        return f"columns {names} != {want}"
    got = Counter(plain(tuple(r[c] for c in names)) for r in df.collect())
    ref = Counter(plain(r) for r in con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in names)} FROM ({sql})").fetchall())
    if got == ref:
        return None
    a, b = list((got - ref).items())[:3], list((ref - got).items())[:3]
    return f"{sum(got.values())} rows against {sum(ref.values())}; only Spark: {str(a)[:900]}; only SQL: {str(b)[:900]}"
