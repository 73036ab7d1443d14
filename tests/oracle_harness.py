"""Run registered queries on Spark and their oracle SQL on DuckDB, compare.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return v
    if isinstance(v, Decimal):
        return v.normalize()
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__) if v is not None else "", v if v is not None else 0)
                 for v in row)


def compare(spark, sf_dir: str, name: str, query, sql: str | None, con) -> dict:
    t0 = time.perf_counter()
    df = query(spark, sf_dir)
    cols = df.columns
    rows = [tuple(_norm(v) for v in r) for r in df.collect()]
    t_spark = time.perf_counter() - t0
    out = {"name": name, "rows": len(rows), "spark_s": round(t_spark, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    rel = con.sql(sql)
    ocols = rel.columns
    orows = [tuple(_norm(v) for v in r) for r in rel.fetchall()]
    if sorted(cols) != sorted(ocols):
        out["status"] = f"COLUMNS {cols} vs {ocols}"
        return out
    idx = [ocols.index(c) for c in cols]
    orows = [tuple(r[i] for i in idx) for r in orows]
    a = sorted(rows, key=_key)
    b = sorted(orows, key=_key)
    if len(a) != len(b):
        out["status"] = f"ROWCOUNT {len(a)} vs {len(b)}"
        return out
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    out["status"] = "ok" if not bad else f"VALUES {len(bad)} differ, e.g. {bad[0]}"
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as entry
    from kassa.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failures = 0
    for name in names or list(qs):
        try:
            r = compare(spark, sf_dir, name, qs[name], sqls.get(name), con)
        except Exception as exc:  # report and go on
            r = {"name": name, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        failures += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    print(f"failures: {failures}")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
