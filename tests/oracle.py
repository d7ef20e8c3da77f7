"""Compare named queries with their SQL twins: ``python tests/oracle.py [name-prefix…]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def compare(spark_rows, spark_cols, sql_rows, sql_cols) -> str:
    """Empty text when both sides hold the same bag of rows."""
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns {sorted(spark_cols)} != {sorted(sql_cols)}"
    def bag(rows, cols):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(tuple(cell(r[i]) for i in order) for r in rows)
    a, b = bag(spark_rows, spark_cols), bag(sql_rows, sql_cols)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    diff = [(p, q) for p, q in zip(a, b) if p != q]
    return f"{len(diff)} of {len(a)} rows differ, e.g. {diff[:2]}" if diff else ""


def check(spark, con, name, query, sql, sf_dir: str = SF_DIR):
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(rows), ""
    rel = con.sql(sql)
    return len(rows), compare(rows, df.columns, rel.fetchall(), rel.columns)


def main(prefixes):
    from wattloom.plans import load_all
    from wattloom.session import build_session
    reg = load_all()
    spark, con = build_session("oracle"), connect()
    bad = 0
    for name, query in reg.queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            n, problem = check(spark, con, name, query, reg.sql.get(name))
        except Exception as e:  # report and go on with the next query
            n, problem = -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(problem)
        kind = "sql" if name in reg.sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {n:8d} {kind:4s} {time.time() - start:6.1f}s {problem}",
              flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
