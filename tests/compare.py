"""Run queries beside their SQL: python tests/compare.py DIR [NAME...]."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def oracle(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(d).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytearray, bytes, memoryview)):
        return bytes(v).hex()
    return str(v) if v is not None and not isinstance(v, (int, bool, str)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, d, name, query, sql):
    df = query(spark, d)
    a = rows_of(df.columns, df.collect())
    r = con.sql(sql)
    b = rows_of(list(r.columns), r.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        return f"{sum((a[1] - b[1]).values())} rows only in Spark, e.g. {list(a[1] - b[1])[:3]}; {sum((b[1] - a[1]).values())} only in SQL, e.g. {list(b[1] - a[1])[:3]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from pagemill.session import build

    spark = build()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = oracle(sys.argv[1]), 0
    qs, sqls = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sorted(qs):
        t = time.time()
        try:
            if name in sqls:
                why = compare(spark, con, sys.argv[1], name, qs[name], sqls[name]) or "ok"
            else:
                why = f"rows only: {qs[name](spark, sys.argv[1]).count()}"
        except Exception as x:
            why = f"ERROR {str(x)[:600]}"
        bad += not why.startswith(("ok", "rows only"))
        print(f"\n{name}: {time.time() - t:.1f} s " + why.replace("\n", " ")[:900], flush=True)
    print(bad, "bad")
