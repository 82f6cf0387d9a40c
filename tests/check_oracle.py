"""Compare registered queries with their SQL twins on DuckDB: python tests/check_oracle.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(float(v))
        if hasattr(v, "isoformat"):
            return v.isoformat()
        if v is not None and type(v).__name__ == "Decimal":
            return repr(float(v))
        return repr(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf):
    started = time.time()
    df = query(spark, sf)
    rows = df.collect()
    took = time.time() - started
    if sql is None:
        return ("rows-only" if rows else "EMPTY", len(rows), took, "")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return ("COLUMNS", len(rows), took, f"{sorted(df.columns)} vs {sorted(cols)}")
    a, b = canon(rows, df.columns), canon(theirs, cols)
    if a == b:
        return ("ok" if rows else "ok-EMPTY", len(rows), took, "")
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return ("DIFF", len(rows), took, f"{len(a)} vs {len(b)} rows\n   spark {only_a}\n   duck  {only_b}")


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    from glossaloom.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, con = local_session(8), duck(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in wanted or queries:
        try:
            status, n, took, detail = compare(spark, con, name, queries[name], sql.get(name), sf)
        except Exception as exc:  # noqa: BLE001
            status, n, took, detail = "ERROR", 0, 0.0, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += status not in ("ok", "rows-only")
        print(f"{status:10} {name:34} {n:7} rows {took:6.2f}s {str(detail)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
