"""Run queries against their SQL twins in DuckDB. Usage: python tests/oracle.py SF [name-prefix ...]"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str | None:
    got = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    want, cols = rel.fetchall(), rel.columns
    if sorted(spark_df.columns) != sorted(cols):
        return f"columns {sorted(spark_df.columns)} vs {sorted(cols)}"
    a, b = rows_of(spark_df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        sa, sb = set(a), set(b)
        return f"{len(sa - sb)} rows differ of {len(a)}\n   spark {sorted(sa - sb)[:3]}\n   sql   {sorted(sb - sa)[:3]}"
    return None if a else "both empty"


if __name__ == "__main__":
    import __spark_entry__ as e
    from cohortspark.session import local_session

    sf = f"/root/testdata/sf{sys.argv[1]}"
    want = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    sqls, bad = e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        t0 = time.time()
        try:
            if name in sqls:
                msg = compare(fn(spark, sf), con, sqls[name])
            else:
                n = fn(spark, sf).count()
                msg = None if n else "no rows"
                name += f" [rows only: {n}]"
        except Exception as ex:  # noqa: BLE001 - report and go on
            msg = f"{type(ex).__name__}: {str(ex)[:700]}"
        bad += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {name} {time.time() - t0:.1f}s {msg or ''}", flush=True)
    print("failures:", bad)
