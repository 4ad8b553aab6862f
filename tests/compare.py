"""Compare a query with its SQL form on the same Parquet files."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, decimal.Decimal):
        return ("dec", str(value))
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return ("f", repr(value))
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, folder, query, sql) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, folder)
    got_cols, got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = rows([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"rows {sum(got.values())} vs {sum(want.values())}; only spark {extra}; only sql {missing}"
    return None if got else "both sides are empty"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from moraine.session import build_session

    folder = sys.argv[1]
    names = sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, q in entry.queries().items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, folder, q, sqls[name]) if name in sqls else f"no sql, {q(spark, folder).count()} rows"
        except Exception as e:  # report and go on
            verdict = f"{type(e).__name__}: {str(e)[:600]}"
        bad += verdict is not None
        if verdict or names:
            print(f"{name}: {verdict or 'ok'} ({time.time() - start:.1f}s)", flush=True)
    print(f"{bad} not equal")
