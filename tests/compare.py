"""Run catalogue queries beside their SQL counterparts and compare the rows.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return f"{type(v).__name__}:{v}" if isinstance(v, bool) else str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str) -> str:
    """Empty when equal, else what differs."""
    df = fn(spark, sf_dir)
    mine = df.collect()
    cur = con.execute(sql)
    theirs_cols = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(theirs_cols):
        return f"columns {sorted(df.columns)} != {sorted(theirs_cols)}"
    a, b = rows_of(df.columns, mine), rows_of(theirs_cols, theirs)
    types = {c: t for c, t in zip(theirs_cols, [str(c[1]) for c in cur.description])}
    note = ""
    for c, t in df.dtypes:
        d = types[c].upper()
        if (t, d) not in _SAME and not (t == "boolean" and d == "BOOLEAN"):
            note += f" type {c}: {t} / {d};"
    if a != b:
        extra = [r for r in a if r not in set(b)][:2]
        lacking = [r for r in b if r not in set(a)][:2]
        return f"{len(a)} rows / {len(b)}; only here {str(extra)[:700]}; only there {str(lacking)[:700]}"
    return note if note else ("" if a else "no rows")


_SAME = {
    ("string", "VARCHAR"), ("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("bigint", "HUGEINT"),
    ("date", "DATE"), ("array<double>", "DOUBLE[]"),
}


def main() -> None:
    import __spark_entry__ as entry

    from tests.conftest import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in names:
        began = time.time()
        try:
            if name in sql:
                verdict = compare(spark, con, sf_dir, name, queries[name], sql[name]) or "ok"
            else:
                verdict = f"rows only: {len(queries[name](spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001 - a report of all queries
            verdict = f"{type(e).__name__}: {str(e)[:900]}"
        bad += verdict != "ok" and not verdict.startswith("rows only")
        print(f"{name:28s} {time.time() - began:6.2f}s {verdict}", flush=True)
    print("differences:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
