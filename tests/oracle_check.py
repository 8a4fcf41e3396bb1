"""Runs registered queries next to their SQL oracles and compares them (also used by the tests)."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from chalkline.catalog.views import BASE_TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for b in BASE_TABLES:
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM '{folder}/{b}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, (int, float)):
        return f"n:{value + 0.0:.9g}" if value else "n:0"
    return f"s:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder):
    """(ok, message, seconds)."""
    start = time.time()
    df = fn(spark, folder)
    got_cols, got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no oracle", spent
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    types = {d[0]: str(d[1]) for d in cur.description}
    odd = [c for c, ty in types.items() if "HUGE" in ty or "DECIMAL" in ty]
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd += [f"{c}:{s}/{types.get(c)}" for c, s in df.dtypes if types.get(c) and kinds.get(s, s) != types[c]]
    if got_cols != want_cols:
        return False, f"columns {got_cols} vs {want_cols}", spent
    if got != want:
        a, b = set(got), set(want)
        return False, (f"{len(got)} vs {len(want)} rows; {len(a - b)} only in Spark {list(a - b)[:2]}; "
                       f"{len(b - a)} only in SQL {list(b - a)[:2]}; columns {got_cols}"), spent
    return True, f"{len(got)} rows" + (f" TYPES {odd}" if odd else "") + ("" if got else " EMPTY"), spent


def main() -> None:
    import __spark_entry__ as entry
    from chalkline import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, message, spent = compare(spark, con, name, fn, oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001
            ok, message, spent = False, f"{type(e).__name__}: {str(e)[:700]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {spent:.1f}s {message[:1100]}", flush=True)
    print("failures:", bad, "of", len(queries))


if __name__ == "__main__":
    main()
