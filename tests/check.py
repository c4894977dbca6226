"""Run registered queries against their SQL: python tests/check.py <sf_dir> [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return ("f", repr(v + 0.0))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    if isinstance(v, dict):
        return ("d", tuple(sorted((k, _norm(x)) for k, x in v.items())))
    return (type(v).__name__, str(v))


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if equal, else what differs."""
    cols = sorted(df.columns)
    got_rows = [tuple(row[c] for c in cols) for row in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    at = [names.index(c) for c in cols]
    want_rows = [tuple(r[i] for i in at) for r in cur.fetchall()]
    if len(got_rows) != len(want_rows):
        return f"rows {len(got_rows)} != {len(want_rows)}"
    got = sorted(tuple(_norm(v) for v in r) for r in got_rows)
    want = sorted(tuple(_norm(v) for v in r) for r in want_rows)
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        cells = [(c, a, b) for c, a, b in zip(cols, *bad[0]) if a != b]
        return f"{len(bad)} rows differ, first: {cells}"
    return "EMPTY" if not got_rows else None


def main() -> None:
    from tallyforge.plans import ORACLES, QUERIES
    from tallyforge.session import local_session

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = local_session("8")
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            result = compare(df, con, ORACLES[name]) if name in ORACLES else f"no sql, {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:600]}"
        took = time.time() - start
        if result or took > float(os.environ.get("SLOW", 4)):
            bad += bool(result)
            print(f"{name:40s} {took:6.2f}s {result or 'ok'}", flush=True)
    print("done", len(QUERIES), "queries,", bad, "to look at")


if __name__ == "__main__":
    main()
