"""Compare a registered query with its SQL in DuckDB: same columns, same multiset of rows."""

from __future__ import annotations

import math
import os
import sys
from collections import Counter
from pathlib import Path

import duckdb

DATA = os.environ.get("WAYMARK_TESTDATA", "/root/testdata")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def difference(spark, name: str, build, sql: str, folder: str) -> str:
    """Empty if equal, else a short account."""
    df = build(spark, folder)
    cols = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in df.columns]).collect())
    res = connect(folder).execute(sql)
    theirs_cols = [c[0] for c in res.description]
    if sorted(theirs_cols) != cols:
        return f"{name}: columns {cols} against {sorted(theirs_cols)}"
    at = [theirs_cols.index(c) for c in cols]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in res.fetchall())
    if mine == theirs:
        return ""
    a, b = mine - theirs, theirs - mine
    return f"{name}: {sum(mine.values())} rows against {sum(theirs.values())}; only here {list(a.items())[:3]}; only there {list(b.items())[:3]}"


def main(names: list[str]) -> int:
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as e
    from waymark.session import local_session

    spark = local_session()
    qs, sq, bad = e.queries(), e.oracle_sql(), 0
    folder = f"{DATA}/{os.environ.get('SF', 'sf0.01')}"
    for n in names or list(qs):
        t = time.time()
        try:
            why = difference(spark, n, qs[n], sq[n], folder) if n in sq else f"no SQL; {qs[n](spark, folder).count()} rows"
        except Exception as x:  # noqa: BLE001
            why = f"ERROR {type(x).__name__} {str(x)[:1500]}"
        bad += bool(why) and not why.startswith("no SQL")
        print(f"{n}: {why or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
