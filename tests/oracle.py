"""Run registered queries next to their SQL text and compare the rows.

    python tests/oracle.py [sf dir] [name ...]
"""

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spikegrid.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(norm(r[k]) for k in order) for r in rows), key=lambda r: [(x is not None, str(type(x)), x) for x in r])


def expected(con, text):
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(df, con, text):
    """None if equal, else what differs."""
    got = [tuple(r) for r in df.collect()]
    names, want = expected(con, text)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0][0]} / {bad[0][1]}"
    kinds = {type(x) for r in a for x in r} ^ {type(y) for r in b for y in r}
    return f"types {kinds}" if kinds else None


if __name__ == "__main__":
    from spikegrid.plans.catalog import ORACLE, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, sf)
            if n in ORACLE:
                diff = compare(df, con, ORACLE[n])
                state = "ok" if diff is None else f"DIFF {diff}"
                state += f" ({df.count()} rows)" if diff is None else ""
            else:
                state = f"rows {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            state = f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += not state.startswith(("ok", "rows"))
        print(f"{n:24s} {time.time() - t0:6.1f}s {state}", flush=True)
    print("bad:", bad)
