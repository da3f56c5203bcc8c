"""Compare registered queries with their checking SQL: python tests/check.py [sf] [name part...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from pagesieve.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def compare(spark, con, name: str, sf: str, spent: list | None = None) -> str | None:
    """None if both sides agree, else what differs; `spent` receives the seconds of our side."""
    start = time.time()
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    ours = Counter(tuple(_norm(v) for v in r) for r in df.select(*cols).collect())
    if spent is not None:
        spent.append(time.time() - start)
    if name not in entry.oracle_sql():
        return None if ours else "no rows"
    rel = con.sql(entry.oracle_sql()[name])
    if sorted(rel.columns) != cols:
        return f"columns {cols} != {sorted(rel.columns)}"
    order = [rel.columns.index(c) for c in cols]
    theirs = Counter(tuple(_norm(r[i]) for i in order) for r in rel.fetchall())
    if ours == theirs:
        return None if ours else "no rows on either side"
    a, b = list((ours - theirs).items()), list((theirs - ours).items())
    return f"{sum(ours.values())} rows vs {sum(theirs.values())}; ours only {len(a)}: {str(a[:2])[:700]} | theirs only {len(b)}: {str(b[:2])[:700]}"


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


if __name__ == "__main__":
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    parts = sys.argv[2:]
    spark, con = local_session(), connect(sf)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in entry.queries():
        if parts and not any(p in name for p in parts):
            continue
        t, spent = time.time(), [0.0]
        try:
            diff = compare(spark, con, name, sf, spent)
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:900]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {spent[-1]:.2f}s of {time.time() - t:.2f}s {diff or ''}", flush=True)
    print("failures:", bad, "of", len(entry.queries()), "without oracle:", sorted(set(entry.queries()) - set(entry.oracle_sql())))
