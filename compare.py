"""Run queries and their check SQL side by side: python compare.py [name-prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trialspark.plans import load_all  # noqa: E402
from trialspark.session import build_session  # noqa: E402

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def key(row):
    out = []
    for v in row:
        if v is None:
            out.append("~null")
        elif isinstance(v, bool):
            out.append(str(v))
        elif isinstance(v, (int, float)):
            f = float(v)
            out.append("nan" if f != f else f"{f + 0.0:.9g}")
        else:
            out.append(str(v))
    return tuple(out)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def close(got, want, floats, cols, df):
    """Rows in order of their exact columns; floating-point columns have to agree in 9 digits."""
    exact = [i for i in range(len(cols)) if i not in floats]
    place = lambda r: (key([r[i] for i in exact]), [(r[i] is not None, round(float(r[i] or 0), 5)) for i in floats])
    bad = []
    for a, b in zip(sorted(got, key=place), sorted(want, key=place)):
        near = all((a[i] is None) == (b[i] is None) and (a[i] is None or math.isclose(a[i], b[i], rel_tol=1e-9, abs_tol=1e-9) or a[i] != a[i] and b[i] != b[i]) for i in floats)
        if not near or place(a)[0] != place(b)[0]:
            bad.append((tuple(a), tuple(b)))
    if bad or len(got) != len(want):
        return len(got), len(want), f"values differ {cols}\n   {len(bad)}: {bad[:2]}", df
    return len(got), len(want), "ok", df


def compare(spark, con, q, folder):
    df = q.frame(spark, folder)
    cols = sorted(df.columns)
    taken = df.select(*cols).collect()
    got = sorted(key(r) for r in taken)
    if q.sql is None:
        return len(got), None, "rows only", df
    cur = con.execute(q.check_sql())
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    if sorted(names) != cols:
        return len(got), len(rows), f"columns differ: {sorted(set(names) ^ set(cols))}", df
    order = [names.index(c) for c in cols]
    floats = [cols.index(c) for c in getattr(q, "floats", ())]
    if floats:
        return close(taken, [[r[i] for i in order] for r in rows], floats, cols, df)
    want = sorted(key([r[i] for i in order]) for r in rows)
    if got == want:
        return len(got), len(want), "ok", df
    gs, ws = set(got), set(want)
    a, b = [r for r in got if r not in ws], [r for r in want if r not in gs]
    return len(got), len(want), f"values differ {cols}\n   spark {len(a)}: {a[:2]}\n   sql   {len(b)}: {b[:2]}", df


def main():
    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, q in load_all().items():
        if sys.argv[1:] and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        t0 = time.time()
        try:
            n, m, note, _ = compare(spark, con, q, folder)
        except Exception as e:  # report and go on
            n, m, note = -1, -1, f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += note not in ("ok", "rows only")
        print(f"{name:34s} {n:8d} {m if m is not None else '-':>8} {time.time() - t0:6.2f}s {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
