"""Compare registered queries with their check SQL: ``check.py [sf] [name-part ...]``."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, (bool, int)):
        return str(int(v))
    return "NULL" if v is None else str(v)


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    return rows_of(cols, cur.fetchall()), sorted(cols)


def session(cores=8):
    from gatewatch.session import build_session
    s = build_session("check", f"local[{cores}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    return s


def main(argv):
    sf = argv[0] if argv else "0.01"
    from gatewatch.plans import ORACLES, QUERIES
    picked = [q for q in QUERIES if len(argv) < 2 or any(a in q for a in argv[1:])]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, bad = session(), duck(sf_dir), []
    for q in picked:
        t0 = time.time()
        try:
            df = QUERIES[q](spark, sf_dir)
            got = spark_rows(df)
            t1 = time.time()
            if q not in ORACLES:
                print(f"{q:34} rows-only {len(got):7d} {t1 - t0:6.2f}s", flush=True)
                continue
            want, cols = duck_rows(con, ORACLES[q])
            ok = got == want and cols == sorted(df.columns)
            print(f"{q:34} {'ok ' if ok else 'BAD'} {len(got):7d} {t1 - t0:6.2f}s duck {time.time() - t1:5.2f}s", flush=True)
            if not ok:
                bad.append(q)
                print("   cols", sorted(df.columns), cols, "n", len(got), len(want))
                a, b = set(got), set(want)
                for label, s in (("spark", a - b), ("duck", b - a)):
                    for r in sorted(s)[:3]:
                        print("   ", label, str(r)[:400])
        except Exception as e:  # noqa: BLE001
            bad.append(q)
            print(f"{q:34} ERROR {type(e).__name__}: {str(e)[:900]}", flush=True)
    print(len(picked), "queries,", len(bad), "bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
