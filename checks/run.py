"""Compare registered queries with DuckDB: ``python -m checks.run [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "tolist"):
        return canon(v.tolist())
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, int):
        return v
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return "rows-only", len(got), t1 - t0, 0.0, ""
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    if sorted(cols) != sorted(dcols):
        return "SCHEMA", len(got), t1 - t0, t2 - t1, f"{sorted(cols)} vs {sorted(dcols)}"
    a, b = rows_of(cols, got), rows_of(dcols, want)
    if a == b:
        return "ok", len(got), t1 - t0, t2 - t1, ""
    if len(a) != len(b):
        sa, sb = set(a), set(b)
        return "COUNT", len(got), t1 - t0, t2 - t1, (
            f"{len(a)} vs {len(b)}; only spark {list(sa - sb)[:3]}; only sql {list(sb - sa)[:3]}"
        )
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return "VALUE", len(got), t1 - t0, t2 - t1, f"{sorted(cols)} {len(diff)} rows differ, e.g. {diff[:3]}"


def main() -> int:
    from checks import ORACLES, QUERIES
    from strandline.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.ui.explainMode", "simple")
    con = connect(sf_dir)
    bad = 0
    for n in names:
        try:
            status, rows, ts, td, note = compare(spark, con, n, QUERIES[n], ORACLES.get(n), sf_dir)
        except Exception as e:  # report and go on
            status, rows, ts, td, note = "ERROR", 0, 0, 0, str(e).split("JVM stacktrace")[0][:500]
        bad += status not in ("ok", "rows-only")
        print(f"{status:10s} {n:32s} rows={rows:8d} spark={ts:6.2f}s duckdb={td:6.2f}s {note}", flush=True)
    print("bad:", bad, "of", len(names))
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
