"""Run registered queries against their DuckDB oracles (what the driver's
correctness check does): row count, column names, order-insensitive values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

STRICT = os.environ.get("ORACLE_STRICT") == "1"   # exact float equality (no rounding in the compare)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if STRICT else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr), [cols[i] for i in order]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name, fn, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    t = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t
    t = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t_duck = time.time() - t
    s_sorted, s_cols = _rows(sdf.columns, srows)
    d_sorted, d_cols = _rows(dcols, drows)
    ok = s_cols == d_cols and s_sorted == d_sorted
    diff = None
    if not ok:
        ss, dd = set(s_sorted), set(d_sorted)
        diff = {"cols": (s_cols, d_cols), "n": (len(s_sorted), len(d_sorted)),
                "only_spark": sorted(ss - dd, key=repr)[:3], "only_duck": sorted(dd - ss, key=repr)[:3]}
    return {"name": name, "ok": ok, "rows": len(srows), "spark_s": round(t_spark, 2), "duck_s": round(t_duck, 2),
            "diff": diff}


if __name__ == "__main__":
    import __spark_entry__ as E
    from docloom.session import get_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:]
    spark = get_session("local[8]")
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = 0
    for n in names or sorted(qs):
        if n not in os_:
            t = time.time()
            try:
                c = qs[n](spark, sf).count()
                print(f"ROWS-ONLY {n}: {c} rows {time.time()-t:.1f}s", flush=True)
            except Exception as e:  # report and go on
                bad += 1
                print(f"BAD ROWS-ONLY {n}: {repr(e)[:1500]}", flush=True)
            continue
        try:
            r = compare(spark, n, qs[n], os_[n], sf, con)
        except Exception as e:  # report and go on
            r = {"name": n, "ok": False, "diff": repr(e)[:1500]}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "BAD ") + str(r)[:3000], flush=True)
    print("failures:", bad)
