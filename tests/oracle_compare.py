"""Run registered queries in Spark and their SQL in DuckDB; compare the
row multisets column by column (order-insensitive).

    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    if isinstance(v, bool):
        return v
    return v


def duck_con(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict:
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck_con(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        rows = df.collect()
        cols = df.columns
        t1 = time.time()
        if name not in sqls:
            out[name] = {"rows": len(rows), "oracle": None}
            if verbose:
                print(f"{name:32s} rows={len(rows):8d} (no oracle) spark={t1 - t0:.1f}s")
            continue
        cur = con.execute(sqls[name])
        dcols = [d[0] for d in cur.description]
        drows = cur.fetchall()
        ok_cols = sorted(cols) == sorted(dcols)
        res = {"rows": len(rows), "oracle_rows": len(drows), "cols_ok": ok_cols}
        if ok_cols:
            order = sorted(cols)
            a = Counter(tuple(_norm(r[c]) for c in order) for r in rows)
            di = {c: i for i, c in enumerate(dcols)}
            b = Counter(tuple(_norm(r[di[c]]) for c in order) for r in drows)
            res["values_ok"] = a == b
            if a != b and verbose:
                only_a = list((a - b).elements())[:3]
                only_b = list((b - a).elements())[:3]
                print("   cols:", order)
                print("   spark-only:", only_a)
                print("   duck-only: ", only_b)
        else:
            res["values_ok"] = False
            if verbose:
                print("   spark cols:", cols, "\n   duck cols: ", dcols)
        out[name] = res
        if verbose:
            print(f"{name:32s} rows={len(rows):8d}/{len(drows):8d} cols={ok_cols} "
                  f"values={res['values_ok']} spark={t1 - t0:.1f}s")
    return out


if __name__ == "__main__":
    from wardlake.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_session("local[8]", 8, extra={"spark.driver.memory": "12g"})
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v.get("oracle_rows") is not None and not v.get("values_ok")]
    print("FAILED:", bad if bad else "none", f"({len(res)} queries)")
