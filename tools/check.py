"""Run registered queries and their SQL twins side by side.

usage: python tools/check.py [--sf 0.01] [name-prefix ...]
"""
import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from pulsegrid.catalog import all_queries  # noqa: E402
from pulsegrid.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def cell(v):
    if v is None:
        return "-"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.5g}" if abs(v) > 1e-9 else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return cell(list(v.asDict().values()))
    if isinstance(v, int):
        return cell(float(v))
    if isinstance(v, dict):
        return cell(list(v.values()))
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    sf = f"/root/testdata/sf{a.sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = []
    for name, q in all_queries().items():
        if a.names and not any(name.startswith(n) for n in a.names):
            continue
        t0 = time.time()
        try:
            df = q.run(spark, sf)
            got = df.collect()
            t1 = time.time()
            if q.sql is None:
                print(f"rows  {name} {len(got)} {t1 - t0:.1f}s", flush=True)
                continue
            rel = con.sql(q.sql)
            names, want = rel.columns, rel.fetchall()
            if sorted(df.columns) != sorted(names):
                raise ValueError(f"columns {sorted(df.columns)} / {sorted(names)}")
            x, y = rows_of(df.columns, got), rows_of(names, want)
            if x == y:
                print(f"ok    {name} {len(x)} {t1 - t0:.1f}s / {time.time() - t1:.1f}s", flush=True)
            else:
                bad.append(name)
                gx, gy = sorted(set(x) - set(y)), sorted(set(y) - set(x))
                print(f"DIFF  {name} {len(x)} / {len(y)}; only here {len(gx)}, only there {len(gy)}\n"
                      f"   {sorted(names)}\n   {gx[:3]}\n   {gy[:3]}", flush=True)
        except Exception as e:
            bad.append(name)
            print(f"ERROR {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("bad:", bad)


main()
