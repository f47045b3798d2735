"""Compare registered queries with their oracles: python -m checks.run [sf] [name-substring ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(cell(x) for x in v)
    return str(v)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)
    return [names[i] for i in order], data


def compare(con, sql, df):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = table_of(names, cur.fetchall())
    got = table_of(df.columns, df.collect())
    if want[0] != got[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(want[1]) != len(got[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)} of {len(got[1])} rows differ, e.g.\n   {got[0]}\n   spark {bad[0][0]}\n   duck  {bad[0][1]}" if bad else None


def main():
    from checks import catalog
    sf, only = (sys.argv[1] if len(sys.argv) > 1 else "sf0.01"), sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), []
    for name, fn in catalog.QUERIES.items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            sql = catalog.ORACLES.get(name)
            df = fn(spark, sf_dir)
            msg = compare(con, sql, df) if sql else None
            n = None if sql else df.count()
        except Exception as e:  # report and go on
            msg, n = f"{type(e).__name__}: {str(e)[:1500]}", None
        took = time.time() - start
        print(f"{'FAIL' if msg else 'ok  '} {took:6.2f}s {name} {'' if n is None else f'rows={n}'} {msg or ''}", flush=True)
        if msg:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
