"""Run a registered query and its SQL twin side by side. Usage: compare.py SF [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for row in pdf.itertuples(index=False):
        rows.append(tuple(None if not isinstance(v, (list, tuple)) and not hasattr(v, "shape") and pd.isna(v) else (round(float(v), 6) + 0.0 if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else (bool(v) if isinstance(v, bool) or type(v).__name__ == "bool_" else (int(v) if type(v).__name__.startswith("int") else str(v)))) for v in row))
    return sorted(rows, key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> str:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)} rows {t1 - t0:.1f}s"
    want = con.execute(sql).df()
    t2 = time.time()
    times = f"{t1 - t0:.1f}s duck {t2 - t1:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        return f"FAIL rows {len(a)} vs {len(b)} {times}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"FAIL {len(bad)}/{len(a)} differ e.g.\n   {sorted(got.columns)}\n   spark {bad[0][0]}\n   duck  {bad[0][1]} {times}"
    return f"ok {len(a)} rows {times}"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    for name in qs:
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            print(name, compare(spark, con, sf_dir, qs[name], sqls.get(name)), flush=True)
        except Exception as e:  # noqa: BLE001
            print(name, "ERROR", type(e).__name__, str(e)[:1500], flush=True)


if __name__ == "__main__":
    main()
