"""Queries and their SQL over copies of places and over means that fall on halves."""

import sys

import duckdb
import pandas as pd

import __spark_entry__ as entry

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from compare import compare  # noqa: E402


def duck(folder):
    con = duckdb.connect()
    for t in ("customer", "nation", "region", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def tables(folder):
    keys = [k + copy * 10000 for copy in range(3) for k in range(40)]  # three cells at each place
    write = lambda name, **columns: pd.DataFrame(columns).to_parquet(f"{folder}/{name}.parquet")
    write("customer", c_custkey=keys, c_name=[str(k) for k in keys], c_nationkey=[0] * 120, c_acctbal=[float(k % 10000) * 17.31 for k in keys], c_mktsegment=["A"] * 120)
    write("nation", n_nationkey=[0], n_name=["n"], n_regionkey=[0])
    write("region", r_regionkey=[0], r_name=["r"])
    write("orders", o_orderkey=list(range(40)), o_custkey=list(range(40)))
    discounts = [(o, (2 * o + 1 + line) // 8 if line else 2 * o + 1 - 7 * ((2 * o + 2) // 8)) for o in range(40) for line in range(8)]
    write("lineitem", l_orderkey=[o for o, _ in discounts], l_linenumber=[1] * 320, l_discount=[d / 100 for _, d in discounts])


def test_places_that_hold_several_cells(spark, tmp_path):
    tables(tmp_path)
    for name in ("o4_contact_pairs", "e3_bh_adjust"):
        assert compare(spark, duck(tmp_path), str(tmp_path), entry.queries()[name], entry.oracle_sql()[name]).startswith("ok"), name
