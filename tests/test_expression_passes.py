from pyspark.sql import functions as F

from catalog import all_queries, roles
from sparkcomm.operators import expression as ex


def test_truncated_mean_reads_the_cells_once(spark, monkeypatch):
    nz = spark.range(2000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("group"), F.lit("G").alias("gene"), (F.col("id") % 10 - 2).cast("double").alias("value")).where("value <> 0")
    sizes = spark.createDataFrame([("a", 1200), ("b", 1000)], "group string, n_cells bigint")
    written, write = [], ex.materialize
    monkeypatch.setattr(ex, "materialize", lambda df: written.append(write(df)) or written[-1])
    got = {r["group"]: (r["expr"], r["pct"]) for r in ex.group_expression(nz, sizes, aggregate="truncated_mean", trim=0.1).collect()}
    values = [(i % 2, float(i % 10 - 2)) for i in range(2000)]
    for side, (group, n) in enumerate((("a", 1200), ("b", 1000))):
        own = [v for s, v in values if s == side]
        own = sorted(own + [0.0] * (n - len(own)))
        kept = own[n // 10 : n - n // 10]
        assert abs(got[group][0] - sum(kept) / len(kept)) < 1e-9 and abs(got[group][1] - sum(v > 0 for v in own) / n) < 1e-12
    assert written[0].count() == 9 and written[0].agg(F.sum("_c")).first()[0] == nz.count()


def test_lines_are_not_sorted_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(roles, "once", lambda spark, sf, name, build, write=True: build())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = roles._expression(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan


def test_comparison_scores_two_samples_only(spark, monkeypatch):
    seen, once = [], roles.once
    monkeypatch.setattr(roles, "_SEEN", {})
    monkeypatch.setattr(roles, "once", lambda spark, sf, name, build, write=True: seen.append(name) or once(spark, sf, name, build, write=write))
    assert all_queries()["i3_differential_network"](spark, "/root/testdata/sf0.001").count() == 25
    assert "expression R" in seen and "expression A" in seen and "expression None" not in seen
