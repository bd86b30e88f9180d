"""Label shuffles of a table that lies in one file are dealt over tasks: its runs are many rows, each with a hash."""

from pyspark.sql import functions as F

from sparkcomm.operators import resample


def items(spark, n):
    return spark.range(0, n, 1, 1).select(F.concat(F.lit("c"), "id").alias("cell_id"), F.concat(F.lit("g"), F.col("id") % 3).alias("group"))


def test_runs_of_one_file_are_dealt_over_tasks(spark):
    cells = items(spark, 90_000)
    assert cells.rdd.getNumPartitions() == 1
    moved = resample.shuffled_labels(cells, "group", 5, id_col="cell_id", seed=3, run="i")
    per = moved.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per) > 1 and max(r["count"] for r in per) < 450_000 / 2
    assert {(r["i"], r["group"], r["count"]) for r in moved.groupBy("i", "group").count().collect()} == {(i, f"g{g}", 30_000) for i in range(5) for g in range(3)}


def test_labels_do_not_depend_on_the_tasks(spark, monkeypatch):
    cells = items(spark, 3_000)
    rows = lambda: sorted(tuple(r) for r in resample.shuffled_labels(cells, "group", 2, id_col="cell_id", seed=3, run="i").select("cell_id", "i", "group").collect())
    alone = rows()
    monkeypatch.setattr(resample, "spread_rows", lambda df, times, id_col: df.repartition(7, id_col))
    assert rows() == alone
