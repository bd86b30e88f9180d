"""Block sums against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkcomm.operators import pair_blocks
from sparkcomm.operators import spatial as sp
from sparkcomm.operators.pair_blocks import distance_bins, kernel_sums


def cells(spark, n=400):
    rng = np.random.default_rng(1)
    xy = np.round(rng.normal(size=(n, 2)) * 5, 2)
    xy[50:80] = xy[0]  # thirty cells at one place
    rows = [(f"c{i}", "ABC"[i % 3], "uv"[i % 2], float(x), float(y)) for i, (x, y) in enumerate(xy)]
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    return d, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), spark.createDataFrame(rows, "cell_id string, group string, section string, x double, y double")


@pytest.mark.parametrize("kernel, reach", [("contact", 1.5), ("exp", 6.0), ("contact", 0.0)])
def test_kernel_sums_of_crowded_tiles_sections_and_runs(spark, kernel, reach):
    d, g, sec, df = cells(spark)
    both = df.withColumn("i", F.lit(0)).unionByName(df.withColumn("i", F.lit(300)).withColumn("group", F.lit("A")))
    got = {(r["i"], r["section"], r["source"], r["target"]): r["_sum"] for r in kernel_sums(both, kernel, reach, 0.7, by=["section"], run="i", crowd=30).collect()}
    w = np.where(d <= reach, np.exp(-d / 0.7) if kernel == "exp" else 1.0, 0.0)
    for s in "uv":
        for a in "ABC":
            for b in "ABC":
                assert got.get((0, s, a, b), 0.0) == pytest.approx(w[np.ix_((g == a) & (sec == s), (g == b) & (sec == s))].sum(), rel=1e-12)
        assert got[300, s, "A", "A"] == pytest.approx(w[np.ix_(sec == s, sec == s)].sum(), rel=1e-12)


def test_no_pair_of_places_is_a_row(spark):
    _, _, _, df = cells(spark)
    plan = sp.spatial_weights(df, radius=1.5, sigma=0.2)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "xb" not in plan


def test_distance_bins(spark):
    d, g, _, df = cells(spark)
    probs = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    cuts, bins = distance_bins(df, probs, block=100)
    assert cuts == pytest.approx(np.quantile(d.ravel(), probs), rel=1e-15)
    rows = bins.collect()
    assert len(rows) == 45
    for r in rows:
        block = d[np.ix_(g == r["source"], g == r["target"])]
        assert r["n"] == ((block >= r["lo"]) & (block <= r["hi"])).sum()


@pytest.mark.parametrize("few", [1, 1_000_000])
def test_distance_bins_of_ties_and_far_clusters(spark, few):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.integers(0, 12, size=(300, 2)) * 0.1, rng.normal(size=(200, 2)) + 50, rng.normal(size=(50, 2)) * 0.01 - 90])
    g = np.array(["ABCD"[i % 4] for i in range(len(xy))])
    df = spark.createDataFrame([(f"c{i}", g[i], float(x), float(y)) for i, (x, y) in enumerate(xy)], "cell_id string, group string, x double, y double")
    d = np.sqrt((xy[:, None, 0] - xy[None, :, 0]) ** 2 + (xy[:, None, 1] - xy[None, :, 1]) ** 2)
    probs = [0.0, 0.1, 0.35, 0.5, 0.9, 1.0]
    cuts, bins = distance_bins(df, probs, block=64, few=few)
    assert cuts == pytest.approx(np.quantile(d.ravel(), probs), rel=1e-15)
    for r in bins.collect():
        block = d[np.ix_(g == r["source"], g == r["target"])]
        assert r["n"] == ((block >= r["lo"]) & (block <= r["hi"])).sum()


def test_far_leaves_count_as_a_whole():
    """Most leaves of 16 neighbours lie between two cuts with all their distances, so few pairs of places are looked at."""
    xy = np.random.default_rng(3).uniform(size=(20000, 2))
    row = pd.Series({"xs": xy[:, 0], "ys": xy[:, 1], "gs": np.zeros(len(xy), dtype=int), "ns": np.ones(len(xy))})
    side = pair_blocks._Side(row, 1)
    least, most = pair_blocks._bounds(side, side, slice(0, len(side.total)))
    cuts = np.array([0.3, 0.6, 0.9])
    assert (np.searchsorted(cuts, least, "right") != np.searchsorted(cuts, most, "right")).mean() < 0.3
    assert side.total.sum() == side.groups.sum() == len(xy)


def test_kernels_share_one_pass(spark):
    d, g, _, df = cells(spark)
    weights = sp.spatial_weights(df, radius=1.5, sigma=0.2)
    assert weights._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
    for r in weights.collect():
        block = d[np.ix_(g == r["source"], g == r["target"])]
        want = (block <= 1.5).mean() if r["kernel"] == "contact" else np.exp(-block / 0.2).mean()
        assert r["spatial_weight"] == pytest.approx(want, abs=1e-12)
