"""Closed forms and invariants of group summaries, scores and markers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcomm.operators import expression as ex
from sparkcomm.operators import markers as mk
from sparkcomm.operators.ranks import quantiles, running_totals, top_per_key, value_bucket
from sparkcomm.operators.resample import deal_labels, label_borders, shuffled_labels, shuffled_values
from sparkcomm.plans.communication import compute_communication
from sparkcomm.session import materialize

GENES = ["TGFB1", "TGFBR1", "TGFBR2", "CXCR4", "CXCL12", "CD74"]
VALUES = [[5, 0, 0, 1, 0, 2], [4, 0, 1, 0, 0, 1], [0, 3, 4, 0, 2, 0], [0, 4, 3, 1, 3, 0], [1, 0, 0, 6, 0, 4], [0, 1, 0, 5, 1, 5]]


@pytest.fixture
def core_lr(spark):
    rows = [("TGFB1", "TGFBR1_TGFBR2", "TGFb"), ("CXCL12", "CXCR4", "CXCL"), ("TGFB1", "CD74", "MIF")]
    return spark.createDataFrame(rows, "ligand string, receptor string, pathway string")


def test_hill_score_with_cofactors_closed_form(spark, matrix):
    x = [[2, 0, 0, 0, 3], [4, 0, 0, 0, 3], [0, 3, 3, 6, 0], [0, 6, 6, 6, 0]]
    expression, cells = matrix(x, ["LIG", "REC1", "REC2", "COA", "AGO"], ["A", "A", "B", "B"])
    lr = spark.createDataFrame([("LIG", "REC1_REC2", "TEST", "COA", "AGO")], "ligand string, receptor string, pathway string, co_A_receptor_genes string, agonist_genes string")
    options = {"min_pct": 0.0, "aggregate": "mean", "score_method": "cellchat", "cofactor_adjust": True}
    row = compute_communication(expression, cells, lr, "cell_type", **options).interactions.where("source = 'A' AND target = 'B'").first()
    assert row["ligand_expr"] == pytest.approx(0.5)
    assert row["receptor_expr"] == pytest.approx(0.75)
    assert row["prob"] == pytest.approx(0.9)
    row = compute_communication(expression, cells, lr, "cell_type", population_size=True, **options).interactions.where("source = 'A' AND target = 'B'").first()
    assert row["prob"] == pytest.approx(0.225)


def test_quantiles_count_missing_zeros(spark):
    arr = np.array([[0.0, -2.0, 0.0], [0.0, 0.0, 4.0], [3.0, 0.0, 0.0], [9.0, 5.0, 8.0], [0.0, 0.0, 0.0]])
    rows = [(f"g{j}", float(v)) for row in arr for j, v in enumerate(row) if v != 0]
    nz = spark.createDataFrame(rows, "gene string, value double")
    totals = spark.createDataFrame([(f"g{j}", 5) for j in range(3)], "gene string, n bigint")
    got = {r["gene"]: (r["q0"], r["q1"], r["q2"]) for r in quantiles(nz, ["gene"], "value", [0.25, 0.5, 0.75], totals=totals).collect()}
    want = np.percentile(arr, [25, 50, 75], axis=0)
    for j in range(3):
        assert got[f"g{j}"] == pytest.approx(tuple(want[:, j]))


def test_quantiles_of_one_key_that_owns_most_rows(spark):
    rng = np.random.default_rng(0)
    big = np.concatenate([rng.lognormal(size=4000), np.full(2000, 1.0)])
    rows = [("hot", float(v)) for v in big] + [("cold", 2.0), ("cold", 5.0)]
    q = quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.1, 0.5, 0.99])
    got = {r["k"]: [r["q0"], r["q1"], r["q2"]] for r in q.collect()}
    assert got["hot"] == pytest.approx(list(np.quantile(big, [0.1, 0.5, 0.99])))
    assert got["cold"] == pytest.approx(list(np.quantile([2.0, 5.0], [0.1, 0.5, 0.99])))


def test_running_totals_match_a_sort(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=500) * 10, 3)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id int, v double")
    out = running_totals(df, [], [F.col("v"), F.col("id")], value_bucket(F.col("v")), {"n": F.lit(1).cast("bigint")})
    order = sorted(range(500), key=lambda i: (v[i], i))
    assert {r["id"]: r["n"] for r in out.collect()} == {i: p for p, i in enumerate(order)}


def test_top_per_key_with_a_hot_key(spark):
    rows = [("hot", i) for i in range(3000)] + [("cold", 1)]
    out = top_per_key(spark.createDataFrame(rows, "k string, v int"), ["k"], [F.desc("v")], 5, rank_name="r")
    assert sorted((r["k"], r["v"], r["r"]) for r in out.collect()) == [("cold", 1, 1)] + [("hot", 2995 + i, 5 - i) for i in range(5)]


@pytest.mark.parametrize("aggregate", ["mean", "median", "tri_mean", "truncated_mean", "clipped_mean", "gated_mean"])
def test_explicit_zeros_change_nothing(spark, matrix, core_lr, aggregate):
    expression, cells = matrix(VALUES, GENES, list("AABBCC"))
    zeros = spark.createDataFrame([(f"c{i}", g, 0.0) for i in range(6) for g, v in zip(GENES, VALUES[i]) if v == 0], expression.schema)
    cols = ["source", "target", "ligand", "receptor", "prob"]
    a = compute_communication(expression, cells, core_lr, "cell_type", min_pct=0.0, aggregate=aggregate).interactions.select(cols)
    b = compute_communication(expression.unionByName(zeros), cells, core_lr, "cell_type", min_pct=0.0, aggregate=aggregate).interactions.select(cols)
    flat = lambda rows: sorted((*r[:4], round(r[4], 9)) for r in rows.collect())
    assert flat(a) == flat(b)


def test_gene_names_match_without_case_and_last_spelling_wins(spark, matrix):
    expression, cells = matrix([[1, 9, 4], [1, 9, 4]], ["lig", "LIG", "Rec"], ["A", "B"])
    genes = spark.createDataFrame([("lig", 1), ("LIG", 2), ("Rec", 3)], "gene string, ord int")
    lr = spark.createDataFrame([("Lig", "rec", "P")], "ligand string, receptor string, pathway string")
    rows = compute_communication(expression, cells, lr, "cell_type", genes=genes, aggregate="mean").interactions.collect()
    assert len(rows) == 4 and all(r["prob"] == pytest.approx(6.0) for r in rows)


def test_weights_shrink_totals(spark, matrix, core_lr):
    expression, cells = matrix(VALUES, GENES, list("AABBCC"), x=[0.0, 0, 1, 1, 5, 5], y=[0.0, 1, 0, 1, 5, 6])
    total = lambda **o: compute_communication(expression, cells, core_lr, "cell_type", min_pct=0.0, aggregate="mean", **o).interactions.agg(F.sum("prob")).first()[0]
    plain = total()
    assert total(population_size=True) < plain
    assert total(spatial=True, distance_decay=2.0) < plain


def test_sketches_of_everything_equal_the_whole(spark, matrix, core_lr):
    expression, cells = matrix(VALUES, GENES, list("AABBCC"))
    options = {"min_pct": 0.0, "aggregate": "mean"}
    whole = compute_communication(expression, cells, core_lr, "cell_type", **options).interactions
    sketch = compute_communication(expression, cells, core_lr, "cell_type", downsample_per_group=10, downsample_repeats=3, **options).interactions
    key = ["source", "target", "ligand", "receptor"]
    assert sorted((*[r[k] for k in key], round(r["prob"], 9)) for r in whole.collect()) == sorted((*[r[k] for k in key], round(r["prob"], 9)) for r in sketch.collect())
    assert all(r["stability"] == 1.0 and r["prob_std"] == pytest.approx(0.0, abs=1e-7) for r in sketch.collect())


def test_permutation_pvalues_are_in_range(spark, matrix, core_lr):
    expression, cells = matrix(VALUES, GENES, list("AABBCC"))
    rows = compute_communication(expression, cells, core_lr, "cell_type", min_pct=0.0, aggregate="mean", score_method="cellchat", n_permutations=7).interactions.collect()
    assert rows and all(1 / 8 <= r["pvalue"] <= 1 for r in rows)


@pytest.mark.parametrize("aggregate", ["mean", "tri_mean"])
def test_permutations_equal_runs_one_by_one(spark, matrix, core_lr, aggregate):
    expression, cells = matrix(VALUES, GENES, list("AABBCC"))
    options = {"min_pct": 0.0, "aggregate": aggregate}
    key = ["source", "target", "ligand", "receptor"]
    runs, seed = 2, 11
    got = compute_communication(expression, cells, core_lr, "cell_type", n_permutations=runs, random_state=seed, **options).interactions.collect()
    dealt = shuffled_labels(cells.withColumn("group", F.col("cell_type")), "group", runs, id_col="cell_id", seed=seed).cache()
    hits: dict = {}
    observed = {tuple(r[k] for k in key): r["prob"] for r in got}
    for run in range(runs):
        moved = dealt.where(F.col("perm_id") == run).select("cell_id", F.col("group").alias("cell_type"))
        for r in compute_communication(expression, moved, core_lr, "cell_type", **options).interactions.collect():
            at = tuple(r[k] for k in key)
            hits[at] = hits.get(at, 0) + (at in observed and r["prob"] >= observed[at] * (1 - 1e-9))
    assert got and all(r["pvalue"] == pytest.approx((hits.get(tuple(r[k] for k in key), 0) + 1) / (runs + 1)) for r in got)


def test_runs_are_dealt_without_an_exchange_of_expression(spark):
    expression = spark.range(4000).select(F.concat(F.lit("c"), F.col("id") % 200).alias("cell_id"), F.concat(F.lit("g"), F.floor(F.col("id") / 200)).alias("gene_key"), (F.col("id") % 7 + 1.0).alias("value"))
    cells = spark.range(200).select(F.concat(F.lit("c"), "id").alias("cell_id"), F.concat(F.lit("t"), F.col("id") % 5).alias("group"))
    gathered = materialize(ex.gather_cells(expression, cells))
    rows = ex.cell_places(gathered)
    for runs in (2, 50):
        borders = label_borders(cells, "group", runs, id_col="cell_id")
        dealt = ex.spread_values(deal_labels(rows.drop("group"), borders, runs, id_col="cell_id"), ["perm_id"])
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
        assert dealt.count() == 4000 * runs


def test_a_cell_in_several_sketches_keeps_its_values(spark, matrix, core_lr):
    expression, cells = matrix(VALUES, GENES, list("AABBCC"))
    options = {"min_pct": 0.0, "aggregate": "mean", "n_permutations": 2}
    whole = compute_communication(expression, cells, core_lr, "cell_type", **options).interactions
    sketch = compute_communication(expression, cells, core_lr, "cell_type", downsample_per_group=10, downsample_repeats=2, **options).interactions
    key = ["source", "target", "ligand", "receptor"]
    assert sorted((*[r[k] for k in key], round(r["prob"], 9)) for r in whole.collect()) == sorted((*[r[k] for k in key], round(r["prob"], 9)) for r in sketch.collect())


def test_shuffles_keep_label_counts_per_stratum(spark):
    rows = [(f"c{i}", "ABC"[i % 3 if i < 60 else 0], "s1" if i < 70 else "s2") for i in range(100)]
    df = spark.createDataFrame(rows, "cell_id string, group string, section string")
    out = shuffled_labels(df, "group", 4, id_col="cell_id", within=["section"], run="i").collect()
    want = {}
    for _, g, s in rows:
        want[s, g] = want.get((s, g), 0) + 1
    for run in range(4):
        got = {}
        for r in out:
            if r["i"] == run:
                got[r["section"], r["group"]] = got.get((r["section"], r["group"]), 0) + 1
        assert got == want
    assert len({tuple(sorted((r["cell_id"], r["group"]) for r in out if r["i"] == k)) for k in range(4)}) == 4


def test_shuffled_values_are_permutations(spark):
    df = spark.createDataFrame([(f"i{i}", float(i)) for i in range(30)], "id string, v double")
    out = shuffled_values(df, "v", 3, id_cols=["id"]).collect()
    for run in range(3):
        assert sorted(r["v"] for r in out if r["iteration"] == run) == [float(i) for i in range(30)]


def test_rank_sum_exact_and_normal(spark, matrix):
    a, b = [5.5, 7.25, 9.0, 3.5], [1.5, 2.0, 6.0, 4.0, 0.25]
    expression, cells = matrix([[v] for v in a + b], ["g"], ["A"] * 4 + ["B"] * 5)
    labelled = ex.label_cells(cells, "cell_type")
    p = {r["group"]: r["pvalue"] for r in mk.rank_sum_pvalues(ex.attach_groups(expression, labelled), ex.group_sizes(labelled)).collect()}
    pooled = sorted(a + b)
    observed = sum(pooled.index(v) + 1 for v in a)
    sums = [sum(c) for c in itertools.combinations(range(1, 10), 4)]
    assert p["A"] == pytest.approx(sum(s >= observed for s in sums) / len(sums))
    # with ties: normal approximation with tie and continuity correction
    a, b = [0, 0, 2, 3, 3, 5, 1, 2, 2, 4], [0, 0, 0, 1, 1, 2, 0, 0, 3, 1]
    expression, cells = matrix([[v] for v in a + b], ["g"], ["A"] * 10 + ["B"] * 10)
    labelled = ex.label_cells(cells, "cell_type")
    p = {r["group"]: r["pvalue"] for r in mk.rank_sum_pvalues(ex.attach_groups(expression, labelled), ex.group_sizes(labelled)).collect()}
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    ties = sum(c**3 - c for c in np.unique(a + b, return_counts=True)[1])
    sd = math.sqrt(100 / 12 * (21 - ties / (20 * 19)))
    assert p["A"] == pytest.approx(0.5 * math.erfc((u - 50 - 0.5) / sd / math.sqrt(2)))


def test_bh_adjustment(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.2, 0.04]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(p)] + [("g", 9, None)], "k string, i int, pvalue double")
    got = {r["i"]: r["padj"] for r in mk.bh_adjust(df, ["k"]).collect()}
    order = np.argsort(p)
    adj = np.minimum.accumulate((np.array(p)[order] * 6 / np.arange(1, 7))[::-1])[::-1]
    for place, i in enumerate(order):
        assert got[int(i)] == pytest.approx(min(adj[place], 1.0))
    assert got[9] is None


def test_option_errors(spark, matrix, core_lr):
    expression, cells = matrix(VALUES, GENES, list("AABBCC"))
    bad = [{"min_pct": 2}, {"aggregate": "mode"}, {"trim": 0.5}, {"score_method": "x"}, {"downsample_repeats": 0}, {"layer": "a", "use_raw": True}, {"n_permutations": -1}]
    for options in bad:
        with pytest.raises(ValueError):
            compute_communication(expression, cells, core_lr, "cell_type", **options)
    with pytest.raises(KeyError):
        compute_communication(expression, cells, core_lr, "nope")
    with pytest.raises(ValueError, match="At least two"):
        compute_communication(expression, cells.where("cell_type = 'A'"), core_lr, "cell_type")
