"""Distances, kernels, nulls, selection, ranking, patterns against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcomm.model import CommResult
from sparkcomm.operators import candidates as ca
from sparkcomm.operators import nulls as nl
from sparkcomm.operators import diff as df
from sparkcomm.operators import patterns as pt
from sparkcomm.operators import ranking as rk
from sparkcomm.operators import spatial as sp
from sparkcomm.operators import training as tr
from sparkcomm.operators.resample import stratified_sample
from sparkcomm.plans.dbfree import compute_dbfree_communication
from sparkcomm.plans.validation import validate_spatial_lr_table


def clumped(n=400, seed=0):
    rng = np.random.default_rng(seed)
    clump = rng.normal(size=(n // 2, 2)) * 0.01 + 5
    wide = rng.uniform(-50, 50, size=(n // 2, 2))
    copies = np.repeat([[3.0, 3.0]], 20, axis=0)
    return np.concatenate([clump, wide, copies])


@pytest.fixture
def points(spark):
    xy = clumped()
    rows = [(f"c{i}", "ABC"[i % 3], float(x), float(y)) for i, (x, y) in enumerate(xy)]
    return xy, spark.createDataFrame(rows, "cell_id string, group string, x double, y double")


def test_nearest_distance_in_a_clump(spark, points):
    xy, cells = points
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = float(np.median(d.min(1)))
    assert sp.resolve_radius(cells).first()["radius"] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("reach", [0.02, 4.0])
def test_pairs_of_a_crowded_grid_cell(spark, points, reach):
    xy, cells = points
    spots = np.unique(xy, axis=0)
    d = np.sqrt(((spots[:, None] - spots[None]) ** 2).sum(-1))
    got = sp.location_pairs(cells, reach, crowd=25)
    assert got.count() == int((d <= reach).sum())
    assert got.select("xa", "ya", "xb", "yb").distinct().count() == got.count()


def test_kernel_weights(spark, points):
    xy, cells = points
    g = np.array(["ABC"[i % 3] for i in range(len(xy))])
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    got = {(r["source"], r["target"], r["kernel"]): r["spatial_weight"] for r in sp.spatial_weights(cells, radius=3.0, sigma=0.7).collect()}
    for s in "ABC":
        for t in "ABC":
            block = d[np.ix_(g == s, g == t)]
            assert got[s, t, "contact"] == pytest.approx((block <= 3.0).mean())
            assert got[s, t, "exp"] == pytest.approx(np.exp(-block / 0.7).mean(), abs=1e-11)


def test_stratified_sample_fills_up(spark, points):
    _, cells = points
    assert stratified_sample(cells, 50).count() == 50
    assert stratified_sample(cells, 10_000).count() == cells.count()


def test_validation_report_on_four_cells(spark, matrix):
    expression, cells = matrix(
        [[5, 0, 2, 1], [4, 0, 2, 1], [0, 3, 1, 2], [0, 4, 1, 2]], ["L1", "R1", "L2", "R2"], list("AABB"), section=["s1", "s2", "s1", "s2"], x=[0.0, 0, 1, 1], y=[0.0, 1, 0, 1]
    )
    lr = spark.createDataFrame(
        [("L1", "R1", "P", 0.9, 0.8, 0.7, 0.9), ("L2", "R2", "P", 0.4, 0.3, 0.2, 0.1)],
        "ligand string, receptor string, pathway string, model_score double, ligand_role_score double, receptor_role_score double, ligand_secreted_like_score double",
    )
    curated = spark.createDataFrame([("L1", "R1")], "ligand string, receptor string")
    report = validate_spatial_lr_table(expression, cells, lr, groupby="cell_type", n_permutations=3, section_key="section", section_top_k=1, curated_lr_table=curated, top_k=(1, 2))
    assert report.metadata["radius"] == pytest.approx(1.0)
    rows = report.summary.collect()
    assert len(rows) == 4 and all(0 < r["empirical_pvalue"] <= 1 for r in rows)
    assert report.celltype_pair_summary.count() == 2 * 2 * 2 * 2
    assert report.null_distribution.count() == 3 * 4 * 2 * 2 * 2
    assert report.distance_decay.count() > 0 and report.section_reproducibility.count() == 4
    assert report.role_kernel_enrichment.count() == 2 and report.curated_overlap_enrichment.count() == 4
    top = report.top_k_enrichment.where("null_model = 'pooled' AND k = 1 AND score_type = 'spatial_ccc_score'")
    assert top.count() == 2


def greedy(edges, cap_l, cap_r):
    left, right, out = {}, {}, []
    for s, l, r in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if left.get(l, 0) < cap_l and right.get(r, 0) < cap_r:
            left[l], right[r] = left.get(l, 0) + 1, right.get(r, 0) + 1
            out.append((l, r))
    return out


@pytest.mark.parametrize("band", [200_000, 60])  # one band, and several
def test_banded_greedy_equals_the_sequential_pass(spark, monkeypatch, band):
    monkeypatch.setattr(ca, "BAND", band)
    rnd = random.Random(3)
    edges = [(round(rnd.random(), 2), f"l{i}", f"r{j}") for i in range(14) for j in range(11) if rnd.random() < 0.7]
    edges += [(0.5, "hub", f"r{j}") for j in range(11)]
    data = spark.createDataFrame(edges, "model_score double, ligand_gene string, receptor_gene string")
    order = [F.desc("model_score"), F.col("ligand_gene"), F.col("receptor_gene")]
    got = ca.greedy_degree_capped(data, ligand_cap=2, receptor_cap=3, order=order)
    want = greedy(edges, 2, 3)
    assert sorted((r["ligand_gene"], r["receptor_gene"]) for r in got.collect()) == sorted(want)
    few = ca.greedy_degree_capped(data, ligand_cap=2, receptor_cap=3, order=order, enough=4).orderBy(*order).limit(4)
    assert [(r["ligand_gene"], r["receptor_gene"]) for r in few.collect()] == want[:4]


def test_a_null_equal_to_the_observed_counts_at_any_scale(spark):
    """Sums of the same terms differ in their last bits only; rows without nulls stand among those of their kernel."""
    big = 1e5 + 0.1
    summary = spark.createDataFrame([("a", "b", "exp", big, 2.0), ("c", "d", "exp", big, 1.0), ("e", "f", "exp", 5.0, 9.0)], "ligand string, receptor string, kernel string, spatial_ccc_score double, model_weighted_spatial_ccc_score double")
    rows = [("a", "b", "exp", "spatial_ccc_score", big * (1 - 1e-14)) for _ in range(4)] + [("a", "b", "exp", "model_weighted_spatial_ccc_score", v) for v in (1.0, 2.0, 2.0 - 1e-12, 3.0)]
    null = spark.createDataFrame(rows, "ligand string, receptor string, kernel string, score_type string, score_value double")
    got = {r["ligand"]: (r["empirical_pvalue"], r["model_weighted_empirical_pvalue"]) for r in nl.attach_null_stats(summary, null).collect()}
    assert got == {"a": (1.0, 0.8), "c": (1.0, 1.0), "e": (1.0, 0.2)}


def test_density_target_and_prior(spark):
    train = spark.createDataFrame(
        [("human", "mammal", "L1", "R1", "A"), ("human", "mammal", "L2", "R2", "A"), ("mouse", "mammal", "L1", "R1", "B")], "species string, clade string, ligand_gene string, receptor_gene string, resource string"
    )
    prior = ca.estimate_lr_density_prior(train, min_species_edges=1)
    scores = spark.createDataFrame([("L1", "R1", 0.9), ("L2", "R2", 0.8), ("L3", "R3", 0.1)], "ligand_gene string, receptor_gene string, model_score double")
    table = ca.build_predicted_lr_table(scores, density_prior=prior, species_hint="mammal", max_pairs=10)
    s = table.metadata["prediction_summary"].first()
    assert (s["candidate_grid_size"], s["target_pair_count"], s["selected_pair_count"]) == (9, 7, 2)
    assert s["warning"] == "density_target_not_reached"
    checked = ca.evaluate_predicted_lr_density_prior(table.metadata["prediction_summary"], max_fold_error=10.0)
    assert checked.first()["passed"]
    two = spark.createDataFrame([("mammal", 0.2), ("plant", 0.6)], "clade string, density_prior double")
    row = ca.resolve_density_prior(two, species_hint="fungus").first()
    assert row["density_prior"] == pytest.approx(0.4) and row["density_mode"] == "table_fallback_median"
    assert ca.resolve_density_prior("auto", spark=spark).first()["density_prior"] == 0.01


def test_ranking_metrics_against_definitions(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.random(200), 2)
    rows = spark.createDataFrame([("f", i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "fold string, id int, label int, score double")
    got = rk.curve_metrics(rows, ["fold"]).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap = 0.0
    for t in sorted(set(s), reverse=True):
        ap += (y[s == t].sum() / y.sum()) * y[s >= t].mean()
    assert got["roc_auc"] == pytest.approx(auc) and got["pr_auc"] == pytest.approx(ap)


def test_pair_features_reduce_long_vectors(spark):
    rng = np.random.default_rng(2)
    emb = spark.createDataFrame([(f"g{i}", [float(v) for v in rng.normal(size=8)], 10 + i) for i in range(12)], "gene_id string, embedding array<float>, sequence_length int")
    pairs = spark.createDataFrame([(f"g{i}", f"g{i + 6}", i % 2) for i in range(6)], "ligand_gene string, receptor_gene string, label int")
    pca = ca.fit_pair_pca(pairs, emb, k=3)
    out = ca.make_lr_pair_features(pairs, emb, pca=pca).first()
    assert len(out["feature_array"]) == 4 * 3 + 6
    assert out["feature_array"][-4] == pytest.approx(math.log1p(10 + int(out["ligand_gene"][1:])))
    with pytest.raises(ValueError, match="Missing"):
        ca.make_lr_pair_features(pairs.withColumn("ligand_gene", F.lit("nobody")), emb)


def test_negatives_avoid_positives_and_families(spark):
    rows = [("sp", "res", f"l{i}", f"r{(i * 3 + k) % 9}", f"F{i % 3}" if i else "", f"G{(i * 3 + k) % 9 % 4}") for i in range(9) for k in range(2)]
    inter = spark.createDataFrame(rows, "species string, resource string, ligand_gene string, receptor_gene string, ligand_family string, receptor_family string")
    emb = spark.createDataFrame([("sp", f"b{i}") for i in range(5)] + [("sp", "l1")], "species string, gene_id string")
    pairs = tr.training_pairs(inter, embeddings=emb, negative_ratio=1, easy_negative_fraction=0.2).collect()
    known = {(r[2], r[3]) for r in rows}
    fams = {(r[4], r[5]) for r in rows if r[4] and r[5]}
    neg = [r for r in pairs if r["label"] == 0]
    assert neg and all((r["ligand_gene"], r["receptor_gene"]) not in known for r in neg)
    assert all((r["ligand_family"], r["receptor_family"]) not in fams for r in neg if not r["easy_negative"])
    easy = [r for r in neg if r["easy_negative"]]
    assert len(easy) == 4 and all(r["ligand_gene"][0] == "b" and r["ligand_gene"] != r["receptor_gene"] for r in easy)


def make_result(spark, rows, groups="AB"):
    inter = spark.createDataFrame(rows, "source string, target string, ligand string, receptor string, pathway string, prob double")
    return CommResult(inter, spark.createDataFrame([(g,) for g in groups], "group string"))


def test_comparison_of_results(spark):
    a = make_result(spark, [("A", "B", "L", "R", "P", 2.0), ("A", "A", "L", "R", "P", 1.0)])
    b = make_result(spark, [("A", "B", "L", "R", "P", 0.5), ("B", "A", "L", "R", "Q", 1.0)])
    d = df.compare_communication(a, b, label_a="new", label_b="old")
    rows = {(r["source"], r["target"]): r for r in d.interactions.collect()}
    assert rows["A", "B"]["delta_prob"] == 1.5 and rows["A", "A"]["is_new"] and rows["B", "A"]["is_lost"] and rows["B", "A"]["direction"] == "old"
    assert rows["A", "B"]["percent_change"] == pytest.approx(3.0)
    with pytest.raises(ValueError):
        df.compare_communication(a, make_result(spark, [("A", "B", "L", "R", "P", 0.5)], "ABC"))
    flow = {r["pathway"]: r for r in df.information_flow(d).collect()}
    assert flow["P"]["flow_b"] == pytest.approx(-1 / math.log(0.5)) and flow["P"]["flow_a"] == pytest.approx(1.1)


def test_embedding_keeps_distances_and_clusters_split_blocks(spark):
    rows = []
    for p, (s, t) in {"P1": ("A", "B"), "P2": ("A", "B"), "P3": ("B", "A"), "P4": ("B", "A")}.items():
        rows += [(s, t, "L" + p, "R", p, 3.0), ("A", "A", "L" + p, "R", p, 0.2 + 0.1 * int(p[1]))]
    result = make_result(spark, rows)
    sim = {(r[0], r[1]): r[2] for r in pt.compute_pathway_similarity(result).collect()}
    at = {r["pathway"]: np.array([r["dim1"], r["dim2"]]) for r in pt.compute_pathway_embedding(result).collect()}
    for a in at:
        for b in at:
            assert np.linalg.norm(at[a] - at[b]) == pytest.approx(math.sqrt(max(2 - 2 * sim[a, b], 0)), abs=5e-2)
    for method in ("spectral", "kmeans"):
        c = {r["pathway"]: r["cluster"] for r in pt.compute_pathway_clusters(result, method=method, n_clusters=2).collect()}
        assert c["P1"] == c["P2"] != c["P3"] == c["P4"]


def test_rank_one_pattern_is_recovered(spark):
    rows = [(s, "A", "L", "R", p, w * v) for s, w in (("A", 1.0), ("B", 3.0)) for p, v in (("P", 2.0), ("Q", 0.5), ("S", 1.0))]
    out = pt.compute_communication_patterns(make_result(spark, rows), n_patterns=1)
    assert out.reconstruction_error.first()[0] == pytest.approx(0.0, abs=1e-3)


def test_recommended_pattern_number(spark):
    sel = spark.createDataFrame([(2, 1.0, 0.9), (3, 0.3, 0.95), (4, 0.25, 0.95), (5, 0.2, 0.5)], "k int, mean_reconstruction_error double, stability double")
    assert pt.recommended_k(sel).first()["k"] == 3
    assert pt.recommended_k(sel.where("k < 4")).first()["k"] == 3


def test_one_call_from_proteins_to_communication(spark, matrix):
    expression, cells = matrix([[5, 1, 0], [4, 0, 0], [0, 2, 3], [0, 1, 6]], ["LIG", "REC", "OTH"], list("AABB"))
    proteins = spark.createDataFrame([(g, g) for g in ("LIG", "REC", "OTH")], "gene_id string, protein_id string")
    emb = spark.createDataFrame([("LIG", [1.0, 0.0]), ("REC", [0.9, 0.1]), ("OTH", [0.0, 1.0])], "gene_id string, embedding array<double>")
    one = lambda g: spark.createDataFrame([(x,) for x in g], "gene_id string")
    options = {"role_models": None, "ligand_candidates": one(["LIG"]), "receptor_candidates": one(["REC", "OTH"]), "density_prior": 0.5}
    with pytest.raises(ValueError, match="allow_fixture_models"):
        compute_dbfree_communication(expression, cells, "cell_type", proteins, emb, prediction=options)
    result, table = compute_dbfree_communication(expression, cells, "cell_type", proteins, emb, prediction={**options, "allow_fixture_models": True}, aggregate="mean")
    best = table.interactions.first()
    assert (best["ligand"], best["receptor"], best["density_rank"]) == ("LIG", "REC", 1)
    assert "explicit_candidate_role_bypass" in best["warning"]
    assert result.interactions.where("source = 'A'").count() > 0
