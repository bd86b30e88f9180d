"""Candidates, scores, densities, training pairs, folds and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkcomm.operators.saved_models import load_pair_model
from sparkcomm.session import shared_folder
from sparkcomm.functions.hashing import hash_unit
from sparkcomm.operators import candidates as ca
from sparkcomm.operators import ranking as rk
from sparkcomm.operators import training as tr
from sparkcomm.plans.dbfree import predict_lr_dbfree

from . import roles as r
from .resource_queries import SUP, TRAIN, training

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf: r.rounded(fn(spark, sf))
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# --- parts as genes with the vectors of the embeddings table ------------------------------

def embeddings(spark, sf):
    return r.read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("gene_id"), F.col("embedding"), F.col("label"))


def _roles(spark, sf):
    part = lambda i: F.round(F.least(F.greatest(F.element_at("embedding", i).cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)), 6)
    return embeddings(spark, sf).select(
        "gene_id", F.col("gene_id").alias("protein_id"), part(1).alias("ligand_like_score"), part(2).alias("receptor_like_score"), part(3).alias("secreted_like_score"), part(4).alias("membrane_like_score"))


def roles_(spark, sf):
    return r.once(spark, sf, "roles", lambda: _roles(spark, sf))


def part_expression(spark, sf):
    return r.once(spark, sf, "part expression", lambda: r.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("cell_id"), F.col("l_partkey").cast("string").alias("gene")).agg(F.sum("l_quantity").alias("value")))


def part_cells(spark, sf):
    return r.read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("cell_id"))


def _c(i: int) -> str:
    return f"round(LEAST(GREATEST(CAST(embedding[{i}] AS DOUBLE) + 0.5, 0), 1), 6)"


EMB = f"""emb AS (SELECT CAST(vec_id AS VARCHAR) AS g, CAST(embedding AS DOUBLE[]) AS e, label, {_c(1)} AS l, {_c(2)} AS rr, {_c(3)} AS sec, {_c(4)} AS mem FROM embeddings),
fr AS (SELECT CAST(l_partkey AS VARCHAR) AS g, COUNT(DISTINCT l_orderkey) / (SELECT COUNT(*) * 1.0 FROM orders) AS f FROM lineitem GROUP BY 1),
rt AS (SELECT emb.*, f FROM emb JOIN fr USING (g) WHERE f >= 0.00001),
lig AS (SELECT *, ROW_NUMBER() OVER (ORDER BY l DESC, f DESC, g) AS p FROM rt WHERE l >= 0.5),
rec AS (SELECT *, ROW_NUMBER() OVER (ORDER BY rr DESC, f DESC, g) AS p FROM rt WHERE rr >= 0.5)"""
CROSS = """cx AS (SELECT a.g AS ligand_gene, b.g AS receptor_gene, a.l AS ligand_role_score, b.rr AS receptor_role_score, b.mem AS receptor_membrane_like_score, a.f AS ligand_expression_fraction FROM lig a JOIN rec b ON a.g <> b.g)"""
NEAR = """nn AS (SELECT a.g AS ligand_gene, b.g AS receptor_gene, list_cosine_similarity(a.e, b.e) AS cos, ROW_NUMBER() OVER (PARTITION BY a.g ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.g) AS p FROM lig a CROSS JOIN rec b),
nt AS (SELECT ligand_gene, receptor_gene, cos FROM nn WHERE p <= 5 AND ligand_gene <> receptor_gene)"""


def _tops(spark, sf):
    table = r.once(spark, sf, "role table", lambda: ca.role_table(roles_(spark, sf), roles_(spark, sf), ca.expressed_gene_fractions(part_expression(spark, sf), part_cells(spark, sf)), 0.00001))
    lig = r.once(spark, sf, "top ligands", lambda: ca.top_candidates(table, "ligand", role_min=0.5))
    rec = r.once(spark, sf, "top receptors", lambda: ca.top_candidates(table, "receptor", role_min=0.5))
    return lig, rec


@query("m1_expressed_fractions", "SELECT CAST(l_partkey AS VARCHAR) AS gene_id, round(COUNT(DISTINCT l_orderkey) / (SELECT COUNT(*) * 1.0 FROM orders), 6) AS expression_fraction FROM lineitem GROUP BY 1")
def _(spark, sf):
    return ca.expressed_gene_fractions(part_expression(spark, sf), part_cells(spark, sf))


@query("m2_m3_top_candidates", r.with_sql(EMB) + "SELECT g AS gene_id, round(l, 6) AS score, round(f, 6) AS expression_fraction, p AS place FROM lig UNION ALL SELECT g, round(rr, 6), round(f, 6), p FROM rec")
def _(spark, sf):
    lig, rec = _tops(spark, sf)
    cols = lambda d, c: d.select("gene_id", F.col(c).alias("score"), "expression_fraction", F.col("place").cast("bigint"))
    return cols(lig, "ligand_like_score").unionByName(cols(rec, "receptor_like_score"))


@query("m4_cross_product", r.with_sql(EMB, CROSS) + "SELECT ligand_gene, receptor_gene, round(ligand_role_score, 6) AS ligand_role_score, round(receptor_role_score, 6) AS receptor_role_score, round(receptor_membrane_like_score, 6) AS receptor_membrane_like_score, round(ligand_expression_fraction, 6) AS ligand_expression_fraction FROM cx")
def _(spark, sf):
    out = ca.candidate_cross_product(*_tops(spark, sf))
    return out.select("ligand_gene", "receptor_gene", "ligand_role_score", "receptor_role_score", "receptor_membrane_like_score", "ligand_expression_fraction")


@query("m5_nearest_neighbors", r.with_sql(EMB, NEAR) + "SELECT ligand_gene, receptor_gene, round(cos, 6) AS embedding_cosine FROM nt")
def _(spark, sf):
    return ca.nearest_neighbor_candidates(*_tops(spark, sf), embeddings(spark, sf), per_ligand=5).select("ligand_gene", "receptor_gene", "embedding_cosine")


def candidates(spark, sf):
    return r.once(spark, sf, "candidates", lambda: ca.generate_lr_candidates(
        part_expression(spark, sf), part_cells(spark, sf), roles_(spark, sf), roles_(spark, sf), embeddings=embeddings(spark, sf), expression_min_fraction=0.00001, ligand_role_min=0.5, receptor_role_min=0.5,
        nearest_neighbor_pairs=None, nearest_neighbors_per_ligand=5, allow_empty=True), write=False)  # a square: made where it is read


CAND = """cand AS (SELECT ligand_gene, receptor_gene, string_agg(s, ';' ORDER BY o) AS candidate_strategy, MAX(cos) AS cos FROM (SELECT ligand_gene, receptor_gene, 0 AS o, 'role_expression_cross_product' AS s, NULL AS cos FROM cx
  UNION ALL SELECT ligand_gene, receptor_gene, 1, 'embedding_nearest_neighbor', cos FROM nt) GROUP BY 1, 2)"""


@query("m6_candidates", r.with_sql(EMB, CROSS, NEAR, CAND) + "SELECT ligand_gene, receptor_gene, candidate_strategy, round(cos, 6) AS embedding_cosine FROM cand")
def _(spark, sf):
    return candidates(spark, sf).select("ligand_gene", "receptor_gene", "candidate_strategy", "embedding_cosine")


@query("m7_pair_features", r.with_sql(EMB, CROSS, NEAR, CAND) + """SELECT ligand_gene, receptor_gene, 262 AS n_features, round(list_cosine_similarity(a.e, b.e), 6) AS cosine, round(list_distance(a.e, b.e), 6) AS euclidean, round(list_dot_product(a.e, b.e), 6) AS hadamard_sum
FROM cand JOIN emb a ON a.g = ligand_gene JOIN emb b ON b.g = receptor_gene""")
def _(spark, sf):
    f = ca.make_lr_pair_features(candidates(spark, sf), embeddings(spark, sf), check=False)
    had = F.aggregate(F.slice("feature_array", 193, 64), F.lit(0.0), lambda s, x: s + x)
    return f.select("ligand_gene", "receptor_gene", F.size("feature_array").alias("n_features"), "cosine", F.element_at("feature_array", 258).alias("euclidean"), had.alias("hadamard_sum"))


@query("m8_heuristic_scores", r.with_sql(EMB, CROSS, NEAR, CAND) + """SELECT ligand_gene, receptor_gene, round(LEAST(GREATEST(0.35 * (list_cosine_similarity(a.e, b.e) + 1) / 2 + 0.325 * a.l + 0.325 * b.rr, 0), 1), 6) AS model_score, 'heuristic_pair_ranker' AS warning
FROM cand JOIN emb a ON a.g = ligand_gene JOIN emb b ON b.g = receptor_gene""")
def _(spark, sf):
    return ca.score_lr_candidates(candidates(spark, sf), embeddings(spark, sf)).select("ligand_gene", "receptor_gene", "model_score", "warning")


@query("m10_nearest_reference", r.with_sql(EMB) + """, d AS (SELECT a.g, a.label, b.g AS ref, list_distance(a.e, b.e) AS d, ROW_NUMBER() OVER (PARTITION BY a.g ORDER BY list_distance(a.e, b.e), b.g) AS p FROM emb a JOIN emb b ON b.label = 3)
SELECT g AS ligand_gene, ref || '->3' AS nearest_reference_lr, round(d, 6) AS nearest_reference_distance FROM d WHERE p = 1""")
def _(spark, sf):
    rows = embeddings(spark, sf).select(F.col("gene_id").alias("ligand_gene"), F.col("label").cast("string").alias("receptor_gene"), F.col("embedding").cast("array<double>").alias("feature_array"))
    out = ca.nearest_reference(rows, rows.where("receptor_gene = '3'"))
    return out.select("ligand_gene", "nearest_reference_lr", "nearest_reference_distance")


DENS = """pe AS (SELECT DISTINCT species, ligand_gene, receptor_gene FROM train), sd AS (SELECT species, COUNT(*) AS edges, COUNT(*) / (COUNT(DISTINCT ligand_gene) * COUNT(DISTINCT receptor_gene) * 1.0) AS d FROM pe GROUP BY 1),
sc AS (SELECT sd.*, (SELECT MIN(clade) FROM train t WHERE t.species = sd.species) AS clade FROM sd WHERE edges >= 149 OR NOT EXISTS (SELECT 1 FROM sd z WHERE z.edges >= 149)),
dp AS (SELECT clade, median(d) AS density_prior, string_agg(species, ';' ORDER BY species) AS density_source_species, COUNT(*) AS n_species FROM sc GROUP BY 1)"""


def prior(spark, sf):
    return r.once(spark, sf, "prior", lambda: ca.estimate_lr_density_prior(training(spark, sf), min_species_edges=149))


@query("m11_density_prior", r.with_sql(SUP, TRAIN, DENS) + "SELECT clade, round(density_prior, 6) AS density_prior, density_source_species, n_species FROM dp")
def _(spark, sf):
    return prior(spark, sf).select("clade", "density_prior", "density_source_species", "n_species")


@query("m12_resolve_prior", r.with_sql(SUP, TRAIN, DENS) + "SELECT 'hit' AS case, round(density_prior, 6) AS density_prior, 'table' AS density_mode FROM dp WHERE clade = (SELECT MIN(clade) FROM dp) UNION ALL SELECT 'miss', round(median(density_prior), 6), 'table_fallback_median' FROM dp")
def _(spark, sf):
    p = prior(spark, sf)
    first = p.agg(F.min("clade")).first()[0]
    a = ca.resolve_density_prior(p, species_hint=first).withColumn("case", F.lit("hit"))
    b = ca.resolve_density_prior(p, species_hint="no such clade").withColumn("case", F.lit("miss"))
    return a.unionByName(b).select("case", "density_prior", "density_mode")


@query("m13_predicted_lr")
def _(spark, sf):
    scored = ca.score_lr_candidates(candidates(spark, sf), embeddings(spark, sf))
    table = ca.build_predicted_lr_table(scored, density_prior=0.05, max_pairs_per_ligand=3, max_pairs_per_receptor=4, model_name="heuristic_fixture", allow_empty=True)
    return table.interactions.select("ligand", "receptor", "model_score", "density_rank", "candidate_strategy", "warning")


@query("m14_density_check", r.with_sql(SUP, TRAIN, DENS) + """SELECT round(dp.density_prior, 6) AS density_prior, round(sc.d, 6) AS achieved_density, round(sc.d - dp.density_prior, 6) AS density_delta, round(sc.d / dp.density_prior, 6) AS density_ratio,
 (abs(sc.d - dp.density_prior) <= 0.0001 OR GREATEST(sc.d / dp.density_prior, dp.density_prior / sc.d) <= 1.001) AS passed FROM sc JOIN dp USING (clade)""")
def _(spark, sf):
    t = training(spark, sf)
    pairs = t.select("species", "ligand_gene", "receptor_gene").distinct()
    per = pairs.groupBy("species").agg(F.count(F.lit(1)).alias("selected_pair_count"), F.count_distinct("ligand_gene").alias("candidate_ligand_count"), F.count_distinct("receptor_gene").alias("candidate_receptor_count"))
    per = per.withColumn("_any", per.agg(F.max(F.col("selected_pair_count") >= 149)).scalar()).where("NOT _any OR selected_pair_count >= 149").join(t.select("species", "clade").distinct(), "species")
    summary = per.join(prior(spark, sf).select("clade", "density_prior"), "clade")
    return ca.evaluate_predicted_lr_density_prior(summary, max_abs_delta=0.0001, max_fold_error=1.001).select("density_prior", "achieved_density", "density_delta", "density_ratio", "passed")


@query("m15_predict_and_select")
def _(spark, sf):
    table = predict_lr_dbfree(
        part_expression(spark, sf), part_cells(spark, sf), roles_(spark, sf), embeddings(spark, sf), role_models=None, allow_fixture_models=True,
        ligand_candidates=roles_(spark, sf).where("ligand_like_score >= 0.6").select("gene_id"), receptor_candidates=roles_(spark, sf).where("receptor_like_score >= 0.6").select("gene_id"),
        density_prior=0.1, expression_min_fraction=0.00001, allow_empty=True)
    return table.interactions.select("ligand", "receptor", "model_score", "density_rank", "warning")


# --- N: which supplier ships which part ---------------------------------------------------

def _bulk(spark, sf):
    l = r.read(spark, sf, "lineitem").join(r.read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(r.read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    l = l.join(r.read(spark, sf, "embeddings").select(F.col("vec_id").alias("l_partkey")), "l_partkey", "left_semi").join(r.read(spark, sf, "embeddings").select(F.col("vec_id").alias("l_suppkey")), "l_suppkey", "left_semi")
    u = lambda tag, c: F.round(hash_unit(F.lit(tag), F.col(c)), 3)
    return l.select(
        F.col("l_returnflag").alias("species"), F.col("p_type").alias("clade"), F.concat_ws(";", F.lit("db"), F.concat(F.lit("line "), F.col("l_linestatus"))).alias("resource"),
        F.col("l_partkey").cast("string").alias("ligand_gene"), F.col("l_suppkey").cast("string").alias("receptor_gene"), F.col("p_brand").alias("ligand_family"), F.concat(F.lit("n"), "s_nationkey").alias("receptor_family"),
        u("role", "l_partkey").alias("ligand_role_score"), u("role", "l_suppkey").alias("receptor_role_score"), u("expr", "l_partkey").alias("ligand_expression_fraction"), u("expr", "l_suppkey").alias("receptor_expression_fraction"),
    ).withColumn("clade", F.lit("c")).distinct()


def bulk(spark, sf):
    return r.once(spark, sf, "bulk", lambda: _bulk(spark, sf))


def species_embeddings(spark, sf):
    """The vectors once per species, and again under names that no pair has: background genes are looked for per species."""
    unseen = embeddings(spark, sf).withColumn("gene_id", F.concat(F.lit("unseen "), "gene_id"))
    return embeddings(spark, sf).unionByName(unseen).join(bulk(spark, sf).select("species").distinct())


def pairs(spark, sf):
    return r.once(spark, sf, "training pairs", lambda: tr.training_pairs(bulk(spark, sf), embeddings=species_embeddings(spark, sf), negative_ratio=2, easy_negative_fraction=0.1, excluded_homology_radius="none", seed=4))


def _u(tag: str, c: str) -> str:
    return f"round({r.hash_unit_sql(repr(tag), f'CAST({c} AS VARCHAR)')}, 3)"


BULK = f"""bulk AS (SELECT DISTINCT l_returnflag AS species, 'c' AS clade, 'db;line ' || l_linestatus AS resource, CAST(l_partkey AS VARCHAR) AS lg, CAST(l_suppkey AS VARCHAR) AS rg, p_brand AS lf, 'n' || s_nationkey AS rf,
  {_u('role', 'l_partkey')} AS lr, {_u('role', 'l_suppkey')} AS rr, {_u('expr', 'l_partkey')} AS le, {_u('expr', 'l_suppkey')} AS re
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey IN (SELECT vec_id FROM embeddings) AND l_suppkey IN (SELECT vec_id FROM embeddings))"""


@query("n1_positive_pairs", r.with_sql(BULK) + "SELECT species, resource, lg AS ligand_gene, rg AS receptor_gene, lf AS ligand_family, rf AS receptor_family, CAST(lr AS VARCHAR) AS ligand_role_score FROM bulk")
def _(spark, sf):
    named = bulk(spark, sf).withColumnsRenamed({"ligand_family": "ligand_protein_family", "receptor_family": "homology_cluster"})
    named = named.withColumn("ligand_protein_family", F.col("ligand_protein_family"))
    return tr.positive_pairs(named).select("species", "resource", "ligand_gene", "receptor_gene", "ligand_family", "receptor_family", "ligand_role_score")


def _text_double(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


META_SQL = ["species", "'c'", "resource", "lg", "rg", "lf", "rf", _text_double("lr"), _text_double("rr"), _text_double("le"), _text_double("re"), "''", "''"]
_HASH = f"CAST('0x' || substr(md5('position' || '|' || concat_ws(chr(1), {', '.join(META_SQL)})), 1, 13) AS BIGINT)"
NEG = f"""num AS (SELECT species, lg, rg, ROW_NUMBER() OVER (PARTITION BY species ORDER BY {_HASH}, resource, lg, rg) - 1 AS pos FROM bulk),
cnt AS (SELECT species, COUNT(*) AS n FROM bulk GROUP BY 1),
plan AS (SELECT species, resource, COUNT(*) * 2 AS target, COUNT(*) * 2 - LEAST(CAST(ceil(COUNT(*) * 2 * 0.1) AS BIGINT), COUNT(*) * 2 - 1) AS hard FROM bulk GROUP BY 1, 2),
dr AS (SELECT species, resource, hard, unnest(generate_series(0, CAST(hard * 4 - 1 AS BIGINT))) AS t FROM plan),
dp AS (SELECT dr.*, floor({r.hash_unit_sql("'4'", "'ligand'", 'species', 'resource', 'CAST(t AS VARCHAR)')} * n) AS lp, floor({r.hash_unit_sql("'4'", "'receptor'", 'species', 'resource', 'CAST(t AS VARCHAR)')} * n) AS rp FROM dr JOIN cnt USING (species)),
dx AS (SELECT dp.species, resource, hard, t, a.lg, b.rg FROM dp JOIN num a ON a.species = dp.species AND a.pos = lp JOIN num b ON b.species = dp.species AND b.pos = rp WHERE a.lg <> b.rg AND NOT EXISTS (SELECT 1 FROM bulk z WHERE z.species = dp.species AND z.lg = a.lg AND z.rg = b.rg)),
neg AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY species, resource ORDER BY t) AS rn FROM dx) WHERE rn <= hard)"""


@query("n2_degree_matched_negatives", r.with_sql(BULK, NEG) + "SELECT species, resource, lg AS ligand_gene, rg AS receptor_gene, CAST(t AS BIGINT) AS draw FROM neg")
def _(spark, sf):
    out = pairs(spark, sf).where("label = 0 AND NOT easy_negative")
    return out.select("species", "resource", "ligand_gene", "receptor_gene", "draw")


@query("n3_easy_negatives", r.with_sql(BULK, NEG) + "SELECT species, resource, target - hard AS n, TRUE AS background FROM plan")
def _(spark, sf):
    ends = bulk(spark, sf).select("species", F.explode(F.array("ligand_gene", "receptor_gene")).alias("gene")).distinct()
    easy = pairs(spark, sf).where("easy_negative").select("species", "resource", "ligand_gene", "receptor_gene")
    for side in ("ligand", "receptor"):
        hit = ends.select("species", F.col("gene").alias(f"{side}_gene"), F.lit(1).alias(f"_{side}"))
        easy = easy.join(hit, ["species", f"{side}_gene"], "left")
    clean = F.max(F.coalesce("_ligand", F.lit(0)) + F.coalesce("_receptor", F.lit(0))) == 0
    return easy.groupBy("species", "resource").agg(F.count(F.lit(1)).alias("n"), clean.alias("background"))


@query("n4_sampling_summary", r.with_sql(BULK, NEG) + """SELECT species, COUNT(*) AS n_positive, (SELECT SUM(target) FROM plan p WHERE p.species = b.species) AS n_negative, (SELECT SUM(target - hard) FROM plan p WHERE p.species = b.species) AS easy_negative_count,
  'db;' || string_agg(DISTINCT substr(resource, 4), ';' ORDER BY substr(resource, 4)) AS positive_resource_blacklist_for_fold FROM bulk b GROUP BY 1""")
def _(spark, sf):
    return tr.negative_sampling_summary(pairs(spark, sf))


# folds and metrics over the positives and an independent label, so SQL can follow them
PSEUDO = f"""pz AS (SELECT *, CASE WHEN {r.hash_unit_sql("'lab'", 'lg', 'rg', 'species')} < 0.3 THEN 1 ELSE 0 END AS label, md5(concat_ws('|', species, resource, lg, rg)) AS id FROM bulk)"""


def labelled_pairs(spark, sf):
    def build():
        lab = F.when(hash_unit(F.lit("lab"), F.col("ligand_gene"), F.col("receptor_gene"), F.col("species")) < 0.3, 1).otherwise(0)
        return bulk(spark, sf).withColumns({"label": lab, "pair_id": F.md5(F.concat_ws("|", "species", "resource", "ligand_gene", "receptor_gene").cast("binary"))})

    return r.once(spark, sf, "labelled pairs", build)


SPLITS = ("leave_species_out", "leave_resource_out", "leave_family_out")
FOLD = """fold AS (SELECT 'leave_species_out' AS split, species AS fold, id FROM pz UNION ALL SELECT 'leave_resource_out', unnest(string_split(resource, ';')), id FROM pz
  UNION ALL SELECT 'leave_family_out', 'ligand:' || lf, id FROM pz UNION ALL SELECT 'leave_family_out', 'receptor:' || rf, id FROM pz)"""


def folds(spark, sf):
    return r.once(spark, sf, "folds", lambda: tr.fold_table(labelled_pairs(spark, sf), SPLITS))


@query("n9_fold_status", r.with_sql(BULK, PSEUDO, FOLD) + """, s AS (SELECT split, fold, COUNT(*) AS n_test, SUM(label) AS n_test_positive, (SELECT COUNT(*) FROM pz) - COUNT(*) AS n_train, (SELECT SUM(label) FROM pz) - SUM(label) AS n_train_positive FROM fold JOIN pz USING (id) GROUP BY 1, 2)
SELECT split, fold, n_test, CAST(n_test_positive AS BIGINT) AS n_test_positive, n_train, CAST(n_train_positive AS BIGINT) AS n_train_positive, CASE WHEN n_train > 0 AND n_train_positive > 0 AND n_train_positive < n_train AND n_test_positive > 0 AND n_test_positive < n_test THEN 'ok' ELSE 'skipped' END AS status FROM s""")
def _(spark, sf):
    return tr.fold_status(labelled_pairs(spark, sf), folds(spark, sf)).drop("reason")


@query("n9_random_split", r.with_sql(BULK, PSEUDO) + f"SELECT id AS pair_id FROM (SELECT id, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {r.hash_long_sql(repr('0'), repr('split'), 'id')}, id) AS rn, ceil(COUNT(*) OVER (PARTITION BY label) * 0.25) AS q FROM pz) WHERE rn <= q")
def _(spark, sf):
    return tr.fold_table(labelled_pairs(spark, sf), ["random_stratified"]).select("pair_id")


BASE = """deg AS (SELECT f.split, f.fold, p.id, p.label, p.lr, p.rr, p.le, p.re, ((SELECT COUNT(*) FROM pz z WHERE z.label = 1 AND z.lg = p.lg AND z.species <> f.fold) + 1) * ((SELECT COUNT(*) FROM pz z WHERE z.label = 1 AND z.rg = p.rg AND z.species <> f.fold) + 1) AS d,
  CASE WHEN EXISTS (SELECT 1 FROM pz z WHERE z.label = 1 AND z.lf = p.lf AND z.rf = p.rf AND z.species <> f.fold) THEN 1.0 ELSE 0.0 END AS tr FROM fold f JOIN pz p USING (id) WHERE f.split = 'leave_species_out'),
sco AS (SELECT split, fold, id, label, 'degree_prior' AS scorer, d / (MAX(d) OVER (PARTITION BY split, fold) * 1.0) AS score FROM deg UNION ALL SELECT split, fold, id, label, 'role_only', (lr + rr) / 2 FROM deg
  UNION ALL SELECT split, fold, id, label, 'expression_only', le * re FROM deg UNION ALL SELECT split, fold, id, label, 'family_pair_transfer', tr FROM deg)"""
CHECKED = ("degree_prior", "role_only", "expression_only", "family_pair_transfer")


def scores(spark, sf):
    def build():
        f = folds(spark, sf).where("split = 'leave_species_out'")
        return tr.baseline_scores(labelled_pairs(spark, sf), f, embeddings(spark, sf)).withColumn("score", F.col("score").cast("double"))

    return r.once(spark, sf, "baseline scores", build)


def checked(spark, sf):
    return scores(spark, sf).where(F.col("scorer").isin(list(CHECKED)))


@query("n11_baseline_scores", r.with_sql(BULK, PSEUDO, FOLD, BASE) + "SELECT fold, id AS pair_id, scorer, round(score, 6) AS score FROM sco")
def _(spark, sf):
    return checked(spark, sf).select("fold", "pair_id", "scorer", "score")


@query("n11_random_scorers", r.with_sql(BULK, PSEUDO, FOLD) + """SELECT fold, n, n_high FROM (SELECT fold, COUNT(*) AS n, CAST(LEAST(GREATEST(round_even((SELECT AVG(label) FROM pz z WHERE z.species <> f.fold) * COUNT(*), 0), 1), COUNT(*)) AS BIGINT) AS n_high FROM fold f WHERE split = 'leave_species_out' GROUP BY 1)""")
def _(spark, sf):
    rows = scores(spark, sf).where("scorer = 'density_matched_random'")
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 0.9).alias("n_high"))


METRICS = """st AS (SELECT fold, scorer, score, COUNT(*) AS n, SUM(label) AS p FROM sco GROUP BY 1, 2, 3),
cu AS (SELECT *, SUM(n) OVER w AS cn, SUM(p) OVER w AS cp FROM st WINDOW w AS (PARTITION BY fold, scorer ORDER BY score DESC)),
tt AS (SELECT fold, scorer, SUM(n) AS tn, SUM(p) AS tp FROM st GROUP BY 1, 2),
cv AS (SELECT fold, scorer, SUM(p * cp / (cn * 1.0)) / MIN(tp) AS pr_auc, SUM(p * ((tn - tp) - (cn - cp) + (n - p) / 2.0)) / (MIN(tp) * (MIN(tn) - MIN(tp))) AS roc_auc FROM cu JOIN tt USING (fold, scorer) GROUP BY 1, 2)"""


@query("n12_curve_metrics", r.with_sql(BULK, PSEUDO, FOLD, BASE, METRICS) + "SELECT fold, scorer, round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc FROM cv")
def _(spark, sf):
    return rk.curve_metrics(checked(spark, sf), ["fold", "scorer"]).select("fold", "scorer", "pr_auc", "roc_auc")


@query("n12_top_k_metrics", r.with_sql(BULK, PSEUDO, FOLD, BASE) + """, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY fold, scorer ORDER BY score DESC, id) AS rn, AVG(label) OVER (PARTITION BY fold, scorer) AS prev, SUM(label) OVER (PARTITION BY fold, scorer) AS pos FROM sco)
SELECT fold, scorer, CAST(kk AS BIGINT) AS k, round(AVG(label), 6) AS "precision", round(SUM(label) / MIN(pos), 6) AS recall, round(AVG(label) / MIN(prev), 6) AS enrichment FROM k JOIN (SELECT unnest([10, 100, 500]) AS kk) ON rn <= kk GROUP BY 1, 2, 3""")
def _(spark, sf):
    return rk.top_k_metrics(checked(spark, sf), ["fold", "scorer"], ids=["pair_id"], ks=(10, 100, 500))


def _metrics(spark, sf):
    def build():
        m = rk.metric_table(checked(spark, sf), ["split", "fold", "scorer"], ids=["pair_id"], ks=(100,))
        return m.withColumn("scorer", F.when(F.col("scorer") == "role_only", "model").otherwise(F.col("scorer")))

    return r.once(spark, sf, "metrics", build)


@query("n13_deltas_fold_means", r.with_sql(BULK, PSEUDO, FOLD, BASE, METRICS) + """SELECT 'leave_species_out' AS split, b.scorer AS baseline, round(AVG(m.pr_auc - b.pr_auc), 6) AS mean_delta, COUNT(*) AS n_usable_folds FROM cv b JOIN cv m ON m.fold = b.fold AND m.scorer = 'role_only' WHERE b.scorer <> 'role_only' GROUP BY 2""")
def _(spark, sf):
    d = rk.model_deltas(_metrics(spark, sf)).where("metric = 'pr_auc'").select("split", "fold", "baseline", "delta")
    return rk.fold_means(d, ["delta"])


@query("n10_repeat_summary", r.with_sql(BULK, PSEUDO, FOLD, BASE, METRICS) + "SELECT scorer, COUNT(*) AS n_usable_repeats, round(AVG(roc_auc), 6) AS mean, round(stddev_samp(roc_auc), 6) AS std, round(var_samp(roc_auc), 6) AS variance FROM cv GROUP BY 1")
def _(spark, sf):
    m = rk.curve_metrics(checked(spark, sf), ["fold", "scorer"]).select("scorer", F.col("roc_auc").alias("value"))
    return rk.repeat_summary(m, keys=["scorer"])


@query("n14_family_failures", r.with_sql(BULK, PSEUDO) + """, f AS (SELECT lf, rf, COUNT(*) AS n_pairs, SUM(label) AS np, COUNT(*) FILTER (WHERE label = 0) AS nn, AVG((lr + rr) / 2) AS mean_score, MAX((lr + rr) / 2) FILTER (WHERE label = 0) AS mx, MIN((lr + rr) / 2) FILTER (WHERE label = 1) AS mn FROM pz GROUP BY 1, 2)
SELECT lf AS ligand_family, rf AS receptor_family, n_pairs, CAST(np AS BIGINT) AS n_positive, nn AS n_pseudo_negative, round(mean_score, 6) AS mean_score, round(GREATEST(COALESCE(mx, 0), COALESCE(1 - mn, 0)), 6) AS failure_score FROM f
ORDER BY GREATEST(COALESCE(mx, 0), COALESCE(1 - mn, 0)) DESC, n_pairs DESC, lf, rf LIMIT 10""")
def _(spark, sf):
    rows = labelled_pairs(spark, sf).withColumn("score", (F.col("ligand_role_score") + F.col("receptor_role_score")) / 2)
    return rk.family_failure_cases(rows).select("ligand_family", "receptor_family", "n_pairs", "n_positive", "n_pseudo_negative", "mean_score", "failure_score")


@query("n15_quality_gates", r.with_sql(BULK, PSEUDO, FOLD, BASE, METRICS) + """, a AS (SELECT scorer, AVG(pr_auc) AS v FROM cv GROUP BY 1), m AS (SELECT v AS mv FROM a WHERE scorer = 'role_only')
SELECT 'leave_species_out' AS split, scorer AS baseline, round(mv - v, 6) AS delta_pr_auc, mv - v >= 0 AS passed, CASE WHEN mv - v >= 0 THEN 'ok' ELSE 'PR-AUC below threshold' END AS reason FROM a, m WHERE scorer <> 'role_only'
UNION ALL SELECT 'leave_species_out', 'random', NULL, FALSE, 'missing baseline' UNION ALL SELECT 'leave_clade_out', '', NULL, FALSE, 'missing split'""")
def _(spark, sf):
    means = rk.fold_means(_metrics(spark, sf), ["value"]).withColumnRenamed("mean_value", "value")
    splits = means.select("split").distinct().withColumns({"status": F.lit("ok"), "reason": F.lit("")})
    out = rk.quality_gates(means, splits, required_splits=["leave_species_out", "leave_clade_out"], required_baselines=["degree_prior", "expression_only", "family_pair_transfer", "random"])
    return out.select("split", "baseline", "delta_pr_auc", "passed", "reason")


@query("n17_n19_isotonic")
def _(spark, sf):
    rows = checked(spark, sf).where("scorer = 'role_only'")
    cal = tr.fit_calibrator(rows)
    return tr.apply_calibrator(rows, cal).select("fold", "pair_id", "score", "probability")


@query("n17_sigmoid")
def _(spark, sf):
    rows = checked(spark, sf).where("scorer = 'role_only'")
    return tr.apply_calibrator(rows, tr.fit_calibrator(rows, method="sigmoid")).select("fold", "pair_id", "score", "probability")


@query("n18_calibration", r.with_sql(BULK, PSEUDO) + """, b AS (SELECT *, (lr + rr) / 2 AS p, LEAST(floor((lr + rr) / 2 * 10), 9) AS bin FROM pz),
e AS (SELECT species, bin, COUNT(*) AS n, SUM(p) AS sp, SUM(label) AS sy, SUM((p - label) * (p - label)) AS sq FROM b GROUP BY 1, 2)
SELECT species, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(sy) AS BIGINT) AS n_positive, round(SUM(sq) / SUM(n), 6) AS brier_score, round(SUM(abs(sp - sy)) / SUM(n), 6) AS ece_10bin FROM e GROUP BY 1""")
def _(spark, sf):
    rows = labelled_pairs(spark, sf).withColumn("probability", (F.col("ligand_role_score") + F.col("receptor_role_score")) / 2)
    return rk.calibration_metrics(rows, ["species"])


@query("n5_role_labels", r.with_sql(BULK) + "SELECT CAST(vec_id AS VARCHAR) AS gene_id, CASE WHEN CAST(vec_id AS VARCHAR) IN (SELECT lg FROM bulk) THEN 1 ELSE 0 END AS ligand_like, CASE WHEN CAST(vec_id AS VARCHAR) IN (SELECT rg FROM bulk) THEN 1 ELSE 0 END AS membrane_like FROM embeddings")
def _(spark, sf):
    return tr.role_training_labels(bulk(spark, sf), embeddings(spark, sf)).select("gene_id", "ligand_like", "membrane_like")


def _role_labels(spark, sf):
    return tr.role_training_labels(bulk(spark, sf), embeddings(spark, sf))


@query("n5_n6_role_models")
def _(spark, sf):
    models = tr.train_role_classifiers(_role_labels(spark, sf), ("receptor_like",))
    proteins = embeddings(spark, sf).select("gene_id", F.col("gene_id").alias("protein_id"))
    return tr.predict_protein_roles(proteins, embeddings(spark, sf), models=models)


@query("n7_role_holdout")
def _(spark, sf):
    return tr.role_holdout(_role_labels(spark, sf), "receptor_like")


@query("n8_n16_ranker_card")
def _(spark, sf):
    path = f"{shared_folder(spark).rstrip('/')}/sparkcomm/ranker-{uuid.uuid4().hex}"
    tr.train_lr_link_predictor(bulk(spark, sf), embeddings(spark, sf), model="logistic", validation_splits=("leave_species_out",), negative_ratio=1, excluded_homology_radius="none", output_dir=path)
    return load_pair_model(spark, path).card


@query("m9_model_scores")
def _(spark, sf):
    data = tr.as_vector(ca.make_lr_pair_features(labelled_pairs(spark, sf), embeddings(spark, sf), check=False))
    model = tr.fit_pair_model(data, model="gbt", max_iter=5)
    return ca.score_lr_candidates(candidates(spark, sf), embeddings(spark, sf), model=model).select("ligand_gene", "receptor_gene", "model_score", "calibrated_probability", "warning")
