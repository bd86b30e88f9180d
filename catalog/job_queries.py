"""Preparation, strategies, comparisons, gates and parity."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcomm.operators import expression as ex
from sparkcomm.operators import jobs as jb
from sparkcomm.sources.writers import with_context

from . import roles as r
from .group_queries import base_sql
from .network_queries import result
from .spatial_queries import core, gene_expr, labelled, means

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf: r.rounded(fn(spark, sf))
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


@query("p1_normalize_log1p", r.with_sql(r.expr_sql()) + "SELECT cell_id, gene, round(ln(1 + value / SUM(value) OVER (PARTITION BY cell_id) * 10000), 6) AS value FROM expr")
def _(spark, sf):
    return jb.normalize_log1p(r.expression(spark, sf))


@query("p2_count_evidence", r.with_sql(r.expr_sql()) + "SELECT MIN(value) AS lowest, MAX(value) AS highest, bool_and(abs(value - round(value)) <= 1e-8) AS all_whole, MIN(value) >= 0 AND (MAX(value) > 20 OR bool_and(value = round(value))) AS looks_like_counts FROM expr")
def _(spark, sf):
    return jb.count_evidence(r.expression(spark, sf))


@query("p3_group_columns", "SELECT 'o_orderstatus' AS \"column\", COUNT(DISTINCT o_orderstatus) AS levels FROM orders UNION ALL SELECT 'o_orderpriority', COUNT(DISTINCT o_orderpriority) FROM orders")
def _(spark, sf):
    return jb.group_column_candidates(r.read(spark, sf, "orders")).select("column", "levels")


@query("p4_section_qc", r.with_sql(r.CELLS, r.expr_sql()) + """SELECT c.section, n_cells_or_bins, n_groups, n_expression_genes, (SELECT COUNT(DISTINCT p_brand) FROM part) AS n_genes FROM (SELECT section, COUNT(*) AS n_cells_or_bins, COUNT(DISTINCT grp) AS n_groups FROM cells GROUP BY 1) c
 JOIN (SELECT section, COUNT(DISTINCT gene) AS n_expression_genes FROM expr JOIN cells USING (cell_id) GROUP BY 1) e ON c.section = e.section""")
def _(spark, sf):
    return jb.section_qc(r.expression(spark, sf), labelled(spark, sf), genes=r.genes(spark, sf))


@query("p5_union_sections", r.with_sql(r.CELLS, r.expr_sql("R", "er"), r.expr_sql("A", "ea")) + """SELECT 'r:' || cell_id AS cell_id, gene, value FROM er UNION ALL SELECT 'a:' || cell_id, gene, value FROM ea""")
def _(spark, sf):
    c = r.cells(spark, sf)
    expression, _cells = jb.union_sections({"r": (r.expression(spark, sf, "R"), c), "a": (r.expression(spark, sf, "A"), c.drop("section"))})
    return expression


@query("p5_gene_lookup", "SELECT COALESCE(a.gene, b.gene) AS gene, COALESCE(a.gene_id, b.gene) AS gene_id FROM (SELECT p_brand AS gene, MIN(p_type) AS gene_id FROM part WHERE p_size < 3 GROUP BY 1) a FULL JOIN (SELECT DISTINCT p_brand AS gene FROM part) b ON a.gene = b.gene")
def _(spark, sf):
    p = r.read(spark, sf, "part")
    first = p.where("p_size < 3").groupBy(F.col("p_brand").alias("gene")).agg(F.min("p_type").alias("gene_id"))
    return jb.union_gene_lookup([first, r.genes(spark, sf).select("gene")])


@query("p6_limit_lr", r.with_sql(r.LR, r.SCORED_LR) + "SELECT ligand, receptor, round(model_score, 6) AS model_score FROM slr ORDER BY model_score DESC, ligand, receptor LIMIT 40")
def _(spark, sf):
    return jb.limit_lr_for_validation(r.scored_lr(spark, sf), 40).select("ligand", "receptor", "model_score")


@query("p7_baseline_role", r.with_sql(r.LR, r.SCORED_LR) + "SELECT ligand, receptor, round(ligand_role_score * receptor_role_score, 5) AS model_score, 'role_only' AS validation_strategy FROM slr")
def _(spark, sf):
    return jb.baseline_lr(r.scored_lr(spark, sf), "role_only").select("ligand", "receptor", F.round("model_score", 5).alias("model_score"), "validation_strategy")


@query("p7_baseline_expression", core("SELECT ligand, receptor, round(a.e * b.e, 4) AS model_score FROM slr JOIN ge a ON a.gene = ligand JOIN ge b ON b.gene = receptor", "ge AS (SELECT gene, AVG(value) AS e FROM dense GROUP BY 1)"))
def _(spark, sf):
    return jb.baseline_lr(r.scored_lr(spark, sf), "expression_only", gene_expression=gene_expr(spark, sf)).select("ligand", "receptor", F.round("model_score", 4).alias("model_score"))


POT = """pot AS (SELECT ligand, receptor, MIN(model_score) AS ms, quantile_cont(s.expr * t.expr, 0.9) AS q90, AVG(s.expr * t.expr) AS mean, MAX(s.expr * t.expr) AS mx FROM slr JOIN gx s ON s.gene = ligand JOIN gx t ON t.gene = receptor GROUP BY 1, 2)"""


def _groups(spark, sf):
    return labelled(spark, sf).select("group").distinct()


@query("p8_expression_potential_score", core("SELECT ligand, receptor, round(rk, 6) AS expression_potential_rank, round(ms * sqrt(rk), 6) AS model_score FROM (SELECT *, (RANK() OVER (ORDER BY round(q90, 9)) + (COUNT(*) OVER (PARTITION BY round(q90, 9)) - 1) / 2.0) / (SELECT COUNT(*) FROM pot) AS rk FROM pot)", POT))
def _(spark, sf):
    return jb.expression_potential_score(r.scored_lr(spark, sf), means(spark, sf), _groups(spark, sf), stat="q90").select("ligand", "receptor", "expression_potential_rank", "model_score")


@query("p8_expression_potential_mean", core("SELECT ligand, receptor, round(mean, 3) AS potential FROM pot", POT))
def _(spark, sf):
    return jb.expression_potential(r.scored_lr(spark, sf), means(spark, sf), _groups(spark, sf)).withColumn("potential", F.round("potential", 3))


@query("p9_decay_controls")
def _(spark, sf):
    return jb.distance_decay_with_controls(labelled(spark, sf), r.scored_lr(spark, sf), r.expression(spark, sf), r.genes(spark, sf), means(spark, sf), seed=1)


@query("a12_report_context", r.with_sql(r.CELLS) + "SELECT 'demo' AS dataset, section, COUNT(*) AS n FROM cells GROUP BY 2")
def _(spark, sf):
    return with_context(r.cells(spark, sf).groupBy("section").agg(F.count(F.lit(1)).alias("n")), {"dataset": "demo"})


# --- statistics per region, flag and line number stand in for top-k rows ---------------------

def _topk(spark, sf):
    l = r.read(spark, sf, "lineitem").join(r.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = r.read(spark, sf, "customer").join(r.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    l = l.join(c, F.col("o_custkey") == F.col("c_custkey"))
    strategy = F.when(F.col("l_returnflag") == "A", "dbfree").when(F.col("l_returnflag") == "N", "role_only").otherwise("embedding_cosine")
    return l.groupBy(
        F.lit("d").alias("dataset"), F.lit("s").alias("species"), F.col("n_name").alias("section_id"), F.lit("exp").alias("kernel"), F.lit("model_weighted_spatial_ccc_score").alias("score_type"),
        (F.col("l_linenumber") * 250).cast("bigint").alias("k"), F.lit("matched_random_lr").alias("null_model"), strategy.alias("validation_strategy"),
    ).agg(
        F.avg("l_quantity").alias("observed_mean"), (F.avg("l_tax") * 640).alias("null_mean"), F.stddev_samp("l_quantity").alias("null_sd"),
        ((F.avg("l_discount") - 0.047) * 1000).alias("top_k_enrichment_z"), F.avg("l_tax").alias("top_k_empirical_pvalue"), F.count(F.lit(1)).alias("n_permutations"),
    )


def topk(spark, sf):
    return r.once(spark, sf, "topk rows", lambda: _topk(spark, sf))


TK = """tk AS (SELECT n_name AS section_id, CAST(l_linenumber * 250 AS BIGINT) AS k, CASE l_returnflag WHEN 'A' THEN 'dbfree' WHEN 'N' THEN 'role_only' ELSE 'embedding_cosine' END AS st, AVG(l_quantity) AS o, AVG(l_tax) * 640 AS nm, stddev_samp(l_quantity) AS ns,
  (AVG(l_discount) - 0.047) * 1000 AS z, AVG(l_tax) AS p, COUNT(*) AS np FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""


@query("p10_baseline_comparison", r.with_sql(TK) + "SELECT t.section_id, t.k, t.st AS validation_strategy, round(t.z, 6) AS enrichment_z, round(d.z, 6) AS dbfree_enrichment_z, round(t.z - d.z, 6) AS delta_z_vs_dbfree, t.np AS n_permutations FROM tk t LEFT JOIN tk d ON d.section_id = t.section_id AND d.k = t.k AND d.st = 'dbfree'")
def _(spark, sf):
    return jb.baseline_comparison(topk(spark, sf)).select("section_id", "k", "validation_strategy", "enrichment_z", "dbfree_enrichment_z", "delta_z_vs_dbfree", "n_permutations")


DELTA = """best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY section_id, k ORDER BY z DESC, st) AS rn FROM tk WHERE st <> 'dbfree') WHERE rn = 1),
dl AS (SELECT d.section_id, d.k, b.st AS best, d.z - b.z AS delta FROM tk d JOIN best b ON b.section_id = d.section_id AND b.k = d.k WHERE d.st = 'dbfree')"""


@query("p11_section_delta", r.with_sql(TK, DELTA) + "SELECT section_id, k, best AS best_non_model_strategy, round(delta, 6) AS delta_z FROM dl")
def _(spark, sf):
    return jb.baseline_section_delta(topk(spark, sf)).select("section_id", "k", "best_non_model_strategy", "delta_z")


_PK = "'0', concat_ws(chr(1), 'd', 's', 'exp', 'model_weighted_spatial_ccc_score', CAST(k AS VARCHAR), 'matched_random_lr'), CAST(i AS VARCHAR), CAST(j AS VARCHAR)"


@query("p12_delta_summary", r.with_sql(TK, DELTA) + f"""
, pl AS (SELECT k, delta, ROW_NUMBER() OVER (PARTITION BY k ORDER BY delta, section_id) - 1 AS pos, COUNT(*) OVER (PARTITION BY k) AS n FROM dl),
dr AS (SELECT k, i, floor({r.hash_unit_sql(_PK)} * n) AS pos FROM (SELECT DISTINCT k, n FROM pl) c, (SELECT unnest(generate_series(0, 199)) AS i) a, (SELECT unnest(generate_series(0, 24)) AS j) b WHERE j < n),
md AS (SELECT k, i, median(delta) AS m FROM dr JOIN pl USING (k, pos) GROUP BY 1, 2),
ci AS (SELECT k, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM md GROUP BY 1)
SELECT k, COUNT(*) AS n_sections, round(median(delta), 6) AS median_delta_z, round(AVG(delta), 6) AS mean_delta_z, round(AVG(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END), 6) AS fraction_positive_delta_z, round(MIN(lo), 6) AS bootstrap_ci_low, round(MIN(hi), 6) AS bootstrap_ci_high FROM dl JOIN ci USING (k) GROUP BY 1""")
def _(spark, sf):
    out = jb.section_delta_summary(jb.baseline_section_delta(topk(spark, sf)), iterations=200)
    return out.select("k", "n_sections", "median_delta_z", "mean_delta_z", "fraction_positive_delta_z", "bootstrap_ci_low", "bootstrap_ci_high")


@query("p13_passing_sections", r.with_sql(TK) + """, a AS (SELECT section_id, COUNT(*) FILTER (WHERE st = 'dbfree' AND z >= 2 AND p <= 0.05) AS m, COUNT(*) FILTER (WHERE st = 'role_only' AND z >= 2 AND p <= 0.05) AS r, MAX(z) FILTER (WHERE st = 'dbfree') AS mz, MAX(z) FILTER (WHERE st = 'role_only') AS rz FROM tk WHERE k IN (500, 1000) GROUP BY 1)
SELECT section_id FROM a WHERE m > 0 AND rz IS NOT NULL AND (mz > rz OR m > r)""")
def _(spark, sf):
    return jb.passing_sections(topk(spark, sf))


@query("p13_gates", r.with_sql(TK) + """SELECT 'feasibility_gate' AS gate, n >= 1 AS passed, 'passing_sections=' || n AS evidence FROM (SELECT COUNT(DISTINCT section_id) AS n FROM tk WHERE st = 'dbfree' AND k IN (500, 1000) AND z > 0 AND o > nm)
UNION ALL SELECT 'topk_design_complete', FALSE, 'missing_kernels=contact; missing_nulls=; missing_strategies=expression_only; missing_topk=5000; max_permutations=' || MAX(np) FROM tk
UNION ALL SELECT 'required_final_sections_prepared', FALSE, 'required=NATION_1,NOWHERE; missing=NOWHERE'""")
def _(spark, sf):
    t = topk(spark, sf)
    gates = [
        jb.feasibility_gate("d", t),
        jb.design_gate("d", t, kernels=["contact", "exp"], nulls=["matched_random_lr"], strategies=["dbfree", "role_only", "expression_only"], ks=[250, 1000, 5000]),
        jb.required_sections_gate("d", t, ["NATION_1", "NOWHERE"]),
    ]
    return jb.all_gates(gates).select("gate", "passed", "evidence")


@query("p13_acceptance_gates", r.with_sql(TK) + """, a AS (SELECT section_id, COUNT(*) FILTER (WHERE st = 'dbfree' AND z >= 2 AND p <= 0.05) AS m, COUNT(*) FILTER (WHERE st = 'role_only' AND z >= 2 AND p <= 0.05) AS r, MAX(z) FILTER (WHERE st = 'dbfree') AS mz, MAX(z) FILTER (WHERE st = 'role_only') AS rz FROM tk WHERE k IN (500, 1000) GROUP BY 1),
se AS (SELECT COUNT(*) AS n FROM a WHERE m > 0 AND rz IS NOT NULL AND (mz > rz OR m > r)),
ma AS (SELECT COUNT(DISTINCT p_brand) AS n, COUNT(DISTINCT CASE WHEN p_type = 'PROMO' AND p_size > 48 THEN p_brand END) AS m FROM part),
ge AS (SELECT p_brand AS g FROM part UNION SELECT p_type FROM part), kn AS (SELECT DISTINCT p_brand AS g FROM part WHERE p_type = 'PROMO' AND p_size > 45),
co AS (SELECT COUNT(kn.g) AS c, COUNT(*) AS n FROM ge LEFT JOIN kn USING (g)),
wa AS (SELECT COALESCE(string_agg(DISTINCT w, ',' ORDER BY w), '') AS bad FROM (SELECT trim(unnest(string_split(o_orderpriority || ';' || o_orderstatus, ';'))) AS w FROM orders) WHERE w IN ('P', 'fixture', 'O')),
de AS (SELECT COALESCE(string_agg(w, ',' ORDER BY w), '') AS mi FROM (SELECT unnest(['score_permutation', 'matched_random_lr', 'dbfree']) AS w) WHERE w NOT IN (SELECT st FROM tk))
SELECT 'spatial' AS category, 'main_gate' AS gate, n >= 2 AS passed, 'passing_sections=' || n AS evidence FROM se
UNION ALL SELECT 'sequence', 'gene_match_fraction', m >= 0.5 * n, printf('matched_fraction=%.3f; threshold=%.3f', m / n, 0.5) FROM ma
UNION ALL SELECT 'sequence', 'predicted_lr_gene_coverage', c >= 0.7 * n, printf('covered=%d; total=%d; fraction=%.3f; threshold=%.3f', c, n, c / n, 0.7) FROM co
UNION ALL SELECT 'model', 'no_fixture_warnings', bad = '', 'forbidden=' || bad FROM wa
UNION ALL SELECT 'spatial', 'distance_decay_controls_present', mi = '', 'missing=' || mi FROM de""")
def _(spark, sf):
    t, part, orders = topk(spark, sf), r.read(spark, sf, "part"), r.read(spark, sf, "orders")
    promo = F.col("p_type") == "PROMO"
    matched = part.agg(F.count_distinct("p_brand").alias("n_expression_genes"), F.count_distinct(F.when(promo & (F.col("p_size") > 48), F.col("p_brand"))).alias("n_matched_genes"))
    predicted = part.select(F.col("p_brand").alias("ligand"), F.col("p_type").alias("receptor"))
    match = part.select(F.col("p_brand").alias("gene_id"), (promo & (F.col("p_size") > 45)).alias("in_expression"))
    gates = [
        jb.section_gate("d", t),
        jb.gene_match_gate("d", matched, 0.5),
        jb.lr_gene_coverage_gate("d", predicted, match, 0.7),
        jb.warning_gate("d", orders.select(F.concat_ws(" ; ", "o_orderpriority", "o_orderstatus").alias("warning")), ["P", "fixture", "O"]),
        jb.decay_controls_gate("d", t),
    ]
    return jb.all_gates(gates).select("category", "gate", "passed", "evidence")


@query("p14_shared_groups", "SELECT o_orderpriority AS \"group\", COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_a, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS n_b, COUNT(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS total FROM orders GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 3")
def _(spark, sf):
    return jb.shared_groups(r.read(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "F", "P", top_n=3)


@query("p14_capped_sample", f"SELECT cell_id, grp AS \"group\" FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY section, grp ORDER BY {r.hash_long_sql(repr('0'), repr('capped'), 'cell_id')}, cell_id) AS rn FROM (SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, o_orderpriority AS grp, o_orderstatus AS section FROM orders)) WHERE rn <= 30")
def _(spark, sf):
    rows = ex.label_cells(r.order_cells(spark, sf), "segment")
    return jb.capped_sample(rows, ["section", "group"], 30).select("cell_id", "group")


@query("p15_parity", base_sql() + """, b AS (SELECT ligand, receptor, SUM(prob) AS y FROM inter WHERE source <> target GROUP BY 1, 2), a AS (SELECT ligand, receptor, SUM(prob) AS x FROM inter WHERE pathway <> 'P1' GROUP BY 1, 2),
j AS (SELECT ligand, receptor, COALESCE(x, 0) AS x, COALESCE(y, 0) AS y FROM a FULL JOIN b USING (ligand, receptor)),
k AS (SELECT *, RANK() OVER (ORDER BY round(x, 9)) + (COUNT(*) OVER (PARTITION BY round(x, 9)) - 1) / 2.0 AS rx, RANK() OVER (ORDER BY round(y, 9)) + (COUNT(*) OVER (PARTITION BY round(y, 9)) - 1) / 2.0 AS ry, ROW_NUMBER() OVER (ORDER BY x DESC, ligand, receptor) AS tx, ROW_NUMBER() OVER (ORDER BY y DESC, ligand, receptor) AS ty FROM j)
SELECT 'lr' AS analysis, COUNT(*) AS n_values, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(MAX(abs(x - y)), 5) AS max_abs_diff, round(median(abs(x - y)), 5) AS median_abs_diff, round(COUNT(*) FILTER (WHERE tx <= 20 AND ty <= 20) / 20.0, 6) AS top20_overlap FROM k""")
def _(spark, sf):
    rows = result(spark, sf).interactions
    keys = ["ligand", "receptor"]
    a = rows.where("pathway <> 'P1'").groupBy(*keys).agg(F.sum("prob").alias("prob"))
    b = rows.where("source <> target").groupBy(*keys).agg(F.sum("prob").alias("prob"))
    out = jb.parity_metrics(a, b, keys, name="lr")
    return out.withColumns({c: F.round(c, 5) for c in ("max_abs_diff", "median_abs_diff")})
