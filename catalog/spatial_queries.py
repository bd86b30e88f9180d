"""Spatial kernels, scores, null models and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcomm.operators import expression as ex
from sparkcomm.operators import nulls as nl
from sparkcomm.operators import spatial as sp
from sparkcomm.operators.resample import shuffled_labels, shuffled_values, stratified_sample
from sparkcomm.plans.validation import validate_spatial_lr_table
from sparkcomm.session import materialize

from . import roles as r
from .group_queries import DENSE

QUERIES: dict = {}
SQL: dict[str, str] = {}
RADIUS, SIGMA, N = 300.0, 40.0, 4


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf: r.rounded(fn(spark, sf))
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def labelled(spark, sf):
    return ex.label_cells(r.cells(spark, sf), "segment")


def weights(spark, sf):
    return r.once(spark, sf, "weights", lambda: sp.spatial_weights(labelled(spark, sf), radius=RADIUS, sigma=SIGMA))


def means(spark, sf):
    return r.once(spark, sf, "means", lambda: sp.group_means(r.expression(spark, sf), labelled(spark, sf)))


def observed(spark, sf):
    return sp.score_lr_spatial(r.scored_lr(spark, sf), means(spark, sf), weights(spark, sf))


def summary(spark, sf):
    return r.once(spark, sf, "summary", lambda: sp.lr_summary(observed(spark, sf), r.scored_lr(spark, sf)))


def gene_expr(spark, sf):
    return sp.gene_means(r.expression(spark, sf), r.cells(spark, sf), r.genes(spark, sf))


def null(spark, sf, models=nl.NULL_MODELS, **options):
    key = f"null {models} {sorted(options)}"
    return r.once(spark, sf, key, lambda: nl.null_scores(
        r.scored_lr(spark, sf), r.expression(spark, sf), labelled(spark, sf), means=means(spark, sf), weights=weights(spark, sf), gene_expression=gene_expr(spark, sf),
        radius=RADIUS, sigma=SIGMA, n=N, kernels=sp.KERNELS, null_models=models, section="section", seed=2, **options))


# --- SQL pieces --------------------------------------------------------------------------

GX = "gx AS (SELECT grp, gene, AVG(value) AS expr FROM dense GROUP BY 1, 2)"
PAIRS = "pairs AS MATERIALIZED (SELECT a.cell_id AS ca, b.cell_id AS cb, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) AS d FROM cells a, cells b)"
NEAR = f"near AS MATERIALIZED (SELECT ca, cb, CASE WHEN d <= {RADIUS} THEN 1.0 ELSE 0.0 END AS contact, exp(-d / {SIGMA}) AS ex FROM pairs WHERE d <= {max(RADIUS, SIGMA * 27.7)})"
BOTH = "SELECT source, target, 'contact' AS kernel, c / (ns * nt) AS spatial_weight FROM {t} UNION ALL SELECT source, target, 'exp', e / (ns * nt) FROM {t}"
WT = f"""sz AS (SELECT grp, COUNT(*) * 1.0 AS n FROM cells GROUP BY 1),
ws AS (SELECT a.grp AS source, b.grp AS target, SUM(contact) AS c, SUM(ex) AS e FROM near JOIN cells a ON a.cell_id = ca JOIN cells b ON b.cell_id = cb GROUP BY 1, 2),
wq AS (SELECT s.grp AS source, t.grp AS target, COALESCE(c, 0) AS c, COALESCE(e, 0) AS e, s.n AS ns, t.n AS nt FROM sz s CROSS JOIN sz t LEFT JOIN ws ON ws.source = s.grp AND ws.target = t.grp),
wt AS ({BOTH.format(t='wq')})"""
OBS = """obs AS (SELECT l.ligand, l.receptor, w.source, w.target, w.kernel, s.expr * t.expr AS expression_score, spatial_weight, s.expr * t.expr * spatial_weight AS sc, model_score,
  s.expr * t.expr * spatial_weight * model_score AS mw FROM slr l CROSS JOIN wt w JOIN gx s ON s.gene = ligand AND s.grp = source JOIN gx t ON t.gene = receptor AND t.grp = target)"""
SUM = """summ AS (SELECT o.ligand, o.receptor, kernel, AVG(sc) AS sc, MAX(sc) AS mx, AVG(mw) AS mw, MIN(l.model_score) AS model_score, MIN(ligand_secreted_like_score) AS ls, MIN(ligand_membrane_like_score) AS lm,
  MIN(receptor_membrane_like_score) AS rm FROM obs o JOIN slr l ON l.ligand = o.ligand AND l.receptor = o.receptor GROUP BY 1, 2, 3)"""
CORE = [r.CELLS, r.expr_sql(), r.LR, r.SCORED_LR, DENSE, GX, PAIRS, NEAR, WT, OBS, SUM]


def core(tail: str, *more: str) -> str:
    return r.with_sql(*CORE, *more) + tail


@query("o1_exact_gene_filter", r.with_sql(r.LR) + "SELECT ligand, receptor FROM lr WHERE receptor IN (SELECT gene FROM genes)")
def _(spark, sf):
    return sp.exact_gene_lr(r.lr_table(spark, sf), r.genes(spark, sf)).select("ligand", "receptor")


@query("o2_nearest_radius", r.with_sql(r.CELLS, PAIRS) + "SELECT round(median(m), 6) AS radius FROM (SELECT ca, MIN(d) AS m FROM pairs WHERE ca <> cb GROUP BY 1)")
def _(spark, sf):
    return sp.resolve_radius(r.cells(spark, sf))


@query("o2_area_radius", r.with_sql(r.CELLS) + "SELECT round(2 * sqrt(median(abs(x) + 1) / pi()), 6) AS radius FROM cells")
def _(spark, sf):
    return sp.resolve_radius(r.cells(spark, sf).withColumn("area", F.abs("x") + 1))


@query("o3_group_means", r.with_sql(r.CELLS, r.expr_sql(), DENSE, GX) + 'SELECT grp AS "group", gene, round(expr, 6) AS expr FROM gx')
def _(spark, sf):
    return means(spark, sf)


@query("o3_gene_means", r.with_sql(r.CELLS, r.expr_sql(), DENSE) + "SELECT gene, round(AVG(value), 6) AS expression FROM dense GROUP BY 1")
def _(spark, sf):
    return gene_expr(spark, sf)


@query("o4_o5_kernel_weights", r.with_sql(r.CELLS, PAIRS, NEAR, WT) + "SELECT source, target, kernel, round(spatial_weight, 6) AS spatial_weight FROM wt")
def _(spark, sf):
    return sp.spatial_weights(labelled(spark, sf), radius=RADIUS, sigma=SIGMA)


# distances add up in steps of 2^-44, so that no order of adding shows in the sum
@query("o4_contact_pairs", r.with_sql(r.CELLS, PAIRS) + "SELECT COUNT(*) AS n, round(CAST(SUM(CAST(floor(d * 17592186044416) AS BIGINT)) AS DOUBLE) / 17592186044416, 3) AS total FROM pairs WHERE d <= 450")
def _(spark, sf):
    places = r.cells(spark, sf).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    met = sp.location_pairs(places, 450.0, carry=["n"]).withColumn("_w", F.col("na") * F.col("nb"))
    steps = F.floor(F.col("d") * float(1 << 44)).cast("decimal(18,0)") * F.col("_w").cast("decimal(18,0)")
    return met.agg(F.sum("_w").alias("n"), F.round(F.sum(steps).cast("double") / float(1 << 44), 3).alias("total"))


@query("o6_spatial_scores", core("SELECT ligand, receptor, source, target, kernel, round(expression_score, 4) AS expression_score, round(sc, 6) AS spatial_ccc_score, round(mw, 6) AS model_weighted_spatial_ccc_score FROM obs"))
def _(spark, sf):
    out = observed(spark, sf).drop("spatial_weight", "model_score")
    return out.withColumn("expression_score", F.round("expression_score", 4))


@query("o7_lr_summary", core("SELECT ligand, receptor, kernel, round(sc, 6) AS spatial_ccc_score, round(mx, 6) AS max_spatial_ccc_score, round(mw, 6) AS model_weighted_spatial_ccc_score, round(model_score, 6) AS model_score FROM summ"))
def _(spark, sf):
    return summary(spark, sf).select("ligand", "receptor", "kernel", *sp.SCORES, "max_spatial_ccc_score", "model_score")




@query("o8_curated_overlap", core("SELECT ligand, receptor, kernel, (ligand, receptor) IN (SELECT (ligand, receptor) FROM curated) AS curated_overlap FROM summ", r.CURATED))
def _(spark, sf):
    return sp.annotate_curated_overlap(summary(spark, sf), r.curated_lr(spark, sf)).select("ligand", "receptor", "kernel", "curated_overlap")


# --- nulls -------------------------------------------------------------------------------

def moved(name: str, seed: int, within: str | None = None) -> str:
    part = f"i, {within}" if within else "i"
    order = f"ORDER BY {r.hash_long_sql(repr(str(seed)), 'CAST(i AS VARCHAR)', 'cell_id')}, cell_id"
    key = within or "0"
    return f"""{name}o AS (SELECT cell_id, i, {key} AS st, ROW_NUMBER() OVER (PARTITION BY {part} {order}) AS rn FROM cells, (SELECT unnest(generate_series(0, {N - 1})) AS i)),
{name}b AS (SELECT st, grp, SUM(n) OVER (PARTITION BY st ORDER BY grp) AS hi, SUM(n) OVER (PARTITION BY st ORDER BY grp) - n AS lo FROM (SELECT {key} AS st, grp, COUNT(*) AS n FROM cells GROUP BY 1, 2)),
{name} AS MATERIALIZED (SELECT o.cell_id, o.i, b.grp FROM {name}o o JOIN {name}b b ON o.st = b.st AND o.rn > b.lo AND o.rn <= b.hi)"""


def moved_weights(name: str, cells: str) -> str:
    return f"""{name}s AS (SELECT a.i, a.grp AS source, b.grp AS target, SUM(contact) AS c, SUM(ex) AS e FROM near JOIN {cells} a ON a.cell_id = ca JOIN {cells} b ON b.cell_id = cb AND a.i = b.i GROUP BY 1, 2, 3),
{name}q AS (SELECT i, s.grp AS source, t.grp AS target, COALESCE(c, 0) AS c, COALESCE(e, 0) AS e, s.n AS ns, t.n AS nt FROM sz s CROSS JOIN sz t CROSS JOIN (SELECT DISTINCT i FROM {cells}) LEFT JOIN {name}s x USING (i) WHERE x.source = s.grp AND x.target = t.grp),
{name} AS (SELECT i, source, target, 'contact' AS kernel, c / (ns * nt) AS spatial_weight FROM {name}q UNION ALL SELECT i, source, target, 'exp', e / (ns * nt) FROM {name}q)"""


COORD = [moved("mc", 9), moved_weights("wc", "mc"), """n_coord AS (SELECT i, ligand, receptor, kernel, AVG(s.expr * t.expr * spatial_weight) AS sc, MIN(model_score) AS m FROM slr CROSS JOIN wc w
  JOIN gx s ON s.gene = ligand AND s.grp = source JOIN gx t ON t.gene = receptor AND t.grp = target GROUP BY 1, 2, 3, 4)"""]
TYPE = [moved("mt", 10, "section"), moved_weights("wk", "mt"), """gt AS (SELECT m.i, m.grp, d.gene, AVG(value) AS expr FROM dense d JOIN mt m ON m.cell_id = d.cell_id GROUP BY 1, 2, 3),
n_type AS (SELECT w.i, ligand, receptor, kernel, AVG(s.expr * t.expr * spatial_weight) AS sc, MIN(model_score) AS m FROM slr CROSS JOIN wk w
  JOIN gt s ON s.gene = ligand AND s.grp = source AND s.i = w.i JOIN gt t ON t.gene = receptor AND t.grp = target AND t.i = w.i GROUP BY 1, 2, 3, 4)"""]
MATCH = """gm AS (SELECT gene, AVG(value) AS expression FROM dense GROUP BY 1),
gr AS (SELECT gene, expression, ROW_NUMBER() OVER (ORDER BY expression, gene) AS rk, COUNT(*) OVER () AS n FROM gm),
gtab AS (SELECT gene, expression, CAST(GREATEST(ceil((rk - 1) * LEAST(10, n) / (n - 1)) - 1, 0) AS BIGINT) AS q,
  (SELECT COUNT(*) FROM slr WHERE ligand = gene) AS ld, (SELECT COUNT(*) FROM slr WHERE receptor = gene) AS rd,
  COALESCE((SELECT AVG(ligand_role_score) FROM slr WHERE ligand = gene), 0.5) AS lrole, COALESCE((SELECT AVG(receptor_role_score) FROM slr WHERE receptor = gene), 0.5) AS rrole FROM gr)"""


def pool_sql(side: str) -> str:
    role, deg, own = ("lrole", "ld", "ligand_role_score") if side == "ligand" else ("rrole", "rd", "receptor_role_score")
    return f"""p_{side} AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY g ORDER BY round(dq + dr + dd, 9), cand) AS place, COUNT(*) OVER (PARTITION BY g) AS cn FROM (SELECT x.g, o.gene AS cand, abs(o.q - m.q) * 1.0 AS dq, abs(o.{role} - x.own) AS dr,
  abs(ln(1 + o.{deg}) - ln(1 + m.{deg})) AS dd FROM (SELECT DISTINCT {side} AS g, {own} AS own FROM slr) x JOIN gtab m ON m.gene = x.g JOIN gtab o ON o.gene <> x.g)) WHERE place <= 10)"""


def pick(side: str) -> str:
    return f"floor({r.hash_unit_sql(repr('11'), 'CAST(i AS VARCHAR)', repr(side), 'ligand || chr(62) || receptor')} * LEAST(10, (SELECT COUNT(*) - 1 FROM gtab))) + 1"


MATCHED = [MATCH, pool_sql("ligand"), pool_sql("receptor"), f"""drawn AS (SELECT q.i, q.ligand, q.receptor, q.model_score, a.cand AS ml, b.cand AS mr, a.dq AS ldq, b.dd AS rdd FROM
  (SELECT i, ligand, receptor, model_score, {pick('ligand')} AS lp, {pick('receptor')} AS rp FROM slr, (SELECT unnest(generate_series(0, {N - 1})) AS i)) q
  JOIN p_ligand a ON a.g = q.ligand AND a.place = lp JOIN p_receptor b ON b.g = q.receptor AND b.place = rp)""",
           """n_match AS (SELECT i, ligand, receptor, kernel, AVG(s.expr * t.expr * spatial_weight) AS sc, MIN(model_score) AS m FROM drawn CROSS JOIN wt w
  JOIN gx s ON s.gene = ml AND s.grp = source JOIN gx t ON t.gene = mr AND t.grp = target GROUP BY 1, 2, 3, 4)"""]
_ID = "ligand || '|' || receptor"
PERMS = [f"""pb AS (SELECT model_score AS m, ROW_NUMBER() OVER (ORDER BY {r.hash_long_sql("'12'", "'base'", _ID)}, ligand, receptor) AS pos FROM slr),
pp AS (SELECT i, ligand, receptor, ROW_NUMBER() OVER (PARTITION BY i ORDER BY {r.hash_long_sql("'12'", "CAST(i AS VARCHAR)", _ID)}, ligand, receptor) AS pos FROM slr, (SELECT unnest(generate_series(0, {N - 1})) AS i)),
n_score AS (SELECT i, s.ligand, s.receptor, kernel, sc, m FROM summ s JOIN pp ON pp.ligand = s.ligand AND pp.receptor = s.receptor JOIN pb USING (pos))"""]
NULL_COLS = "CAST(i AS BIGINT) AS iteration, ligand, receptor, kernel, round(sc, 6) AS spatial, round(sc * m, 6) AS weighted"


def _wide(spark, sf, model):
    n = null(spark, sf, (model,)).groupBy("iteration", "ligand", "receptor", "kernel").agg(
        F.max(F.when(F.col("score_type") == "spatial_ccc_score", F.col("score_value"))).alias("spatial"),
        F.max(F.when(F.col("score_type") != "spatial_ccc_score", F.col("score_value"))).alias("weighted"),
    )
    return n


query("o9_null_coordinates", core(f"SELECT {NULL_COLS} FROM n_coord", *COORD))(lambda s, d: _wide(s, d, "coordinate_permutation"))
query("o10_null_celltypes_in_section", core(f"SELECT {NULL_COLS} FROM n_type", *TYPE))(lambda s, d: _wide(s, d, "celltype_permutation"))
query("o11_null_matched_lr", core(f"SELECT {NULL_COLS} FROM n_match", *MATCHED))(lambda s, d: _wide(s, d, "matched_random_lr"))
query("o13_null_scores", core(f"SELECT {NULL_COLS} FROM n_score", *PERMS))(lambda s, d: _wide(s, d, "score_permutation"))


@query("o10_shuffle_within_section", r.with_sql(r.CELLS, moved("mt", 10, "section")) + 'SELECT cell_id, CAST(i AS BIGINT) AS iteration, grp AS "group" FROM mt')
def _(spark, sf):
    out = shuffled_labels(labelled(spark, sf), "group", N, id_col="cell_id", seed=10, within=["section"], run="iteration")
    return out.select("cell_id", "iteration", "group")


@query("o11_matched_draws", core("SELECT CAST(i AS BIGINT) AS iteration, ligand AS original_ligand, receptor AS original_receptor, ml AS matched_ligand, mr AS matched_receptor, round(ldq, 6) AS ligand_match_expression_delta, round(rdd, 6) AS receptor_match_degree_delta FROM drawn", *MATCHED))
def _(spark, sf):
    lr = r.scored_lr(spark, sf)
    pool = nl.matched_pool(lr, nl.gene_match_table(lr, gene_expr(spark, sf)))
    out = nl.matched_random_lr(lr, pool, N, seed=11)
    return out.select("iteration", "original_ligand", "original_receptor", "matched_ligand", "matched_receptor", "ligand_match_expression_delta", "receptor_match_degree_delta")


@query("o12_gene_match_table", core("SELECT gene, round(expression, 6) AS expression, q AS expression_quantile, ld AS ligand_degree, rd AS receptor_degree, round(lrole, 6) AS ligand_role_score, round(rrole, 6) AS receptor_role_score FROM gtab", MATCH))
def _(spark, sf):
    return nl.gene_match_table(r.scored_lr(spark, sf), gene_expr(spark, sf))


ALL_NULLS = [*COORD, *TYPE, *MATCHED, *PERMS, """nulls AS (SELECT i, 'coordinate_permutation' AS null_model, ligand, receptor, kernel, sc, sc * m AS mw FROM n_coord UNION ALL SELECT i, 'celltype_permutation', ligand, receptor, kernel, sc, sc * m FROM n_type
  UNION ALL SELECT i, 'matched_random_lr', ligand, receptor, kernel, sc, sc * m FROM n_match UNION ALL SELECT i, 'score_permutation', ligand, receptor, kernel, sc, sc * m FROM n_score),
nl AS (SELECT i, null_model, ligand, receptor, kernel, 'spatial_ccc_score' AS score_type, sc AS v FROM nulls UNION ALL SELECT i, null_model, ligand, receptor, kernel, 'model_weighted_spatial_ccc_score', mw FROM nulls)"""]


@query("o14_null_distribution", core("SELECT null_model, kernel, score_type, COUNT(*) AS n, round(SUM(v), 3) AS total FROM nl GROUP BY 1, 2, 3", *ALL_NULLS))
def _(spark, sf):
    return null(spark, sf).groupBy("null_model", "kernel", "score_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score_value"), 3).alias("total"))


@query("o15_null_stats", core("""SELECT s.ligand, s.receptor, s.kernel, round(CASE WHEN stddev_samp(n.sc) <= 1e-11 * GREATEST(1, abs(AVG(n.sc))) THEN 0 ELSE (MIN(s.sc) - AVG(n.sc)) / stddev_samp(n.sc) END, 4) AS spatial_enrichment_z,
  round((COUNT(*) FILTER (WHERE n.sc >= s.sc - 1e-9 * abs(s.sc)) + 1) / (COUNT(*) + 1), 6) AS empirical_pvalue FROM summ s JOIN nulls n ON n.ligand = s.ligand AND n.receptor = s.receptor AND n.kernel = s.kernel GROUP BY 1, 2, 3""", *ALL_NULLS))
def _(spark, sf):
    out = nl.attach_null_stats(summary(spark, sf), null(spark, sf))
    return out.select("ligand", "receptor", "kernel", F.round("spatial_enrichment_z", 4).alias("spatial_enrichment_z"), "empirical_pvalue")


TOPK = """sl AS (SELECT ligand, receptor, kernel, 'spatial_ccc_score' AS score_type, model_score, sc AS v FROM summ UNION ALL SELECT ligand, receptor, kernel, 'model_weighted_spatial_ccc_score', model_score, mw FROM summ),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY kernel, score_type ORDER BY model_score DESC, v DESC, ligand, receptor) AS rn FROM sl),
top AS (SELECT rk.*, k FROM rk JOIN (SELECT unnest([10, 50]) AS k) ON rn <= k),
ob AS (SELECT kernel, score_type, k, AVG(v) AS o, COUNT(*) AS n_pairs FROM top GROUP BY 1, 2, 3),
runs AS (SELECT t.kernel, t.score_type, t.k, null_model, i, AVG(nl.v) AS v FROM nl JOIN top t ON t.ligand = nl.ligand AND t.receptor = nl.receptor AND t.kernel = nl.kernel AND t.score_type = nl.score_type GROUP BY 1, 2, 3, 4, 5),
rp AS (SELECT kernel, score_type, k, null_model, v FROM runs UNION ALL SELECT kernel, score_type, k, 'pooled', v FROM runs)"""
TOPK_TAIL = """SELECT kernel, score_type, CAST(k AS BIGINT) AS k, null_model, MIN(n_pairs) AS n_pairs, round(MIN(o), 6) AS observed_mean, round(AVG(v), 6) AS null_mean, round(stddev_samp(v), 6) AS null_sd,
  round(CASE WHEN stddev_samp(v) <= 1e-11 * GREATEST(1, abs(AVG(v))) THEN 0 ELSE (MIN(o) - AVG(v)) / stddev_samp(v) END, 4) AS top_k_enrichment_z, round((COUNT(*) FILTER (WHERE v >= o - 1e-9 * abs(o)) + 1) / (COUNT(*) + 1), 6) AS top_k_empirical_pvalue
FROM rp JOIN ob USING (kernel, score_type, k) GROUP BY 1, 2, 3, 4"""


def _topk(df):
    return df.select("kernel", "score_type", "k", "null_model", "n_pairs", "observed_mean", "null_mean", "null_sd", F.round("top_k_enrichment_z", 4).alias("top_k_enrichment_z"), "top_k_empirical_pvalue")


@query("o16_top_k_enrichment", core(TOPK_TAIL, *ALL_NULLS, TOPK))
def _(spark, sf):
    return _topk(nl.top_k_enrichment(summary(spark, sf), null(spark, sf), top_k=(10, 50)))


@query("o23_top_k_only", core(TOPK_TAIL, *ALL_NULLS, TOPK))
def _(spark, sf):
    keep = r.once(spark, sf, "top rows", lambda: nl.top_pairs(summary(spark, sf), (10, 50)).select("ligand", "receptor").distinct())
    return _topk(nl.top_k_enrichment(summary(spark, sf), null(spark, sf, keep=keep), top_k=(10, 50)))


ROLE = "SELECT '{name}' AS role_class, kernel, score_type, COUNT(*) FILTER (WHERE r) AS n_role_pairs, COUNT(*) FILTER (WHERE NOT r) AS n_background_pairs, round(AVG(v) FILTER (WHERE r), 6) AS role_mean, round(AVG(v) FILTER (WHERE NOT r), 6) AS background_mean, round((AVG(v) FILTER (WHERE r)) / (AVG(v) FILTER (WHERE NOT r)), 4) AS role_kernel_enrichment FROM {t} GROUP BY 1, 2, 3"


@query("o17_role_kernel_enrichment", core(
    "SELECT * FROM (" + ROLE.format(name="secreted_like", t="ra") + ") UNION ALL SELECT * FROM (" + ROLE.format(name="membrane_contact_like", t="rb") + ")",
    "ra AS (SELECT kernel, 'spatial_ccc_score' AS score_type, sc AS v, ls >= 0.5 AS r FROM summ WHERE kernel = 'exp' UNION ALL SELECT kernel, 'model_weighted_spatial_ccc_score', mw, ls >= 0.5 FROM summ WHERE kernel = 'exp')",
    "rb AS (SELECT kernel, 'spatial_ccc_score' AS score_type, sc AS v, GREATEST(lm, rm) >= 0.5 AS r FROM summ WHERE kernel = 'contact' UNION ALL SELECT kernel, 'model_weighted_spatial_ccc_score', mw, GREATEST(lm, rm) >= 0.5 FROM summ WHERE kernel = 'contact')"))
def _(spark, sf):
    out = sp.role_kernel_enrichment(summary(spark, sf)).drop("role_score_col", "role_score_threshold")
    return out.withColumn("role_kernel_enrichment", F.round("role_kernel_enrichment", 4))


@query("o18_curated_enrichment", core("""SELECT kernel, 'spatial_ccc_score' AS score_type, COUNT(*) FILTER (WHERE c) AS n_curated_overlap_pairs, COUNT(*) FILTER (WHERE NOT c) AS n_background_pairs, round(AVG(sc) FILTER (WHERE c), 6) AS curated_overlap_mean,
  round(AVG(sc) FILTER (WHERE NOT c), 6) AS background_mean, round(AVG(CASE WHEN c THEN 1.0 ELSE 0.0 END), 6) AS curated_overlap_fraction, round((AVG(sc) FILTER (WHERE c)) / (AVG(sc) FILTER (WHERE NOT c)), 4) AS curated_overlap_enrichment
FROM (SELECT *, (ligand, receptor) IN (SELECT (ligand, receptor) FROM curated) AS c FROM summ) GROUP BY 1""", r.CURATED))
def _(spark, sf):
    out = sp.curated_overlap_enrichment(sp.annotate_curated_overlap(summary(spark, sf), r.curated_lr(spark, sf))).where("score_type = 'spatial_ccc_score'")
    return out.withColumn("curated_overlap_enrichment", F.round("curated_overlap_enrichment", 4))


DECAY = """edges AS (SELECT unnest(quantile_cont(d, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM pairs),
bins AS (SELECT lo, hi FROM (SELECT e AS lo, LEAD(e) OVER (ORDER BY e) AS hi FROM (SELECT DISTINCT e FROM edges)) WHERE hi IS NOT NULL),
wb AS (SELECT lo, hi, a.grp AS source, b.grp AS target, AVG(CASE WHEN d >= lo AND d <= hi THEN 1.0 ELSE 0.0 END) AS w FROM pairs JOIN cells a ON a.cell_id = ca JOIN cells b ON b.cell_id = cb CROSS JOIN bins GROUP BY 1, 2, 3, 4),
dec AS (SELECT ligand, receptor, lo, hi, AVG(w * s.expr * t.expr) AS m, MIN(model_score) AS ms FROM slr CROSS JOIN wb JOIN gx s ON s.gene = ligand AND s.grp = source JOIN gx t ON t.gene = receptor AND t.grp = target GROUP BY 1, 2, 3, 4)"""
DECAY_TAIL = "SELECT ligand, receptor, round(lo, 5) AS distance_min, round(hi, 5) AS distance_max, round((lo + hi) / 2, 5) AS mean_distance, round(m, 4) AS mean_spatial_ccc_score, round(m * ms, 4) AS model_weighted_mean_spatial_ccc_score FROM dec"


def _decay(spark, sf):
    # the sample bound covers all cells of the correctness scale
    return r.once(spark, sf, "decay", lambda: sp.distance_decay(labelled(spark, sf), r.scored_lr(spark, sf), means(spark, sf)))


def _rounded_decay(df):
    return df.withColumns({c: F.round(c, 5) for c in ("distance_min", "distance_max", "mean_distance")}).withColumns({c: F.round(c, 4) for c in ("mean_spatial_ccc_score", "model_weighted_mean_spatial_ccc_score")})


@query("o19_distance_decay", core(DECAY_TAIL, DECAY))
def _(spark, sf):
    return _rounded_decay(_decay(spark, sf))


@query("o24_decay_chart", core(DECAY_TAIL + " WHERE ligand || '->' || receptor IN (SELECT ligand || '->' || receptor FROM dec GROUP BY 1 ORDER BY AVG(m) DESC LIMIT 6)", DECAY))
def _(spark, sf):
    return _rounded_decay(sp.decay_chart_table(_decay(spark, sf), top_n=6).drop("pair"))


@query("o20_stratified_sample", r.with_sql(r.CELLS) + f"""
, q AS (SELECT grp, COUNT(*) AS n, LEAST(GREATEST(1, CAST(round_even(400.0 * COUNT(*) / (SELECT COUNT(*) FROM cells), 0) AS BIGINT)), COUNT(*)) AS want, ROW_NUMBER() OVER (ORDER BY grp) AS k FROM cells GROUP BY 1),
b AS (SELECT *, 400 - COALESCE(SUM(want) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem, (SELECT COUNT(*) FROM q) - k AS later FROM q),
h AS (SELECT cell_id, grp, {r.hash_long_sql("'6'", "'sample'", 'cell_id')} AS h FROM cells),
t AS (SELECT h.cell_id, h.grp FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY h, cell_id) AS rn FROM h) h JOIN b ON b.grp = h.grp WHERE rn <= LEAST(want, GREATEST(1, rem - later))),
f AS (SELECT cell_id, grp, ROW_NUMBER() OVER (ORDER BY h, cell_id) AS rn FROM h WHERE cell_id NOT IN (SELECT cell_id FROM t))
SELECT cell_id, grp AS "group" FROM t UNION ALL SELECT cell_id, grp FROM f WHERE rn <= 400 - (SELECT COUNT(*) FROM t)""")
def _(spark, sf):
    return stratified_sample(labelled(spark, sf).select("cell_id", "group"), 400, seed=6)


SECT = [
    "sc2 AS (SELECT section, grp, COUNT(*) * 1.0 AS n FROM cells GROUP BY 1, 2)",
    "ss AS (SELECT a.section, a.grp AS source, b.grp AS target, SUM(contact) AS c, SUM(ex) AS e FROM near JOIN cells a ON a.cell_id = ca JOIN cells b ON b.cell_id = cb AND a.section = b.section GROUP BY 1, 2, 3)",
    "sq AS (SELECT s.section, s.grp AS source, t.grp AS target, COALESCE(c, 0) AS c, COALESCE(e, 0) AS e, s.n AS ns, t.n AS nt FROM sc2 s JOIN sc2 t ON s.section = t.section LEFT JOIN ss ON ss.section = s.section AND ss.source = s.grp AND ss.target = t.grp)",
    "sw AS (SELECT section, source, target, 'contact' AS kernel, c / (ns * nt) AS w FROM sq UNION ALL SELECT section, source, target, 'exp', e / (ns * nt) FROM sq)",
    "sg AS (SELECT section, d.grp, gene, AVG(value) AS expr FROM dense d JOIN cells c ON c.cell_id = d.cell_id GROUP BY 1, 2, 3)",
    """per AS (SELECT w.section, ligand, receptor, kernel, AVG(s.expr * t.expr * w) AS sc, AVG(s.expr * t.expr * w) * MIN(model_score) AS mw FROM slr CROSS JOIN sw w JOIN sg s ON s.section = w.section AND s.gene = ligand AND s.grp = source
  JOIN sg t ON t.section = w.section AND t.gene = receptor AND t.grp = target GROUP BY 1, 2, 3, 4)""",
    "pr AS (SELECT *, RANK() OVER (PARTITION BY section, kernel ORDER BY round(mw, 11) DESC) AS rk FROM per)",
]


@query("o21_section_reproducibility", core("""SELECT ligand, receptor, kernel, COUNT(DISTINCT section) AS n_sections, round(AVG(sc), 6) AS section_spatial_ccc_score_mean, round(stddev_samp(sc), 6) AS section_spatial_ccc_score_sd,
  round(stddev_samp(sc) / NULLIF(abs(AVG(sc)), 0), 6) AS section_spatial_ccc_score_cv, round(AVG(mw), 6) AS section_model_weighted_spatial_ccc_score_mean, round(stddev_samp(mw), 6) AS section_model_weighted_spatial_ccc_score_sd,
  round(AVG(CASE WHEN sc > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_section_fraction, round(AVG(CASE WHEN rk <= 20 THEN 1.0 ELSE 0.0 END), 6) AS top_k_section_fraction, round(median(rk), 6) AS median_section_rank FROM pr GROUP BY 1, 2, 3""", *SECT))
def _(spark, sf):
    return sp.section_reproducibility(labelled(spark, sf), r.expression(spark, sf), r.scored_lr(spark, sf), radius=RADIUS, sigma=SIGMA, section_top_k=20)


@query("o22_validate_top_k")
def _(spark, sf):
    report = validate_spatial_lr_table(
        r.expression(spark, sf), r.cells(spark, sf), r.scored_lr(spark, sf), groupby="segment", genes=r.genes(spark, sf), radius=RADIUS, sigma=SIGMA, n_permutations=2,
        section_key="section", top_k=(10, 50), curated_lr_table=r.curated_lr(spark, sf), compute_distance_decay=False, compute_section_reproducibility=False)
    return report.top_k_enrichment
