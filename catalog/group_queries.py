"""Group expression, markers and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcomm.operators import expression as ex
from sparkcomm.operators import lr_table as lt
from sparkcomm.operators import markers as mk
from sparkcomm.plans.communication import compute_communication

from . import roles as r

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf: r.rounded(fn(spark, sf))
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# --- shared SQL pieces -------------------------------------------------------------------

SIZES = "sizes AS (SELECT grp, COUNT(*) AS n FROM cells GROUP BY 1)"
NZ = "nz AS (SELECT c.cell_id, c.grp, e.gene, e.value FROM expr e JOIN cells c ON e.cell_id = c.cell_id WHERE e.value <> 0)"
# every (cell, gene) with its zeros: what the Spark side never materialises
DENSE = """dense AS (SELECT c.cell_id, c.grp, g.gene, COALESCE(e.value, 0) AS value
  FROM cells c CROSS JOIN (SELECT DISTINCT p_brand AS gene FROM part) g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene)"""
AGG = {
    "mean": "AVG(value)",
    "median": "quantile_cont(value, 0.5)",
    "tri_mean": "(quantile_cont(value, 0.25) + 2 * quantile_cont(value, 0.5) + quantile_cont(value, 0.75)) / 4",
}
PCT = "AVG(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END)"
STEP = "CASE WHEN pct > 0.75 + 1e-12 THEN 1.0 WHEN pct > 0.5 + 1e-12 THEN 0.75 WHEN pct > 0.25 + 1e-12 THEN 0.25 ELSE 0.0 END"
CAPS = "caps AS (SELECT gene, quantile_cont(value, 0.99) AS cap FROM expr WHERE value > 0 AND cell_id IN (SELECT cell_id FROM cells) GROUP BY 1)"


def summary_sql(aggregate: str) -> str:
    """CTEs up to ``gx(grp, gene, expr, pct)`` from ``cells`` and ``expr``."""
    if aggregate in AGG:
        return f"{DENSE},\ngx AS (SELECT grp, gene, {AGG[aggregate]} AS expr, {PCT} AS pct FROM dense GROUP BY 1, 2)"
    if aggregate == "truncated_mean":
        return f"""{DENSE},
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp, gene ORDER BY value) AS rn, COUNT(*) OVER (PARTITION BY grp, gene) AS n FROM dense),
gx AS (SELECT grp, gene, AVG(value) FILTER (WHERE rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1)) AS expr, {PCT} AS pct FROM rk GROUP BY 1, 2)"""
    clipped = f"""{DENSE}, {CAPS},
gc AS (SELECT d.grp, d.gene, AVG(LEAST(d.value, c.cap)) AS m, {PCT.replace('value', 'd.value')} AS pct FROM dense d JOIN caps c ON d.gene = c.gene GROUP BY 1, 2)"""
    if aggregate == "clipped_mean":
        return clipped + ",\ngx AS (SELECT grp, gene, m AS expr, pct FROM gc)"
    return clipped + f",\ngx AS (SELECT grp, gene, CASE WHEN pct > 0 THEN m / pct * ({STEP}) ELSE 0 END AS expr, pct FROM gc)"


def complex_sql(how: str = "min") -> str:
    """``cx(grp, complex, expr, pct)`` over the distinct complexes of ``lr``."""
    value = "MIN(expr)" if how == "min" else "CASE WHEN COUNT(*) = 1 THEN MIN(expr) WHEN MIN(expr) > 0 THEN exp(AVG(ln(CASE WHEN expr > 0 THEN expr END))) ELSE 0 END"
    return f"""parts AS (SELECT complex, unnest(string_split(complex, '_')) AS gene
  FROM (SELECT ligand AS complex FROM lr UNION SELECT receptor FROM lr)),
cx AS (SELECT g.grp, p.complex, {value} AS expr, MIN(g.pct) AS pct FROM gx g JOIN parts p ON g.gene = p.gene GROUP BY 1, 2)"""


def score_sql(prob: str = "sqrt(s.expr * t.expr)", gate: str = "", joins: str = "", name: str = "inter", extra: str = "") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT s.grp AS source, t.grp AS target, lr.ligand, lr.receptor, lr.pathway, lr.annotation,
    lr.interaction_name_2, s.expr AS ligand_expr, t.expr AS receptor_expr, s.pct AS ligand_pct, t.pct AS receptor_pct, {prob} AS prob {extra}
  FROM lr JOIN cx s ON lr.ligand = s.complex JOIN cx t ON lr.receptor = t.complex {joins}
  WHERE s.expr > 0 AND s.pct >= 0.05 AND t.pct >= 0.05 AND t.expr > 0 {gate}) q WHERE prob > 0)"""


INTER_COLS = ["source", "target", "ligand", "receptor", "pathway", "ligand_expr", "receptor_expr", "ligand_pct", "receptor_pct", "prob"]


def round_cols(cols: list[str], doubles: set[str], prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" if c in doubles else f"{prefix}{c}" for c in cols)


DOUBLES = {"ligand_expr", "receptor_expr", "ligand_pct", "receptor_pct", "prob", "pvalue", "prob_std", "stability"}


def inter_tail(name: str = "inter", cols: list[str] | None = None) -> str:
    return f"SELECT {round_cols(cols or INTER_COLS, DOUBLES)} FROM {name}"


def base_sql(aggregate: str = "mean", how: str = "min", **kw: str) -> str:
    return r.with_sql(r.CELLS, r.expr_sql(), r.LR, summary_sql(aggregate), complex_sql(how), score_sql(**kw))


def base_result(spark, sf, **options):
    options = {"aggregate": "mean", **options}
    return compute_communication(
        r.expression(spark, sf), r.cells(spark, sf), r.lr_table(spark, sf), "segment", genes=r.genes(spark, sf), check=False, **options
    )


# --- D: group expression -----------------------------------------------------------------

def _grid(spark, sf, aggregate):
    labelled = ex.label_cells(r.cells(spark, sf), "segment")
    sizes = ex.group_sizes(labelled)
    out = ex.group_expression(ex.attach_groups(r.expression(spark, sf), labelled), sizes, aggregate=aggregate)
    return ex.fill_grid(out, sizes, r.genes(spark, sf))


GRID_TAIL = "SELECT grp AS \"group\", gene, round(expr, 6) AS expr, round(pct, 6) AS pct FROM gx"
for _i, _a in enumerate(["mean", "median", "tri_mean", "truncated_mean", "clipped_mean", "gated_mean"]):
    _n = ["d6_mean_and_pct", "d7_median", "d8_tri_mean", "d9_truncated_mean", "d11_clipped_mean", "d12_gated_mean"][_i]
    query(_n, r.with_sql(r.CELLS, r.expr_sql(), summary_sql(_a)) + GRID_TAIL)(lambda spark, sf, a=_a: _grid(spark, sf, a))


def _sparse_grid(spark, sf, aggregate):
    labelled = ex.label_cells(r.order_cells(spark, sf), "segment")
    sizes = ex.group_sizes(labelled)
    out = ex.group_expression(ex.attach_groups(r.order_expression(spark, sf), labelled), sizes, aggregate=aggregate)
    return ex.fill_grid(out, sizes, r.genes(spark, sf))


query("d8_tri_mean_sparse", r.with_sql(r.ORDER_CELLS, r.ORDER_EXPR, summary_sql("tri_mean")) + GRID_TAIL)(lambda s, d: _sparse_grid(s, d, "tri_mean"))
query("d9_truncated_mean_sparse", r.with_sql(r.ORDER_CELLS, r.ORDER_EXPR, summary_sql("truncated_mean")) + GRID_TAIL)(lambda s, d: _sparse_grid(s, d, "truncated_mean"))
query("d12_gated_mean_sparse", r.with_sql(r.ORDER_CELLS, r.ORDER_EXPR, summary_sql("gated_mean")) + GRID_TAIL)(lambda s, d: _sparse_grid(s, d, "gated_mean"))


@query("f12_flagship_mean", base_sql() + inter_tail())
def flagship(spark, sf):
    return base_result(spark, sf).interactions.select(*INTER_COLS)


@query("f12_flagship_tri_mean", base_sql("tri_mean") + inter_tail())
def flagship_tri(spark, sf):
    return base_result(spark, sf, aggregate="tri_mean").interactions.select(*INTER_COLS)
