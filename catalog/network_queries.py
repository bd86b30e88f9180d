"""Summaries, centrality, comparison, patterns and expression tables over scored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcomm.model import CommResult
from sparkcomm.operators import centrality as ce
from sparkcomm.operators import diff as df
from sparkcomm.operators import expression as ex
from sparkcomm.operators import expression_tables as et
from sparkcomm.operators import patterns as pt
from sparkcomm.operators import summaries as su
from sparkcomm.plans.communication import compute_communication
from sparkcomm.plans.compare import compare_samples

from . import roles as r
from .group_queries import base_result, base_sql, complex_sql, score_sql, summary_sql
from .score_queries import CENTRES, N_PERM, perm_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf: r.rounded(fn(spark, sf))
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def groups(spark, sf):
    return r.once(spark, sf, "groups", lambda: ex.label_cells(r.cells(spark, sf), "segment").select("group").distinct())


def result(spark, sf, **options) -> CommResult:
    """The scored base result, written once and shared."""
    name = f"result {sorted(options.items())}"
    box = {}

    def build():
        box["r"] = base_result(spark, sf, **options)
        return box["r"].interactions

    rows = r.once(spark, sf, name, build)
    return CommResult(rows, groups(spark, sf), groupby="segment", pvalue_cutoff=0.2)


def tested(spark, sf) -> CommResult:
    return result(spark, sf, n_permutations=N_PERM, random_state=3)


BASE = base_sql()
LABEL = "CASE WHEN trim(interaction_name_2) <> '' THEN trim(interaction_name_2) ELSE ligand || ' - ' || receptor END"

# --- G -----------------------------------------------------------------------------------

@query("g1_significant", perm_sql("SELECT source, target, ligand, receptor, round(pvalue, 6) AS pvalue FROM pv WHERE pvalue <= 0.2"))
def _(spark, sf):
    return tested(spark, sf).significant().select("source", "target", "ligand", "receptor", "pvalue")


GRID = "SELECT a.grp AS source, b.grp AS target, {v} AS value FROM (SELECT DISTINCT grp FROM cells) a CROSS JOIN (SELECT DISTINCT grp FROM cells) b LEFT JOIN {t} i ON i.source = a.grp AND i.target = b.grp {w} GROUP BY 1, 2"


@query("g2_network_prob", BASE + GRID.format(v="round(COALESCE(SUM(prob), 0), 6)", t="inter", w=""))
def _(spark, sf):
    return result(spark, sf).network()


@query("g2_network_count_pathways", BASE + GRID.format(v="CAST(COUNT(prob) AS DOUBLE)", t="inter", w="AND pathway IN ('P1', 'P2')"))
def _(spark, sf):
    return result(spark, sf).network(value="count", pathway=["P1", "P2"])


@query("g2_network_significant", perm_sql(GRID.format(v="round(COALESCE(SUM(prob), 0), 6)", t="(SELECT * FROM pv WHERE pvalue <= 0.2)", w="")))
def _(spark, sf):
    return tested(spark, sf).network(significant_only=True)


SUMM = "round(SUM(prob), 6) AS prob, COUNT(*) AS count, round(AVG(prob), 6) AS mean_prob FROM inter"


@query("g3_pathway_summary", BASE + f"SELECT pathway, {SUMM} GROUP BY 1")
def _(spark, sf):
    return result(spark, sf).pathway_summary()


@query("g4_lr_summary", BASE + f"SELECT ligand, receptor, pathway, {SUMM} GROUP BY 1, 2, 3")
def _(spark, sf):
    return result(spark, sf).lr_summary()


@query("g5_pathway_communication", BASE + f"SELECT source, target, pathway, {SUMM} GROUP BY 1, 2, 3")
def _(spark, sf):
    return su.compute_pathway_communication(result(spark, sf))


@query("g6_matrix_edges", BASE + "SELECT source, target, round(SUM(prob), 6) AS weight FROM inter GROUP BY 1, 2 ORDER BY round(SUM(prob), 9) DESC, source, target LIMIT 10")
def _(spark, sf):
    return su.matrix_edges(result(spark, sf).network(), 10)


@query("g7_filter_interactions", perm_sql("SELECT source, target, ligand, receptor, round(prob, 6) AS prob FROM pv WHERE source IN ('BUILDING', 'MACHINERY') AND target = 'FURNITURE' AND pathway IN ('P1', 'P3') AND pvalue <= 0.5"))
def _(spark, sf):
    out = su.filter_interactions(tested(spark, sf).interactions, sources=["BUILDING", "MACHINERY"], targets=["FURNITURE"], pathways=["P1", "P3"], max_pvalue=0.5)
    return out.select("source", "target", "ligand", "receptor", "prob")


@query("g8_top_interactions", BASE + f"""
, lab AS (SELECT *, {LABEL} AS interaction, source || ' -> ' || target AS pair FROM inter),
k1 AS (SELECT interaction FROM lab GROUP BY 1 ORDER BY round(SUM(prob), 9) DESC, interaction LIMIT 12),
l2 AS (SELECT * FROM lab WHERE interaction IN (SELECT interaction FROM k1)),
k2 AS (SELECT pair FROM l2 GROUP BY 1 ORDER BY round(SUM(prob), 9) DESC, pair LIMIT 6)
SELECT interaction, pair, round(prob, 6) AS prob FROM l2 WHERE pair IN (SELECT pair FROM k2)""")
def _(spark, sf):
    return su.top_interactions(result(spark, sf).interactions, top_n=12, top_pairs=6).select("interaction", "pair", "prob")


@query("g9_annotation_summary", BASE + "SELECT annotation, round(SUM(prob), 6) AS prob, COUNT(*) AS count FROM inter GROUP BY 1")
def _(spark, sf):
    return su.annotation_summary(result(spark, sf))


@query("g10_lr_contribution", BASE + f"""
, t AS (SELECT pathway, {LABEL} AS interaction, SUM(prob) AS prob FROM inter GROUP BY 1, 2),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pathway ORDER BY round(prob, 9) DESC, interaction) AS rn FROM t)
SELECT pathway, interaction, round(prob, 6) AS prob, round(prob / SUM(prob) OVER (PARTITION BY pathway), 6) AS contribution FROM k WHERE rn <= 5""")
def _(spark, sf):
    return su.lr_contribution(result(spark, sf), top_n=5)


@query("g11_pathway_flow", BASE + """
, e AS (SELECT source AS grp, pathway, prob FROM inter UNION ALL SELECT target, pathway, prob FROM inter),
f AS (SELECT grp, pathway, SUM(prob) AS prob FROM e GROUP BY 1, 2 HAVING SUM(prob) > 5),
k AS (SELECT pathway FROM f GROUP BY 1 ORDER BY round(SUM(prob), 9) DESC, pathway LIMIT 3)
SELECT grp AS "group", pathway, round(prob, 6) AS prob FROM f WHERE pathway IN (SELECT pathway FROM k)""")
def _(spark, sf):
    return su.pathway_flow(result(spark, sf), mode="all", top_n=3, min_prob=5.0)


@query("g12_gene_chord", BASE + f"""
, lab AS (SELECT *, {LABEL} AS feature FROM inter), k AS (SELECT feature FROM lab GROUP BY 1 ORDER BY round(SUM(prob), 9) DESC, feature LIMIT 8)
SELECT source, target, feature, round(SUM(prob), 6) AS prob, COUNT(*) AS count FROM lab WHERE feature IN (SELECT feature FROM k) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return su.gene_chord_table(result(spark, sf), top_n=8)


@query("g13_individual_interaction", BASE + """
, k AS (SELECT ligand, receptor, pathway FROM inter WHERE pathway = 'P2' GROUP BY 1, 2, 3 ORDER BY round(SUM(prob), 9) DESC, 1, 2, 3 LIMIT 1)
SELECT source, target, ligand, receptor, round(prob, 6) AS prob FROM inter WHERE (ligand, receptor, pathway) IN (SELECT (ligand, receptor, pathway) FROM k)""")
def _(spark, sf):
    return su.individual_interaction(result(spark, sf), pathway="P2").select("source", "target", "ligand", "receptor", "prob")


ROLE = """, s AS (SELECT pathway, source AS grp, SUM(prob) AS v FROM inter GROUP BY 1, 2),
g AS (SELECT p.pathway, c.grp, COALESCE(v, 0) AS v FROM (SELECT DISTINCT pathway FROM inter) p CROSS JOIN (SELECT DISTINCT grp FROM cells) c LEFT JOIN s ON s.pathway = p.pathway AND s.grp = c.grp)
"""


@query("g14_role_matrix", BASE + ROLE + 'SELECT pathway, grp AS "group", round(v / MAX(v) OVER (PARTITION BY pathway), 6) AS strength FROM g')
def _(spark, sf):
    return su.signaling_role_matrix(result(spark, sf), row_scale=True)


@query("g15_role_scatter", BASE + """
, e AS (SELECT source, target, SUM(prob) AS p FROM inter GROUP BY 1, 2)
SELECT grp AS "group", round(SUM(CASE WHEN source = grp THEN p ELSE 0 END), 6) AS outgoing, round(SUM(CASE WHEN target = grp THEN p ELSE 0 END), 6) AS incoming,
  SUM(CASE WHEN source = grp THEN 1 ELSE 0 END) + SUM(CASE WHEN target = grp THEN 1 ELSE 0 END) AS link_count
FROM (SELECT DISTINCT grp FROM cells), e GROUP BY 1""")
def _(spark, sf):
    return su.signaling_role_scatter_table(result(spark, sf))


@query("g17_pathway_pairs", BASE + """
, lab AS (SELECT *, source || ' -> ' || target AS pair FROM inter), k AS (SELECT pair FROM lab GROUP BY 1 ORDER BY round(SUM(prob), 9) DESC, pair LIMIT 7)
SELECT pathway, pair, round(SUM(prob), 6) AS prob FROM lab WHERE pair IN (SELECT pair FROM k) GROUP BY 1, 2""")
def _(spark, sf):
    return su.pathway_pair_matrix(result(spark, sf), top_pairs=7)


@query("g18_pvalue_size", perm_sql("SELECT source, target, ligand, receptor, round(-log10(pvalue), 6) AS size FROM pv"))
def _(spark, sf):
    return tested(spark, sf).interactions.select("source", "target", "ligand", "receptor", su.pvalue_size().alias("size"))


@query("g19_spatial_edges", base_sql().replace("inter AS", CENTRES + ",\ninter AS") + """
SELECT i.source, i.target, round(weight, 6) AS weight, round(s.cx, 6) AS source_x, round(s.cy, 6) AS source_y, round(t.cx, 6) AS target_x, round(t.cy, 6) AS target_y
FROM (SELECT source, target, SUM(prob) AS weight FROM inter GROUP BY 1, 2) i JOIN cent s ON s.grp = i.source JOIN cent t ON t.grp = i.target""")
def _(spark, sf):
    return su.spatial_edge_table(ex.label_cells(r.cells(spark, sf), "segment"), result(spark, sf).network())


# --- H: trade between nations, one network per market segment --------------------------------

def _trade(spark, sf):
    """Supplier nation to customer nation trade, one network per order status."""
    l = r.read(spark, sf, "lineitem").join(r.read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    l = l.join(r.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(r.read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return l.groupBy(
        F.col("o_orderstatus").alias("network_id"), F.concat(F.lit("N"), "s_nationkey").alias("source"), F.concat(F.lit("N"), "c_nationkey").alias("target")
    ).agg((F.sum("l_extendedprice") / 1e6).alias("value"))


def trade(spark, sf):
    return r.once(spark, sf, "trade", lambda: _trade(spark, sf))


TRADE = """net AS (SELECT o_orderstatus AS id, 'N' || s_nationkey AS i, 'N' || c_nationkey AS j, SUM(l_extendedprice) / 1e6 AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
nodes AS (SELECT id, i AS n FROM net UNION SELECT id, j FROM net)"""


@query("h1_strengths", r.with_sql(TRADE) + """SELECT nodes.id AS network_id, n AS "group", round((SELECT COALESCE(SUM(v), 0) FROM net WHERE net.id = nodes.id AND i = n), 5) AS outgoing,
  round((SELECT COALESCE(SUM(v), 0) FROM net WHERE net.id = nodes.id AND j = n), 5) AS incoming FROM nodes""")
def _(spark, sf):
    return ce.strengths(trade(spark, sf)).select("network_id", "group", F.round("outgoing", 5).alias("outgoing"), F.round("incoming", 5).alias("incoming"))


GOOGLE = """cnt AS (SELECT id, COUNT(*) AS c FROM nodes GROUP BY 1), outs AS (SELECT id, i, SUM(v) AS o FROM net GROUP BY 1, 2),
gm AS (SELECT a.id, a.n AS i, b.n AS j, 0.85 * CASE WHEN o IS NULL THEN 1.0 / c ELSE COALESCE(v, 0) / o END + 0.15 / c AS m
  FROM nodes a JOIN nodes b ON a.id = b.id JOIN cnt ON cnt.id = a.id LEFT JOIN outs ON outs.id = a.id AND outs.i = a.n
  LEFT JOIN net ON net.id = a.id AND net.i = a.n AND net.j = b.n),
x0 AS (SELECT nodes.id, n, 1.0 / c AS x FROM nodes JOIN cnt USING (id))"""


def _power(rounds: int) -> str:
    return ",\n".join(f"x{k} AS MATERIALIZED (SELECT g.id, g.j AS n, SUM(x * m) AS x FROM gm g JOIN x{k - 1} y ON g.id = y.id AND g.i = y.n GROUP BY 1, 2)" for k in range(1, rounds + 1))


@query("h2_pagerank", r.with_sql(TRADE, GOOGLE, _power(50)) + 'SELECT id AS network_id, n AS "group", round(x, 6) AS pagerank FROM x50')
def _(spark, sf):
    return ce.pagerank(trade(spark, sf))


def _hits(rounds: int) -> str:
    steps = [
        "bb AS MATERIALIZED (SELECT a.id, a.i, b.i AS j, SUM(a.v * b.v) AS m FROM net a JOIN net b ON a.id = b.id AND a.j = b.j GROUP BY 1, 2, 3)",
        "h0 AS (SELECT id, n, 1.0 AS x FROM nodes)",
    ]
    for k in range(1, rounds + 1):
        steps.append(f"h{k} AS MATERIALIZED (SELECT id, n, x / SUM(x) OVER (PARTITION BY id) AS x FROM (SELECT b.id, b.i AS n, SUM(m * x) AS x FROM bb b JOIN h{k - 1} y ON b.id = y.id AND b.j = y.n GROUP BY 1, 2))")
    return ",\n".join(steps)


@query("h3_hits", r.with_sql(TRADE, _hits(30)) + """, au AS (SELECT id, n, a / SUM(a) OVER (PARTITION BY id) AS a FROM (SELECT net.id, j AS n, SUM(v * x) AS a FROM net JOIN h30 ON net.id = h30.id AND net.i = h30.n GROUP BY 1, 2))
SELECT nodes.id AS network_id, nodes.n AS "group", round(COALESCE(x, 0), 6) AS hub, round(COALESCE(a, 0), 6) AS authority FROM nodes LEFT JOIN h30 USING (id, n) LEFT JOIN au USING (id, n)""")
def _(spark, sf):
    return ce.hits(trade(spark, sf))


def _between(hops: int) -> str:
    steps = ["e AS (SELECT id, i, j, v FROM net WHERE v > 0 AND i <> j)", "d0 AS (SELECT id, i, j, v FROM e UNION ALL SELECT id, n, n, 0 FROM nodes)"]
    for k in range(1, 6):
        steps.append(f"d{k} AS MATERIALIZED (SELECT a.id, a.i, b.j, MIN(a.v + b.v) AS v FROM d{k - 1} a JOIN d{k - 1} b ON a.id = b.id AND a.j = b.i GROUP BY 1, 2, 3)")
    steps.append("""tight AS MATERIALIZED (SELECT a.id, a.i, e.i AS k, e.j FROM d5 a JOIN e ON e.id = a.id AND e.i = a.j JOIN d5 b ON b.id = a.id AND b.i = a.i AND b.j = e.j
      WHERE abs(a.v + e.v - b.v) <= 1e-9 * greatest(abs(a.v + e.v), abs(b.v)))""")
    steps.append("p0 AS (SELECT id, n AS i, n AS j, 1.0 AS c FROM nodes)")
    for k in range(1, hops + 1):
        steps.append(f"p{k} AS MATERIALIZED (SELECT t.id, t.i, t.j, SUM(c) AS c FROM p{k - 1} p JOIN tight t ON t.id = p.id AND t.i = p.i AND t.k = p.j GROUP BY 1, 2, 3)")
    steps.append("sg AS MATERIALIZED (SELECT x.id, x.i, x.j, SUM(c) AS c, MIN(d5.v) AS v FROM (" + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(hops + 1)) + ") x JOIN d5 ON d5.id = x.id AND d5.i = x.i AND d5.j = x.j GROUP BY 1, 2, 3)")
    return ",\n".join(steps)


@query("h4_betweenness", r.with_sql(TRADE, _between(12)) + """, b AS (SELECT a.id, a.j AS n, SUM(a.c * z.c / st.c) AS b FROM sg a JOIN sg z ON z.id = a.id AND z.i = a.j JOIN sg st ON st.id = a.id AND st.i = a.i AND st.j = z.j
  WHERE a.i <> a.j AND z.i <> z.j AND a.i <> z.j AND abs(a.v + z.v - st.v) <= 1e-9 * greatest(abs(a.v + z.v), abs(st.v)) GROUP BY 1, 2)
SELECT nodes.id AS network_id, nodes.n AS "group", round(COALESCE(b, 0) / ((c - 1) * (c - 2)), 6) AS betweenness
FROM nodes JOIN (SELECT id, COUNT(*) AS c FROM nodes GROUP BY 1) USING (id) LEFT JOIN b USING (id, n)""")
def _(spark, sf):
    return ce.betweenness(trade(spark, sf))


@query("h5_centrality_network")
def _(spark, sf):
    net = result(spark, sf).network().withColumn("network_id", F.lit("all"))
    return ce.centrality_network(net)


@query("h6_signaling_roles", r.with_sql(TRADE) + """, t AS (SELECT nodes.id, n, (SELECT COALESCE(SUM(v), 0) FROM net WHERE net.id = nodes.id AND i = n) AS o, (SELECT COALESCE(SUM(v), 0) FROM net WHERE net.id = nodes.id AND j = n) AS i FROM nodes),
l AS (SELECT id, n, 'sender' AS role, o AS value FROM t UNION ALL SELECT id, n, 'receiver', i FROM t)
SELECT id AS network_id, n AS "group", role, round(value / MAX(value) OVER (PARTITION BY id, role), 6) AS value FROM l""")
def _(spark, sf):
    return ce.signaling_role_table(trade(spark, sf), roles=["sender", "receiver"])


@query("h6_signaling_roles_all")
def _(spark, sf):
    return ce.signaling_role_table(trade(spark, sf))


# --- I: returned against accepted purchases ---------------------------------------------------

def diff_of(spark, sf):
    def side(flag):
        rows = r.once(spark, sf, f"result flag {flag}", lambda: compute_communication(
            r.expression(spark, sf, flag), r.cells(spark, sf), r.lr_table(spark, sf), "segment", genes=r.genes(spark, sf), aggregate="mean", min_expr=13.5, condition=flag, check=False).interactions)
        return CommResult(rows, groups(spark, sf), condition=flag)

    return df.compare_communication(side("R"), side("A"), check=False)


def _side_sql(flag: str, tag: str) -> list[str]:
    body = summary_sql("mean").replace("dense", f"dense{tag}").replace("gx AS", f"gx{tag} AS").replace("JOIN expr", f"JOIN expr{tag}")
    cx = complex_sql().split("cx AS")[1]
    return [
        r.expr_sql(flag, f"expr{tag}"),
        body,
        f"cx{tag} AS" + cx.replace("FROM gx g", f"FROM gx{tag} g"),
        score_sql(name=f"inter{tag}", gate="AND s.expr > 13.5 AND t.expr > 13.5").replace("JOIN cx s", f"JOIN cx{tag} s").replace("JOIN cx t", f"JOIN cx{tag} t"),
    ]


PARTS = complex_sql().split("cx AS")[0].rstrip().rstrip(",")
MERGED = """mg AS (SELECT source, target, ligand, receptor, pathway, COALESCE(a.prob, 0) AS prob_a, COALESCE(b.prob, 0) AS prob_b,
    COALESCE(a.ligand_expr, 0) AS ligand_expr_a, COALESCE(b.ligand_expr, 0) AS ligand_expr_b
  FROM interr a FULL JOIN intera b USING (source, target, ligand, receptor, pathway)),
md AS (SELECT *, prob_a - prob_b AS d, prob_a > 0 AND prob_b <= 0 AS is_new, prob_a <= 0 AND prob_b > 0 AS is_lost FROM mg)"""
DIFF = r.with_sql(r.CELLS, r.LR, PARTS, *_side_sql("R", "r"), *_side_sql("A", "a"), MERGED)
DIR = "CASE WHEN {d} > 0 THEN 'R' WHEN {d} < 0 THEN 'A' ELSE 'unchanged' END AS direction"


@query("i1_compare_communication", DIFF + f"""SELECT source, target, ligand, receptor, pathway, round(prob_a, 6) AS prob_a, round(prob_b, 6) AS prob_b, round(ligand_expr_a, 6) AS ligand_expr_a,
  round(ligand_expr_b, 6) AS ligand_expr_b, round(d, 6) AS delta_prob, round(abs(d), 6) AS abs_delta_prob, round(log2((prob_a + 1e-9) / (prob_b + 1e-9)), 6) AS log2fc,
  is_new, is_lost, {DIR.format(d='d')} FROM md""")
def _(spark, sf):
    cols = "source target ligand receptor pathway prob_a prob_b ligand_expr_a ligand_expr_b delta_prob abs_delta_prob log2fc is_new is_lost direction".split()
    return diff_of(spark, sf).interactions.select(*cols)


def _changes_sql(keys: str) -> str:
    return f"""SELECT {keys}, round(pa, 6) AS prob_a, round(pb, 6) AS prob_b, ca AS count_a, cb AS count_b, nn AS new_count, nl AS lost_count, round(pa - pb, 6) AS delta_prob,
  round(abs(pa - pb), 6) AS abs_delta_prob, round(log2((pa + 1e-9) / (pb + 1e-9)), 6) AS log2fc, ca - cb AS delta_count, {DIR.format(d='pa - pb')}
FROM (SELECT {keys}, SUM(prob_a) AS pa, SUM(prob_b) AS pb, COUNT(*) FILTER (WHERE prob_a > 0) AS ca, COUNT(*) FILTER (WHERE prob_b > 0) AS cb,
  COUNT(*) FILTER (WHERE is_new) AS nn, COUNT(*) FILTER (WHERE is_lost) AS nl FROM md GROUP BY {keys})"""


query("i2_pathway_changes", DIFF + _changes_sql("pathway"))(lambda s, d: diff_of(s, d).pathway_changes)
query("i2_source_target_changes", DIFF + _changes_sql("source, target"))(lambda s, d: diff_of(s, d).source_target_changes)


@query("i3_differential_network", DIFF + """SELECT a.grp AS source, b.grp AS target, round(COALESCE(SUM(prob_a), 0), 6) AS network_a, round(COALESCE(SUM(prob_b), 0), 6) AS network_b,
  round(COALESCE(SUM(prob_a), 0) - COALESCE(SUM(prob_b), 0), 6) AS network_delta, CAST(COUNT(*) FILTER (WHERE prob_a > 0) - COUNT(*) FILTER (WHERE prob_b > 0) AS DOUBLE) AS count_delta
FROM (SELECT DISTINCT grp FROM cells) a CROSS JOIN (SELECT DISTINCT grp FROM cells) b LEFT JOIN md ON source = a.grp AND target = b.grp GROUP BY 1, 2""")
def _(spark, sf):
    return diff_of(spark, sf).networks.drop("count_a", "count_b")


@query("i4_align_intersection", DIFF + """SELECT source, target, COUNT(*) AS n FROM interr WHERE source IN (SELECT source FROM intera WHERE pathway = 'P1') AND target IN (SELECT source FROM intera WHERE pathway = 'P1') GROUP BY 1, 2""")
def _(spark, sf):
    d = diff_of(spark, sf)
    other = d.b.with_(groups=d.b.interactions.where("pathway = 'P1'").select(F.col("source").alias("group")).distinct())
    left, _ = df.align_results(d.a, other, "intersection")
    return left.interactions.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@query("i5_compare_samples", DIFF + "SELECT pathway, round(SUM(prob_a), 6) AS prob_a, round(SUM(prob_b), 6) AS prob_b FROM md GROUP BY 1")
def _(spark, sf):
    c = r.cells(spark, sf)
    out = compare_samples((r.expression(spark, sf, "R"), c), (r.expression(spark, sf, "A"), c), r.lr_table(spark, sf), "segment", label_a="R", label_b="A", genes=r.genes(spark, sf), aggregate="mean", min_expr=13.5, check=False)
    return out.pathway_changes.select("pathway", "prob_a", "prob_b")


@query("i6_signaling_changes", DIFF + f"""SELECT pathway, round(oa, 6) AS outgoing_a, round(ob, 6) AS outgoing_b, round(ia, 6) AS incoming_a, round(ib, 6) AS incoming_b, round(oa - ob, 6) AS delta_outgoing, round(ia - ib, 6) AS delta_incoming,
  round(oa - ob + ia - ib, 6) AS delta_total, round(abs(oa - ob) + abs(ia - ib), 6) AS abs_delta_total, {DIR.format(d='(oa - ob + ia - ib)')}
FROM (SELECT pathway, SUM(CASE WHEN source = 'BUILDING' THEN prob_a ELSE 0 END) AS oa, SUM(CASE WHEN source = 'BUILDING' THEN prob_b ELSE 0 END) AS ob,
  SUM(CASE WHEN target = 'BUILDING' THEN prob_a ELSE 0 END) AS ia, SUM(CASE WHEN target = 'BUILDING' THEN prob_b ELSE 0 END) AS ib FROM md GROUP BY 1)""")
def _(spark, sf):
    return df.signaling_changes(diff_of(spark, sf), "BUILDING")


@query("i7_rank_signaling_compare", DIFF + """SELECT ligand || ' - ' || receptor AS interaction, round(SUM(prob_a), 6) AS prob_a, round(SUM(prob_b), 6) AS prob_b, round(SUM(prob_a) + SUM(prob_b), 6) AS total
FROM md GROUP BY 1 ORDER BY round(SUM(prob_a) + SUM(prob_b), 9) DESC, interaction LIMIT 25""")
def _(spark, sf):
    return df.rank_signaling_compare(diff_of(spark, sf), level="lr", top_n=25)


@query("i8_diff_rank", DIFF + "SELECT pathway, round(SUM(d), 6) AS delta_prob FROM md GROUP BY 1 HAVING SUM(d) <> 0 ORDER BY round(abs(SUM(d)), 9) DESC, pathway LIMIT 4")
def _(spark, sf):
    return df.diff_rank(diff_of(spark, sf).pathway_changes, top_n=4).select("pathway", "delta_prob")


@query("i9_compare_interactions", DIFF + "SELECT 'R' AS condition, round(SUM(prob_a), 5) AS value FROM md UNION ALL SELECT 'A', round(SUM(prob_b), 5) FROM md")
def _(spark, sf):
    return df.compare_interactions(diff_of(spark, sf)).withColumn("value", F.round("value", 5))


@query("i10_diff_top_pairs", DIFF + """, p AS (SELECT *, source || ' -> ' || target AS pair FROM md), k AS (SELECT pair FROM p GROUP BY 1 ORDER BY round(SUM(abs(d)), 9) DESC, pair LIMIT 5)
SELECT pair, ligand, receptor, round(d, 6) AS delta_prob FROM p WHERE pair IN (SELECT pair FROM k)""")
def _(spark, sf):
    return df.diff_top_pairs(diff_of(spark, sf), 5).select("pair", "ligand", "receptor", "delta_prob")


@query("i11_information_flow", DIFF + """, s AS (SELECT pathway, SUM(prob_a) / 3000 AS a, SUM(prob_b) / 3000 AS b FROM md GROUP BY 1)
, z AS (SELECT *, CASE WHEN a > 0 AND a < 1 THEN -1 / ln(a) ELSE 0 END AS fa, CASE WHEN b > 0 AND b < 1 THEN -1 / ln(b) ELSE 0 END AS fb,
  CASE WHEN a >= 1 THEN SUM(CASE WHEN a >= 1 THEN 1 ELSE 0 END) OVER (ORDER BY a, pathway) - 1 END AS ra, CASE WHEN b >= 1 THEN SUM(CASE WHEN b >= 1 THEN 1 ELSE 0 END) OVER (ORDER BY b, pathway) - 1 END AS rb FROM s)
, m AS (SELECT CASE WHEN MAX(fa) > 0 THEN MAX(fa) ELSE 1 END AS ta, CASE WHEN MAX(fb) > 0 THEN MAX(fb) ELSE 1 END AS tb, COUNT(ra) AS na, COUNT(rb) AS nb FROM z)
, f AS (SELECT pathway, a, b, CASE WHEN a >= 1 THEN ta * (1.1 + CASE WHEN na > 1 THEN 0.4 * ra / (na - 1) ELSE 0 END) ELSE fa END AS flow_a,
   CASE WHEN b >= 1 THEN tb * (1.1 + CASE WHEN nb > 1 THEN 0.4 * rb / (nb - 1) ELSE 0 END) ELSE fb END AS flow_b FROM z, m)
SELECT pathway, round(a, 6) AS prob_a, round(b, 6) AS prob_b, round(flow_a, 6) AS flow_a, round(flow_b, 6) AS flow_b, round(flow_a + flow_b, 6) AS total,
  round(a / (a + b), 6) AS share_a, round(b / (a + b), 6) AS share_b FROM f""")
def _(spark, sf):
    d = diff_of(spark, sf)
    small = lambda res: res.with_(interactions=res.interactions.withColumn("prob", F.col("prob") / 3000))
    return df.information_flow(df.compare_communication(small(d.a), small(d.b), check=False))


@query("g16_role_compare", DIFF + """, s AS (SELECT 'R' AS condition, pathway, source AS grp, SUM(prob) AS v FROM interr GROUP BY 1, 2, 3 UNION ALL SELECT 'A', pathway, source, SUM(prob) FROM intera GROUP BY 1, 2, 3),
t AS (SELECT pathway, SUM(v) AS total FROM s GROUP BY 1)
SELECT c.condition, t.pathway, g.grp AS "group", round(COALESCE(v, 0), 6) AS strength, round(total, 5) AS pathway_total FROM t CROSS JOIN (SELECT DISTINCT grp FROM cells) g CROSS JOIN (SELECT 'R' AS condition UNION ALL SELECT 'A') c
LEFT JOIN s ON s.condition = c.condition AND s.pathway = t.pathway AND s.grp = g.grp""")
def _(spark, sf):
    return su.role_compare_table(diff_of(spark, sf)).withColumn("pathway_total", F.round("pathway_total", 5))


# --- J -----------------------------------------------------------------------------------

@query("j1_pattern_matrix", BASE + """, s AS (SELECT grp, pathway, SUM(prob) AS v FROM (SELECT source AS grp, pathway, prob FROM inter UNION ALL SELECT target, pathway, prob FROM inter) GROUP BY 1, 2)
SELECT c.grp AS "group", p.pathway, round(COALESCE(v, 0), 6) AS value FROM (SELECT DISTINCT grp FROM cells) c CROSS JOIN (SELECT DISTINCT pathway FROM s) p LEFT JOIN s ON s.grp = c.grp AND s.pathway = p.pathway""")
def _(spark, sf):
    return pt.communication_pattern_matrix(result(spark, sf), mode="all")


@query("j2_patterns_group")
def _(spark, sf):
    return pt.compute_communication_patterns(result(spark, sf), n_patterns=2).group_pattern


@query("j3_j4_pattern_number")
def _(spark, sf):
    sel = pt.select_communication_pattern_number(result(spark, sf), k_range=(1, 2, 3), n_runs=2, max_iter=8)
    return pt.recommended_k(sel)


VEC = """vec AS (SELECT pathway, source, target, SUM(prob) AS v FROM inter GROUP BY 1, 2, 3),
cut AS (SELECT pathway, quantile_cont(v, 0.2) AS c FROM vec WHERE v > 0 GROUP BY 1),
tv AS (SELECT vec.* FROM vec JOIN cut USING (pathway) WHERE v >= c)"""


@query("j5_network_vectors", BASE + ", " + VEC + "SELECT pathway, ROW_NUMBER() OVER (PARTITION BY pathway ORDER BY v DESC, source, target) - 1 AS coord, round(v, 6) AS v FROM tv")
def _(spark, sf):
    out = pt.pathway_network_vectors(result(spark, sf).interactions, similarity="structural", thresh=0.2)
    return out.withColumn("coord", F.col("coord").cast("bigint"))


@query("j6_pathway_similarity", BASE + ", " + VEC + """, nn AS (SELECT pathway, sqrt(SUM(v * v)) AS n FROM vec GROUP BY 1)
SELECT a.pathway AS pathway_a, b.pathway AS pathway_b, round(CASE WHEN a.pathway = b.pathway THEN 1 ELSE LEAST(1, SUM(a.v * b.v) / (MIN(na.n) * MIN(nb.n))) END, 6) AS similarity
FROM vec a JOIN vec b ON a.source = b.source AND a.target = b.target JOIN nn na ON na.pathway = a.pathway JOIN nn nb ON nb.pathway = b.pathway GROUP BY a.pathway, b.pathway""")
def _(spark, sf):
    return pt.compute_pathway_similarity(result(spark, sf))


@query("j7_remove_isolates", BASE + ", " + VEC + """, nn AS (SELECT pathway, sqrt(SUM(v * v)) AS n FROM tv GROUP BY 1),
sim AS (SELECT a.pathway AS pa, b.pathway AS pb, CASE WHEN a.pathway = b.pathway THEN 1 ELSE LEAST(1, SUM(a.v * b.v) / (MIN(na.n) * MIN(nb.n))) END AS s
FROM tv a JOIN tv b ON a.source = b.source AND a.target = b.target JOIN nn na ON na.pathway = a.pathway JOIN nn nb ON nb.pathway = b.pathway GROUP BY a.pathway, b.pathway),
kp AS (SELECT pa FROM sim GROUP BY 1 HAVING SUM(s) > 1 + 1e-12)
SELECT pa AS pathway_a, pb AS pathway_b, round(s, 6) AS similarity FROM sim WHERE pa IN (SELECT pa FROM kp) AND pb IN (SELECT pa FROM kp)""")
def _(spark, sf):
    return pt.remove_isolates(pt.compute_pathway_similarity(result(spark, sf), thresh=0.2))


@query("j8_pathway_embedding")
def _(spark, sf):
    return pt.compute_pathway_embedding(result(spark, sf))


@query("j9_clusters_kmeans")
def _(spark, sf):
    return pt.compute_pathway_clusters(result(spark, sf), method="kmeans", n_clusters=2)


@query("j10_j11_clusters_spectral")
def _(spark, sf):
    return pt.compute_pathway_clusters(result(spark, sf), method="spectral", thresh=0.2)


@query("j12_pairwise_embedding")
def _(spark, sf):
    return pt.pairwise_pathway_embedding(diff_of(spark, sf))


@query("j13_rank_pathway_similarity")
def _(spark, sf):
    return pt.rank_pathway_similarity(diff_of(spark, sf))


@query("j14_top_loadings", BASE + """, t AS (SELECT source AS grp, pathway, SUM(prob) AS w FROM inter GROUP BY 1, 2), k AS (SELECT pathway FROM t GROUP BY 1 ORDER BY round(MAX(w), 9) DESC, pathway LIMIT 3)
SELECT grp AS pattern, pathway, round(w, 6) AS weight FROM t WHERE pathway IN (SELECT pathway FROM k)""")
def _(spark, sf):
    flows = su.pathway_flow(result(spark, sf)).select(F.col("group").alias("pattern"), "pathway", F.col("prob").alias("weight"))
    return pt.top_loadings(flows, "pathway", 3, "max")


# --- K -----------------------------------------------------------------------------------

@query("k1_expression_frame", r.with_sql(r.CELLS, r.expr_sql(), summary_sql("mean")) + """, z AS (SELECT grp, gene, expr, pct, AVG(expr) OVER (PARTITION BY gene) AS m, stddev_pop(expr) OVER (PARTITION BY gene) AS sd FROM gx)
SELECT z.grp AS "group", gene, round(expr, 6) AS mean_expression, round(pct, 6) AS pct_expressed, n_cells, round(GREATEST(LEAST(CASE WHEN sd > 0 THEN (expr - m) / sd ELSE 0 END, 1.5), -1.5), 6) AS scaled_expression
FROM z JOIN (SELECT grp, COUNT(*) AS n_cells FROM cells GROUP BY 1) c ON c.grp = z.grp""")
def _(spark, sf):
    return et.signaling_expression_frame(r.expression(spark, sf), r.cells(spark, sf), "segment", r.genes(spark, sf), scale_min=-1.5, scale_max=1.5)


@query("k2_expression_values", r.with_sql(r.CELLS, r.expr_sql()) + """SELECT c.cell_id, c.grp AS "group", g.gene, round(COALESCE(value, 0), 6) AS expression FROM cells c CROSS JOIN (SELECT DISTINCT p_brand AS gene FROM part) g
LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene""")
def _(spark, sf):
    return et.signaling_expression_values(r.expression(spark, sf), r.cells(spark, sf), "segment", r.genes(spark, sf))


@query("k3_signaling_genes", perm_sql("SELECT DISTINCT unnest(string_split(x, '_')) AS gene FROM (SELECT ligand AS x FROM pv WHERE pvalue <= 0.2 AND pathway = 'P2' UNION ALL SELECT receptor FROM pv WHERE pvalue <= 0.2 AND pathway = 'P2')"))
def _(spark, sf):
    return et.select_signaling_genes(r.genes(spark, sf), result=tested(spark, sf), signaling=["P2"])
