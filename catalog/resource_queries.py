"""LR tables, training resources, protein tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcomm.functions import text as tx
from sparkcomm.model import CommResult
from sparkcomm.operators import lr_table as lt
from sparkcomm.operators import proteins as pr
from sparkcomm.operators import resources as rs
from sparkcomm.sources import readers as rd
from sparkcomm.sources import writers as wr

from . import roles as r
from .group_queries import base_sql
from .network_queries import result

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def keep(fn):
        QUERIES[name] = lambda spark, sf: r.rounded(fn(spark, sf))
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


# --- supplies: which supplier nation ships which brand of which type --------------------------

def _supplies(spark, sf):
    l = r.read(spark, sf, "lineitem").join(r.read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    l = l.join(r.read(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(r.read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    l = l.join(r.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return l.select(
        F.concat(F.lit(" "), "p_brand").alias("source_genesymbol"), "p_type", F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
        F.concat_ws("|", "r_name", F.concat(F.lit("flag "), "l_returnflag")).alias("sources"),
        F.when(F.col("l_linenumber") <= 2, "").otherwise(F.concat(F.lit("PMID:"), F.col("l_linenumber").cast("string"))).alias("references"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("category_intercell_source"), F.col("p_type").alias("target_genesymbol"),
        F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("qty"),
    )


def supplies(spark, sf):
    return r.once(spark, sf, "supplies", lambda: _supplies(spark, sf))


SUP = """sup AS (SELECT p_brand AS lig, p_type AS rec, n_name AS nation, r_name AS region, r_name || '|flag ' || l_returnflag AS sources,
   CASE WHEN l_linenumber <= 2 THEN '' ELSE 'PMID:' || CAST(l_linenumber AS VARCHAR) END AS refs, 'size ' || CAST(p_size AS VARCHAR) AS cat, l_linestatus AS status, l_quantity AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

# --- A, B --------------------------------------------------------------------------------

@query("a1_a2_load_lr", """SELECT p_brand AS ligand, p_type AS receptor, CAST(p_size AS VARCHAR) AS pathway, arg_min(p_name, p_partkey) AS annotation, '' AS evidence, 'part' AS lr_name FROM part GROUP BY 1, 2, 3""")
def _(spark, sf):
    lr = rd.load_lr_table(spark, f"{sf}/part.parquet", ligand_col="p_brand", receptor_col="p_type", pathway_col="p_size", annotation_col="p_name")
    return lr.interactions.select("ligand", "receptor", "pathway", "annotation", "evidence", F.lit(lr.name).alias("lr_name"))


@query("a4_select_layer", r.with_sql(r.expr_sql("R", "e")) + "SELECT lower(gene) AS gene, COUNT(*) AS n, round(SUM(value), 6) AS total FROM e GROUP BY 1")
def _(spark, sf):
    from sparkcomm.operators.expression import select_expression

    both = r.expression(spark, sf).withColumn("layer", F.lit(None).cast("string")).unionByName(r.expression(spark, sf, "R").withColumn("layer", F.lit("returned")))
    names = r.genes(spark, sf).withColumn("symbol", F.lower("gene"))
    out = select_expression(both, layer="returned", genes=names, gene_symbols_key="symbol")
    return out.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("a6_lr_from_db_tables", """WITH i AS (SELECT DISTINCT p_brand AS ligand, p_type AS receptor, 'S' || CAST(p_size AS VARCHAR) AS pathway FROM part),
t AS (SELECT p_type AS name, MIN(p_brand) || '_' || MAX(p_brand) AS parts FROM part GROUP BY 1)
SELECT ligand, COALESCE(t.parts, i.receptor) AS receptor, pathway, MIN(COALESCE(t.parts, '')) AS agonist_genes, MIN(i.receptor) AS raw_receptor FROM i LEFT JOIN t ON i.receptor = t.name GROUP BY 1, 2, 3""")
def _(spark, sf):
    p = r.read(spark, sf, "part")
    inter = p.select(F.col("p_brand").alias("ligand"), F.col("p_type").alias("receptor"), F.concat(F.lit("S"), F.col("p_size").cast("string")).alias("pathway_name"), F.col("p_type").alias("agonist")).distinct()
    cx = p.groupBy(F.col("p_type").alias("name")).agg(F.min("p_brand").alias("subunit_1"), F.lit(" ").alias("subunit_2"), F.max("p_brand").alias("subunit_3"))
    return rd.lr_from_db_tables(inter, cx, cx).interactions.select("ligand", "receptor", "pathway", "agonist_genes", "raw_receptor")


@query("a7_lr_from_intercell", r.with_sql(SUP) + """SELECT DISTINCT lig AS ligand, rec AS receptor, CASE WHEN 'flag ' < region THEN (CASE WHEN region < split_part(sources, '|', 2) THEN region ELSE sources END) ELSE sources END AS pathway, 'OmniPath' AS annotation FROM sup""".replace(
    "CASE WHEN 'flag ' < region THEN (CASE WHEN region < split_part(sources, '|', 2) THEN region ELSE sources END) ELSE sources END", "sources"))
def _(spark, sf):
    raw = supplies(spark, sf).withColumn("category_intercell_target", F.col("region"))
    out = rd.lr_from_intercell(raw.drop("category_intercell_source"), pathway_mode="resource")
    return out.select("ligand", "receptor", "pathway", "annotation")


@query("a8_rank_aggregate", r.with_sql(SUP) + """SELECT nation AS source, region AS target, lig AS ligand, rec AS receptor, round(1 / (AVG(qty) + 1e-9), 6) AS prob, round(MIN(qty) / 100, 6) AS pvalue, 'liana' AS pathway FROM sup GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    raw = supplies(spark, sf).groupBy(F.col("nation").alias("source"), F.col("region").alias("target"), F.trim("source_genesymbol").alias("ligand_complex"), F.col("p_type").alias("receptor_complex"))
    raw = raw.agg(F.avg("qty").cast("string").alias("magnitude_rank"), (F.min("qty") / 100).alias("specificity_rank"))
    return rd.from_rank_aggregate_results(raw, groupby="nation").interactions.select("source", "target", "ligand", "receptor", "prob", "pvalue", "pathway")


@query("a10_bridge_interactions", base_sql() + """SELECT source, target, regexp_replace(ligand || '_' || receptor || '_' || pathway, '[^a-zA-Z0-9_]', '_', 'g') AS interaction_name, interaction_name_2, pathway AS pathway_name, round(prob, 6) AS prob, CAST(0 AS DOUBLE) AS pval FROM inter""")
def _(spark, sf):
    rows = result(spark, sf).interactions
    lr = wr.bridge_lr_table(rows, r.lr_table(spark, sf))
    return wr.bridge_interactions(rows, lr).select("source", "target", "interaction_name", "interaction_name_2", "pathway_name", "prob", "pval")


@query("b1_b2_normalize_lr", r.with_sql(SUP) + """, f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lig, rec ORDER BY cat, refs) AS p FROM sup)
SELECT lig AS ligand, rec AS receptor, cat AS annotation, refs AS evidence, 'unknown' AS pathway FROM f WHERE p = 1""")
def _(spark, sf):
    raw = supplies(spark, sf).select("source_genesymbol", "target_genesymbol", F.col("category_intercell_source").alias("category"), F.col("references"))
    return lt.normalize_lr_table(raw, check=False).select("ligand", "receptor", "annotation", "evidence", "pathway")


@query("b3_filter_lr", r.with_sql(SUP) + "SELECT lig AS ligand, rec AS receptor, COUNT(*) AS n FROM sup WHERE cat = 'size 7' AND (region = 'ASIA' OR split_part(sources, '|', 2) = 'flag R') GROUP BY 1, 2")
def _(spark, sf):
    raw = supplies(spark, sf).select(F.trim("source_genesymbol").alias("ligand"), F.col("p_type").alias("receptor"), F.col("category_intercell_source").alias("annotation"), F.regexp_replace("sources", "[|]", " ; ").alias("sources"))
    out = lt.filter_lr_table(raw, annotation="size 7", resources=["ASIA", "flag R"], check=False)
    return out.groupBy("ligand", "receptor").agg(F.count(F.lit(1)).alias("n"))


PARTS = "t AS (SELECT p_type AS name, MIN(p_brand) || '_' || MAX(p_brand) AS parts FROM part WHERE p_type <> 'PROMO' GROUP BY 1)"


def _complex_table(spark, sf):
    return r.read(spark, sf, "part").where("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("name")).agg(F.min("p_brand").alias("s1"), F.max("p_brand").alias("s2"), F.lit(None).cast("string").alias("s3"))


@query("b4_expand_complex", r.with_sql(PARTS) + "SELECT p_partkey, COALESCE(parts, p_type) AS p_type FROM part LEFT JOIN t ON p_type = name")
def _(spark, sf):
    return lt.expand_complex(r.read(spark, sf, "part").select("p_partkey", "p_type"), "p_type", _complex_table(spark, sf))


@query("b5_expand_cofactor", r.with_sql(PARTS) + "SELECT p_partkey, COALESCE(parts, '') AS p_type FROM part LEFT JOIN t ON p_type = name")
def _(spark, sf):
    return lt.expand_cofactor(r.read(spark, sf, "part").select("p_partkey", "p_type"), "p_type", _complex_table(spark, sf))


@query("b6_complex_genes", r.with_sql(r.LR) + """SELECT complex, CAST(COUNT(*) AS BIGINT) AS n_subunits, string_agg(g, ',' ORDER BY g) AS genes FROM
 (SELECT DISTINCT complex, unnest(string_split(complex, '_')) AS g FROM (SELECT ligand AS complex FROM lr UNION SELECT receptor FROM lr)) GROUP BY 1""")
def _(spark, sf):
    lr = r.lr_table(spark, sf)
    names = lr.select(F.col("ligand").alias("complex")).union(lr.select("receptor")).distinct()
    return names.select("complex", F.size(tx.complex_genes("complex")).alias("n_subunits"), F.array_join(F.array_sort(tx.complex_genes("complex")), ",").alias("genes"))


SOME = "known AS (SELECT p_brand AS gene FROM part WHERE p_size > 25 GROUP BY 1 HAVING COUNT(*) > (SELECT COUNT(*) / 50.0 FROM part))"


def _some_genes(spark, sf):
    p = r.read(spark, sf, "part")
    counts = p.where("p_size > 25").groupBy(F.col("p_brand").alias("gene")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > p.agg(F.count(F.lit(1)) / 50.0).scalar()).select(F.lower("gene").alias("gene"))


@query("b7_filter_lr_to_genes", r.with_sql(r.LR, SOME) + """SELECT ligand, receptor FROM lr WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(string_split(ligand || '_' || receptor, '_')) AS g) WHERE g NOT IN (SELECT gene FROM known))""")
def _(spark, sf):
    return lt.filter_lr_to_genes(r.lr_table(spark, sf), _some_genes(spark, sf)).select("ligand", "receptor")


@query("b8_lr_genes", r.with_sql(r.LR) + """SELECT DISTINCT upper(unnest(string_split(x, '_'))) AS gene_key FROM (SELECT ligand AS x FROM lr UNION ALL SELECT receptor FROM lr UNION ALL SELECT agonist_genes FROM lr WHERE agonist_genes <> ''
 UNION ALL SELECT antagonist_genes FROM lr WHERE antagonist_genes <> '' UNION ALL SELECT co_A_receptor_genes FROM lr WHERE co_A_receptor_genes <> '' UNION ALL SELECT co_I_receptor_genes FROM lr WHERE co_I_receptor_genes <> '')""")
def _(spark, sf):
    return lt.lr_expression_genes(r.lr_table(spark, sf), include_cofactors=True)


@query("b9_gene_lookup", "SELECT upper(p_name) AS gene_key, arg_max(p_name, p_partkey) AS gene FROM part GROUP BY 1")
def _(spark, sf):
    return lt.gene_lookup(r.read(spark, sf, "part").select(F.col("p_name").alias("gene"), F.col("p_partkey").alias("ord")), order="ord")


@query("b11_interaction_label", r.with_sql(r.LR) + "SELECT ligand, receptor, CASE WHEN trim(interaction_name_2) <> '' THEN trim(interaction_name_2) ELSE ligand || ' - ' || receptor END AS label FROM lr")
def _(spark, sf):
    lr = r.lr_table(spark, sf)
    return lr.select("ligand", "receptor", tx.interaction_label(lr.columns).alias("label"))


@query("b12_append_warning", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'low;late' WHEN 'O' THEN 'late;low' ELSE 'late' END || CASE WHEN o_orderstatus = 'P' THEN ';low' ELSE '' END || ';new' AS warning FROM orders""")
def _(spark, sf):
    base = F.when(F.col("o_orderstatus") == "F", "low;late").when(F.col("o_orderstatus") == "O", "late;;low").otherwise("late")
    return r.read(spark, sf, "orders").select("o_orderkey", tx.append_warnings(base, ["low", "new", "low"]).alias("warning"))


# --- C -----------------------------------------------------------------------------------

SPEC = {"schema": "omnipath", "species": "sp", "taxon_id": "1", "clade": "c1", "license": "open"}


@query("c1_c2_normalize_resource", r.with_sql(SUP) + """SELECT lig AS ligand_gene, rec AS receptor_gene, cat AS pathway, cat AS annotation, sources AS resource, 'curated_direct' AS evidence_type, refs AS pmid, 'c1' AS clade, 'open' AS license, COUNT(*) AS n FROM sup GROUP BY ALL""")
def _(spark, sf):
    out = rs.normalize_training_resource(supplies(spark, sf), SPEC, check=False)
    return out.groupBy("ligand_gene", "receptor_gene", "pathway", "annotation", "resource", "evidence_type", "pmid", "clade", "license").agg(F.count(F.lit(1)).alias("n"))


#: Per layout: the column names its frame has for ligand, receptor, pathway, annotation (None: that of the pathway) and evidence.
FRAMES = {
    "generic": ("ligand_symbol", "receptor_symbol", "pathway_name", "category", "references"),
    "cellchat": ("ligand", "receptor", "pathway_name", "annotation", "evidence"),
    "omnipath": ("source_genesymbol", "target_genesymbol", "category_intercell_source", None, "references"),
    "cellphonedb": ("gene_a", "gene_b", "classification", None, "references"),
    "flyphonedb2": ("source_gene", "target_gene", "family", "interaction_type", "pmid"),
    "plantphonedb": ("Ligand", "Receptor", "Pathway", "Annotation", "Reference"),
    "plantcellchat": ("Ligand", "Receptor", "Signal", "Interaction_type", "Evidence"),
}


@query("c1_all_layouts", r.with_sql(SUP, "layouts AS (SELECT unnest(" + str(list(FRAMES)) + ") AS layout)") + """SELECT layout AS curation_type, layout AS resource, lig AS ligand_gene, rec AS receptor_gene, region AS pathway,
 CASE WHEN layout IN ('omnipath', 'cellphonedb') THEN region ELSE cat END AS annotation, CASE layout WHEN 'generic' THEN 'user_supplied' ELSE 'curated_direct' END AS evidence_type, refs AS pmid, 'sp' AS species, COUNT(*) AS n FROM sup, layouts GROUP BY ALL""")
def _(spark, sf):
    s = supplies(spark, sf)
    fields = ("source_genesymbol", "target_genesymbol", "region", "category_intercell_source", "references")
    parts = []
    for layout, names in FRAMES.items():
        frame = s.select(*[F.col(c).alias(n) for c, n in zip(fields, names, strict=True) if n])
        out = rs.normalize_training_resource(frame, {"schema": layout, "species": "sp", "taxon_id": "1"}, check=False)
        parts.append(out.groupBy("curation_type", "resource", "ligand_gene", "receptor_gene", "pathway", "annotation", "evidence_type", "pmid", "species").agg(F.count(F.lit(1)).alias("n")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@query("c5_load_resources", r.with_sql(SUP) + """, both_ AS (SELECT lig, rec, cat AS pathway, cat AS note, 'omni' AS res, 'curated_direct' AS kind, refs, '' AS url FROM sup
 UNION ALL SELECT p_brand, p_type, 'size ' || CAST(p_size AS VARCHAR), p_name, 'fly', 'predicted', '', 'u' FROM part)
SELECT lig AS ligand_gene, rec AS receptor_gene, pathway, 'sp' AS species, '7' AS taxon_id, COUNT(*) AS support_count, string_agg(DISTINCT res, ';' ORDER BY res) AS support_resources, string_agg(DISTINCT note, ';' ORDER BY note) AS annotation,
 string_agg(DISTINCT kind, ';' ORDER BY kind) AS evidence_type, COALESCE(string_agg(DISTINCT refs, ';' ORDER BY refs) FILTER (WHERE refs <> ''), '') AS pmid, COALESCE(MAX(url), '') AS source_url FROM both_ GROUP BY ALL""")
def _(spark, sf):
    omni = supplies(spark, sf).select("source_genesymbol", "target_genesymbol", "category_intercell_source", "references")
    part = r.read(spark, sf, "part")
    fly = part.select(F.col("p_brand").alias("source_gene"), F.col("p_type").alias("target_gene"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("family"), F.col("p_name").alias("interaction_type"))
    shared = {"species": "sp", "taxon_id": "7"}
    specs = [
        {"frame": omni, "schema": "omnipath", "resource": "omni", **shared},
        {"frame": fly, "schema": "flyphonedb2", "resource": "fly", "evidence_type": "predicted", "source_url": "u", **shared},
    ]
    out = rs.load_training_lr_resources(spark, specs)
    return out.select("ligand_gene", "receptor_gene", "pathway", "species", "taxon_id", "support_count", "support_resources", "annotation", "evidence_type", "pmid", "source_url")


@query("c3_training_problems", r.with_sql(SUP) + """SELECT COUNT(*) FILTER (WHERE refs = '') AS empty_ligand_gene, 0 AS empty_receptor_gene, 0 AS empty_species, 0 AS empty_taxon_id, 0 AS empty_resource, COUNT(*) FILTER (WHERE refs = rec) AS self_pairs, COUNT(*) FILTER (WHERE status = 'F') AS undirected FROM sup""")
def _(spark, sf):
    s = supplies(spark, sf)
    return rs.training_problems(s.select(F.col("references").alias("ligand_gene"), F.col("p_type").alias("receptor_gene"), F.col("nation").alias("species"), F.lit("1").alias("taxon_id"), F.col("region").alias("resource"),
                                         F.when(F.col("status") == "F", " Undirected").otherwise("true").alias("directed")))


def _training(spark, sf):
    s = supplies(spark, sf)
    base = rs.normalize_training_resource(s, SPEC, check=False)
    # species, clade and evidence come from the row here, not from the spec
    keep = s.select(
        F.col("nation").alias("species"), F.lit("9").alias("taxon_id"), F.trim("source_genesymbol").alias("ligand_gene"), F.col("p_type").alias("receptor_gene"),
        F.col("status").alias("pathway"), F.col("sources").alias("resource"), F.when(F.col("references") == "", "user_supplied").otherwise("curated_direct").alias("evidence_type"),
        F.col("category_intercell_source").alias("annotation"), F.col("references").alias("pmid"), F.col("region").alias("clade"),
    )
    return keep.withColumns({c: F.lit("") for c in base.columns if c not in keep.columns and not c.startswith("support_")})


def training(spark, sf):
    return r.once(spark, sf, "training", lambda: rs.deduplicate_training_lr(_training(spark, sf)))


TRAIN = """tr AS (SELECT nation AS species, lig AS ligand_gene, rec AS receptor_gene, status AS pathway, MIN(region) AS clade, COUNT(*) AS support_count, list_distinct(flatten(list(string_split(sources, '|')))) AS toks,
  list_distinct(list(CASE WHEN refs = '' THEN 'user_supplied' ELSE 'curated_direct' END)) AS ev, list_distinct(list(refs)) AS pm, list_distinct(list(cat)) AS an FROM sup GROUP BY 1, 2, 3, 4),
train AS (SELECT species, ligand_gene, receptor_gene, pathway, clade, support_count, array_to_string(list_sort(toks), ';') AS resource, array_to_string(list_sort(ev), ';') AS evidence_type,
  array_to_string(list_sort(list_filter(pm, lambda x: x <> '')), ';') AS pmid, array_to_string(list_sort(an), ';') AS annotation FROM tr)"""


@query("c4_deduplicate_training", r.with_sql(SUP, TRAIN) + "SELECT * FROM train")
def _(spark, sf):
    return training(spark, sf).select("species", "ligand_gene", "receptor_gene", "pathway", "clade", "support_count", "resource", "evidence_type", "pmid", "annotation")


@query("c6_training_to_lr", r.with_sql(SUP, TRAIN) + "SELECT ligand_gene AS ligand, receptor_gene AS receptor, pathway, COUNT(*) AS n FROM (SELECT DISTINCT ligand_gene, receptor_gene, pathway FROM train) GROUP BY ALL")
def _(spark, sf):
    lr = rs.training_lr_to_lr_table(training(spark, sf)).interactions
    return lr.groupBy("ligand", "receptor", "pathway").agg(F.count(F.lit(1)).alias("n"))


@query("c7_label_positives", r.with_sql(SUP, TRAIN) + "SELECT species, ligand_gene, receptor_gene, pathway, position('curated_direct' IN evidence_type) > 0 AS is_positive_label FROM train")
def _(spark, sf):
    out = rs.label_positives(training(spark, sf), ["curated_direct"])
    return out.select("species", "ligand_gene", "receptor_gene", "pathway", "is_positive_label")


def _proteins(spark, sf):
    """Sequences for brands and types, by nation of the suppliers that ship them."""
    s = supplies(spark, sf)
    pairs = s.select(F.col("nation").alias("species"), F.trim("source_genesymbol").alias("gene_id"), "p_type").distinct()  # one pass; names are made for what is left
    ends = pairs.select("species", "gene_id").union(pairs.select("species", "p_type")).distinct()
    return ends.select("species", "gene_id", F.concat_ws("-", "species", "gene_id").alias("protein_id"), F.upper("gene_id").alias("protein_sequence"))


PROT = "prot AS (SELECT DISTINCT nation AS species, g AS gene_id FROM (SELECT nation, lig AS g, qty FROM sup UNION ALL SELECT nation, rec, qty FROM sup))"


@query("c8_c9_c10_sequences", r.with_sql(SUP, TRAIN, PROT) + """SELECT t.species, t.ligand_gene, t.receptor_gene, t.pathway, t.species || '-' || t.ligand_gene AS ligand_protein_id, upper(t.receptor_gene) AS receptor_sequence FROM train t
 JOIN prot a ON a.species = t.species AND a.gene_id = t.ligand_gene JOIN prot b ON b.species = t.species AND b.gene_id = t.receptor_gene""")
def _(spark, sf):
    table = rs.build_lr_training_table(training(spark, sf), proteins=_proteins(spark, sf), require_sequence=True, check=False)
    return table.interactions.select("species", "ligand_gene", "receptor_gene", "pathway", "ligand_protein_id", "receptor_sequence")


@query("c9_drop_partial_complexes", r.with_sql(SUP) + """SELECT lig AS ligand_gene, rec AS receptor_gene, COUNT(*) AS n FROM sup WHERE
  NOT (((refs <> '' AND qty >= 1) OR CAST(substr(cat, 6) AS INTEGER) > 1) AND status = 'O') AND NOT (CAST(substr(cat, 6) AS INTEGER) > CASE WHEN refs = '' THEN 0 ELSE 2 END) GROUP BY 1, 2""")
def _(spark, sf):
    s = supplies(spark, sf)
    rows = s.select(
        F.trim("source_genesymbol").alias("ligand_gene"), F.col("p_type").alias("receptor_gene"), F.lit("AAA").alias("ligand_sequence"), F.when(F.col("status") == "O", "").otherwise("CCC").alias("receptor_sequence"),
        F.when(F.col("references") == "", "").otherwise(F.concat(F.lit("x, "), "references")).alias("complex_subunit_gene"), F.concat(F.lit("n/a;"), F.substring("category_intercell_source", 6, 9)).alias("complex_required_subunits"),
    )
    return rs.drop_partial_complexes(rows).groupBy("ligand_gene", "receptor_gene").agg(F.count(F.lit(1)).alias("n"))


@query("c11_stage_counts", r.with_sql(SUP, TRAIN, PROT) + """SELECT 'input' AS stage, COUNT(*) AS rows FROM train UNION ALL SELECT 'after_complex_filter', COUNT(*) FROM train UNION ALL
SELECT 'after_sequence_filter', COUNT(*) FROM train t JOIN prot a ON a.species = t.species AND a.gene_id = t.ligand_gene JOIN prot b ON b.species = t.species AND b.gene_id = t.receptor_gene""")
def _(spark, sf):
    return rs.build_lr_training_table(training(spark, sf), proteins=_proteins(spark, sf), require_sequence=True, check=False).stage_counts


@query("c12_evidence_type", r.with_sql(SUP) + "SELECT CASE WHEN refs LIKE 'PMID%' THEN 'curated_direct' ELSE 'curated_inferred' END AS evidence_type, COUNT(*) AS n FROM sup GROUP BY 1")
def _(spark, sf):
    return supplies(spark, sf).groupBy(rs.plant_evidence_type(F.lower("references")).alias("evidence_type")).agg(F.count(F.lit(1)).alias("n"))


@query("c13_resource_summary", r.with_sql(SUP, TRAIN) + "SELECT species, raw_rows, normalized_rows FROM (SELECT nation AS species, COUNT(*) AS raw_rows FROM sup GROUP BY 1) JOIN (SELECT species, COUNT(*) AS normalized_rows FROM train WHERE ligand_gene <> receptor_gene GROUP BY 1) USING (species)")
def _(spark, sf):
    return rs.resource_summary(_training(spark, sf), rs.drop_self_pairs(training(spark, sf)))


BG = f"""ends AS (SELECT DISTINCT species, ligand_gene AS g FROM train), pg AS (SELECT DISTINCT nation AS species, 'customer ' || CAST(c_custkey AS VARCHAR) AS gene_id FROM (SELECT n_name AS nation, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
  UNION SELECT species, g FROM ends),
rk AS (SELECT species, gene_id, ROW_NUMBER() OVER (PARTITION BY species ORDER BY {r.hash_long_sql("'5'", 'species', 'gene_id')}, gene_id) AS rn FROM pg WHERE (species, gene_id) NOT IN (SELECT (species, g) FROM ends))"""


@query("c14_subset_proteins", r.with_sql(SUP, TRAIN, BG) + "SELECT species, gene_id, 'background' AS training_role_source FROM rk WHERE rn <= 20 UNION ALL SELECT species, g, 'lr_endpoint' FROM ends")
def _(spark, sf):
    t = training(spark, sf).select("species", "ligand_gene", F.col("ligand_gene").alias("receptor_gene"))
    c = r.read(spark, sf, "customer").join(r.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    proteins = c.select(F.col("n_name").alias("species"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("gene_id")).union(t.select("species", "ligand_gene").distinct())
    return rs.subset_training_proteins(t, proteins, background_per_species=20, seed=5)


@query("c15_proteome_match", r.with_sql(SUP, TRAIN, PROT) + """, e AS (SELECT species, ligand_gene AS g FROM train UNION SELECT species, receptor_gene FROM train)
SELECT COALESCE(p.species, e.species) AS species, COUNT(p.gene_id) AS n_protein_genes, COUNT(e.g) AS n_lr_genes, COUNT(CASE WHEN p.gene_id IS NOT NULL AND e.g IS NOT NULL THEN 1 END) AS n_matched_lr_genes,
  round(COUNT(CASE WHEN p.gene_id IS NOT NULL AND e.g IS NOT NULL THEN 1 END) / NULLIF(COUNT(e.g), 0), 6) AS matched_lr_gene_fraction FROM prot p FULL JOIN e ON p.species = e.species AND p.gene_id = e.g GROUP BY 1""")
def _(spark, sf):
    return rs.proteome_match_summary(training(spark, sf), _proteins(spark, sf))


# --- L: texts as sequences ----------------------------------------------------------------

CDS = "cds AS (SELECT doc_id, lang, source, regexp_replace(replace(upper(text), 'U', 'T'), '[^ACGTN]', '', 'g') AS cds FROM documents)"
AA = """aa AS (SELECT *, array_to_string(list_transform(regexp_extract_all(cds, '.{3}'), lambda c: CASE WHEN contains(c, 'N') THEN 'X' ELSE
  substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST((instr('TCAG', substr(c, 1, 1)) - 1) * 16 + (instr('TCAG', substr(c, 2, 1)) - 1) * 4 + instr('TCAG', substr(c, 3, 1)) AS BIGINT), 1) END), '') AS aa FROM cds)"""


@query("l1_translate_cds", r.with_sql(CDS, AA) + """SELECT doc_id, md5(cds) AS cds_md5, md5(rtrim(aa, '*')) AS protein_md5, length(cds) AS cds_length, length(rtrim(aa, '*')) AS protein_length, length(aa) - length(replace(aa, '*', '')) AS stop_codon_count,
  (length(cds) > 0 AND length(cds) % 3 = 0 AND NOT contains(cds, 'N') AND length(aa) - length(replace(aa, '*', '')) <= 1 AND (length(aa) = length(replace(aa, '*', '')) OR aa LIKE '%*')) AS valid_translation FROM aa""")
def _(spark, sf):
    out = pr.with_translation(r.read(spark, sf, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.md5(F.col("cds_sequence").cast("binary")).alias("cds_md5"), F.md5(F.col("protein_sequence").cast("binary")).alias("protein_md5"), "cds_length", "protein_length", "stop_codon_count", "valid_translation")


@query("l3_l4_longest_isoform", r.with_sql("p AS (SELECT doc_id, source, lang, regexp_replace(upper(text), '[^A-Z]', '', 'g') AS s FROM (SELECT doc_id, source, lang, replace(text, 'ß', 'ss') AS text FROM documents))") + """SELECT source || '/' || lang AS gene_id, MAX(length(s)) AS protein_length, 0 AS cds_length, TRUE AS selected_isoform FROM p WHERE length(s) > 0 GROUP BY 1""")
def _(spark, sf):
    docs = r.read(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("gene"), F.col("doc_id").cast("string").alias("pid"), F.regexp_replace("text", "[*]", "").alias("seq"))
    out = pr.protein_table_from_genes(docs, protein_sequence_key="seq", protein_id_key="pid")
    return out.select("gene_id", "protein_length", "cds_length", "selected_isoform")


@query("l5_gene_match", "SELECT COUNT(*) FILTER (WHERE e) AS n_expression_genes, COUNT(*) FILTER (WHERE p) AS n_protein_genes, COUNT(*) FILTER (WHERE e AND p) AS n_matched_genes, COUNT(*) FILTER (WHERE e AND NOT p) AS n_expression_only_genes, COUNT(*) FILTER (WHERE NOT e AND p) AS n_protein_only_genes "
       "FROM (SELECT g, bool_or(s = 'e') AS e, bool_or(s = 'p') AS p FROM (SELECT c_custkey AS g, 'e' AS s FROM customer UNION ALL SELECT o_orderkey, 'p' FROM orders WHERE o_orderstatus = 'F') GROUP BY 1)")
def _(spark, sf):
    e = r.read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("gene"))
    p = r.read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("gene_id"))
    return pr.gene_match_summary(pr.match_expression_genes(e, p))


@query("l6_prediction_proteins", "SELECT o_orderkey AS gene_id FROM orders WHERE o_orderkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(spark, sf):
    e = r.read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("gene"))
    return pr.prediction_proteins(r.read(spark, sf, "orders").select(F.col("o_orderkey").alias("gene_id")), e, restrict_to_expression=True)


@query("l7_heuristic_roles", """WITH s AS (SELECT doc_id, upper(text) AS t FROM documents), f AS (SELECT doc_id, length(t) AS n, (length(t) - length(replace(t, 'C', ''))) / GREATEST(length(t), 1) AS c,
  (length(t) - length(regexp_replace(t, '[AILMFWYV]', '', 'g'))) / GREATEST(length(t), 1) AS h FROM s),
g AS (SELECT *, LEAST(GREATEST(0.75 - n / 1600.0 + c * 2, 0.05), 0.95) AS l, LEAST(GREATEST(n / 1200.0 + h * 0.8, 0.05), 0.95) AS rr FROM f)
SELECT CAST(doc_id AS VARCHAR) AS gene_id, round(l, 6) AS ligand_like_score, round(rr, 6) AS receptor_like_score, round(LEAST(GREATEST(l + c, 0.05), 0.95), 6) AS secreted_like_score,
  round(LEAST(GREATEST(rr + h * 0.4, 0.05), 0.95), 6) AS membrane_like_score, round(LEAST(0.95, c * 3), 6) AS ecm_like_score FROM g""")
def _(spark, sf):
    docs = r.read(spark, sf, "documents").select(F.col("doc_id").alias("gene_id"), F.col("doc_id").alias("protein_id"), F.replace(F.col("text"), F.lit("ß"), F.lit("ẞ")).alias("protein_sequence"))
    return pr.heuristic_roles(docs).drop("protein_id", "out_of_domain_score")


@query("l8_hash_embedding", f"""WITH d AS (SELECT doc_id, md5(text) AS h FROM documents), v AS (SELECT doc_id, i, sqrt(-2 * ln(1 - {r.hash_unit_sql('h', "'r'", 'CAST(i AS VARCHAR)')})) * cos(6.283185307179586 * {r.hash_unit_sql('h', "'a'", 'CAST(i AS VARCHAR)')}) AS x
  FROM d, (SELECT unnest(generate_series(1, 4)) AS i))
SELECT doc_id, i AS pos, round(x / sqrt(SUM(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM v""")
def _(spark, sf):
    docs = r.read(spark, sf, "documents").select("doc_id", F.posexplode(pr.hash_embedding(F.col("text"), 4)).alias("pos", "x"))
    return docs.withColumn("pos", F.col("pos") + 1)
