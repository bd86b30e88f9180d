from pyspark.sql import functions as F

from sparkcomm.operators import resources as rs


def test_equal_rows_are_counted_before_they_are_merged(spark, monkeypatch):
    rows = spark.range(3000).select(
        F.lit("sp").alias("species"), F.lit("9").alias("taxon_id"), F.concat(F.lit("L"), F.col("id") % 3).alias("ligand_gene"), F.lit("R").alias("receptor_gene"), F.lit("p").alias("pathway"),
        F.when(F.col("id") % 2 == 0, "b; a|").otherwise("a").alias("resource"), F.lit("").alias("evidence_type"), F.when(F.col("id") % 2 == 0, "note").alias("annotation"),
        F.when(F.col("id") % 2 == 0, " ").otherwise("SEQ").alias("ligand_sequence"),
    )
    written, write = [], rs.materialize
    monkeypatch.setattr(rs, "materialize", lambda df: written.append(write(df)) or written[-1])
    out = rs.deduplicate_training_lr(rows).orderBy("ligand_gene").collect()
    assert [(r["ligand_gene"], r["support_count"], r["resource"], r["support_resources"], r["evidence_type"], r["annotation"], r["ligand_sequence"], r["pmid"]) for r in out] == [
        (f"L{i}", 1000, "a;b", "a;b", "", "note", "SEQ", "") for i in range(3)]
    # the minimum and the tokens are told from 6 rows, not 3,000
    assert written[0].count() == 6 and written[0].agg(F.sum("_n")).first()[0] == 3000


def test_protein_names_are_made_for_distinct_genes(spark):
    from catalog import resource_queries

    table = resource_queries._proteins(spark, "/root/testdata/sf0.001")
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    grouped = [x.split("Aggregate [")[1].split("], [")[0] for x in plan.split("\n") if "Aggregate [" in x]
    assert grouped and not [x for x in grouped if "protein" in x or "concat_ws" in x]
    rows = table.collect()
    assert len(rows) == len({(r["species"], r["gene_id"]) for r in rows}) and all(r["protein_id"] == f"{r['species']}-{r['gene_id']}" for r in rows)
