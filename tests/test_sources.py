"""Files in and out, LR tables, resources, proteins."""

import gzip

import pytest
from pyspark.sql import functions as F

from sparkcomm.model import CommResult, SpatialReport
from sparkcomm.operators import lr_table as lt
from sparkcomm.operators.diff import compare_communication
from sparkcomm.operators import proteins as pr
from sparkcomm.operators import resources as rs
from sparkcomm.sources import readers as rd
from sparkcomm.sources import writers as wr


def test_lr_file_aliases(spark, tmp_path):
    path = tmp_path / "lr.tsv"
    path.write_text("source_genesymbol\ttarget_genesymbol\tsources\treferences\nA \tB\tDB1;DB2\tPMID:1\n\tC\tDB\t\n")
    table = rd.load_lr_table(spark, str(path))
    row = table.interactions.collect()
    assert table.name == "lr" and len(row) == 1
    assert (row[0]["ligand"], row[0]["receptor"], row[0]["pathway"], row[0]["annotation"], row[0]["evidence"]) == ("A", "B", "unknown", "DB1;DB2", "PMID:1")
    assert lt.filter_lr_table(table.interactions, resources="DB2").count() == 1
    with pytest.raises(ValueError):
        lt.filter_lr_table(table.interactions, resources="other")
    csv = tmp_path / "lr.csv"
    csv.write_text("a,b\nL,R\n")
    assert rd.load_lr_table(spark, str(csv), ligand_col="a", receptor_col="b").interactions.first()["ligand"] == "L"


def test_keep_first_duplicate_by_order(spark):
    df = spark.createDataFrame([("L", "R", "P", "late", 2), ("L", "R", "P", "early", 1)], "ligand string, receptor string, pathway string, annotation string, ord int")
    assert lt.normalize_lr_table(df, order="ord").first()["annotation"] == "early"


def test_database_tables(spark):
    inter = spark.createDataFrame([("X", "CPLX", "PW", "AG")], "ligand string, receptor string, pathway_name string, agonist string")
    cx = spark.createDataFrame([("CPLX", "R1", "", "R2")], "name string, s1 string, s2 string, s3 string")
    co = spark.createDataFrame([("AG", "G1", "G2")], "name string, c1 string, c2 string")
    row = rd.lr_from_db_tables(inter, cx, co).interactions.first()
    assert (row["receptor"], row["agonist_genes"], row["raw_receptor"]) == ("R1_R2", "G1_G2", "CPLX")


def test_matrix_market_folder(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate real general\n%\n2 3 3\n1 1 5\n2 3 1.5\n1 2 2\n")
    (tmp_path / "genes.tsv").write_text("g1\ng2\n")
    (tmp_path / "cells.tsv").write_text("a\nb\nc\n")
    (tmp_path / "meta.tsv").write_text("cell_id\tcell_type\na\tA\nb\tA\nc\tB\n")
    expression, cells = rd.read_expression_mtx(spark, str(tmp_path))
    assert sorted(map(tuple, expression.collect())) == [("a", "g1", 5.0), ("b", "g1", 2.0), ("c", "g2", 1.5)]
    assert cells.count() == 3


def test_fasta_plain_gz_and_crlf(spark, tmp_path):
    text = ">tx1 gene=G1 transcript=T1 a>b\r\nATGAAA\r\nTAA\r\n>tx2 gene=G1 transcript=T2\r\nATGAAAAAATAA\r\n\r\n>tx3 gene=G2 transcript=T3\r\nATGAA\r\n"
    plain, zipped = tmp_path / "cds.fa", tmp_path / "cds.fa.gz"
    plain.write_bytes(text.encode())
    with gzip.open(zipped, "wb") as f:
        f.write(text.encode())
    for path in (plain, zipped):
        rows = {r["header"]: r["sequence"] for r in rd.read_fasta(spark, str(path)).collect()}
        assert rows["tx1 gene=G1 transcript=T1 a>b"] == "ATGAAATAA" and len(rows) == 3
        best = {r["gene_id"]: r for r in pr.load_cds_translations(spark, str(path)).collect()}
        assert best["G1"]["transcript_id"] == "T2" and best["G1"]["protein_sequence"] == "MKK" and best["G1"]["valid_translation"]
        assert not best["G2"]["valid_translation"]


def test_protein_fasta_ids(spark, tmp_path):
    path = tmp_path / "p.fa"
    path.write_text(">p1 Ori=S_01\nMPEPTIDE\n>p2 Ori=S_01\nMPEPTIDEVV*\n>p3 Ori=S_02\nMCCCC\n")
    rows = {r["gene_id"]: r for r in pr.load_protein_fasta(spark, str(path), gene_id_regex=r"Ori=(S_\d+)", gene_id_replacements=[("^S_", "S-")]).collect()}
    assert set(rows) == {"S-01", "S-02"}
    assert rows["S-01"]["protein_id"] == "p2" and rows["S-01"]["protein_length"] == 10 and rows["S-01"]["stop_codon_count"] == 1


def test_protein_table_needs_one_sequence_source(spark):
    genes = spark.createDataFrame([("g", "MK")], "gene string, seq string")
    with pytest.raises(ValueError):
        pr.protein_table_from_genes(genes)
    assert pr.protein_table_from_genes(genes, protein_sequence_key="seq").first()["valid_translation"]


def test_training_schemas_and_merge(spark):
    frames = {
        "cellchat": {"ligand": "TGFB1", "receptor": "TGFBR1", "pathway_name": "TGFb"},
        "omnipath": {"source_genesymbol": "CXCL12", "target_genesymbol": "CXCR4", "sources": "DB", "references": "PMID:1"},
        "cellphonedb": {"gene_a": "MIF", "gene_b": "CD74", "classification": "cytokine"},
        "flyphonedb2": {"ligand": "spz", "receptor": "Tl", "family": "Toll"},
        "plantphonedb": {"Ligand": "RALF1", "Receptor": "FER", "Pathway": "RALF"},
        "plantcellchat": {"Ligand": "PSK1", "Receptor": "PSKR1", "Signal": "PSK"},
        "generic": {"ligand_gene": "VEGFA", "receptor_gene": "KDR", "pathway": "VEGF"},
    }
    specs = [{"frame": spark.createDataFrame([row]), "schema": s, "species": f"sp_{s}", "taxon_id": 1} for s, row in frames.items()]
    rows = {r["ligand_gene"]: r for r in rs.load_training_lr_resources(spark, specs).collect()}
    assert len(rows) == 7 and rows["RALF1"]["pathway"] == "RALF" and rows["CXCL12"]["pmid"] == "PMID:1"
    assert {r["evidence_type"] for r in rows.values()} == {"curated_direct", "user_supplied"}
    one = spark.createDataFrame([("L1", "R1", "P")], "ligand_gene string, receptor_gene string, pathway string")
    both = rs.load_training_lr_resources(spark, [{"frame": one, "schema": "generic", "species": "h", "taxon_id": 9, "resource": n} for n in "BA"]).first()
    assert both["support_count"] == 2 and both["support_resources"] == "A;B"
    bad = spark.createDataFrame([("L1", "L1", "P", "true")], "ligand_gene string, receptor_gene string, pathway string, directed string")
    with pytest.raises(ValueError, match="self"):
        rs.load_training_lr_resources(spark, [{"frame": bad, "schema": "generic", "species": "h", "taxon_id": 9}])
    with pytest.raises(ValueError, match="undirected"):
        rs.load_training_lr_resources(spark, [{"frame": bad.withColumns({"receptor_gene": F.lit("R"), "directed": F.lit("No")}), "schema": "generic", "species": "h", "taxon_id": 9}])


def test_bridge_export_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("A", "B", "L:1", "R", "P", 0.5, None)], "source string, target string, ligand string, receptor string, pathway string, prob double, pvalue double")
    groups = spark.createDataFrame([("A",), ("B",)], "group string")
    wr.export_bridge_tables(CommResult(rows, groups), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out" / "interactions"), header=True, sep="\t").first()
    assert back["interaction_name"] == "L_1_R_P" and float(back["pval"]) == 0.0
    assert wr.sample_folders("a b", "a b") == ("a_b_a", "a_b_b")


def test_candidate_list(spark, tmp_path):
    path = tmp_path / "genes.txt"
    path.write_text("g1\n g2 \n\ng1\n")
    assert sorted(r[0] for r in rd.read_candidate_list(spark, str(path)).collect()) == ["g1", "g2"]


def test_density_prior_file_beside_a_model(spark, tmp_path):
    assert rd.resolve_density_input(spark, "auto", str(tmp_path)) == "auto"
    prior = spark.createDataFrame([("animal", 0.2)], "clade string, density_prior double")
    wr.write_tsv(prior, str(tmp_path / "density_prior"))
    assert rd.resolve_density_input(spark, "auto", str(tmp_path)).first()["density_prior"] == 0.2
    assert rd.resolve_density_input(spark, 0.3, str(tmp_path)) == 0.3


def test_merged_export_and_report_tables(spark, tmp_path):
    rows = spark.createDataFrame([("A", "B", "L", "R", "P", 0.5), ("B", "A", "L", "R", "Q", 0.25)], "source string, target string, ligand string, receptor string, pathway string, prob double")
    groups = spark.createDataFrame([("A",), ("B",)], "group string")
    a, b = CommResult(rows, groups), CommResult(rows.where("source = 'A'"), groups)
    wr.export_bridge_merged(compare_communication(a, b, label_a="new", label_b="old"), str(tmp_path / "m"))
    read = lambda name: spark.read.csv(str(tmp_path / "m" / name), header=True, sep="\t")
    assert read("new/interactions").count() == 2 and read("old/interactions").count() == 1
    assert sorted(r["directory"] for r in read("samples").collect()) == ["new", "old"]
    assert read("network_delta").count() == 4 and read("diff_pathways").count() == 2
    one = spark.createDataFrame([(1,)], "k int")
    report = SpatialReport(one, one, None, None, None, one, None, None)
    assert wr.write_report_tables(report, str(tmp_path / "r"), {"dataset": "d"}, null_distribution=False) == ["summary", "celltype_pair_summary", "top_k_enrichment"]
    assert spark.read.csv(str(tmp_path / "r" / "summary"), header=True, sep="\t").first()["dataset"] == "d"
