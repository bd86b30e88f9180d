"""Filters that no gene passes leave tables without rows where the caller, as the SQL does, takes that for an answer."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare, duck
from sparkcomm.operators import candidates as ca

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def many_orders(tmp_path_factory):
    """Tables in which every part is in less than 0.00001 of the orders, as in large ones."""
    folder = tmp_path_factory.mktemp("orders")
    for name in TABLES:
        if name != "orders":
            (folder / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    duckdb.sql(f"COPY (SELECT range AS o_orderkey FROM range(6000000)) TO '{folder}/orders.parquet' (FORMAT parquet)")
    return str(folder)


def test_candidates(spark):
    rows = [("a", "p", 0.9, 0.9)]
    proteins = spark.createDataFrame(rows, "gene_id string, protein_id string, ligand_like_score double, receptor_like_score double")
    expression = spark.createDataFrame([("c1", "a", 1.0)], "cell_id string, gene string, value double")
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell_id string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0])], "gene_id string, embedding array<double>")
    options = {"embeddings": vectors, "expression_min_fraction": 0.9, "nearest_neighbor_pairs": None}
    with pytest.raises(ValueError, match="empty"):
        ca.generate_lr_candidates(expression, cells, proteins, proteins, **options)
    none = ca.generate_lr_candidates(expression, cells, proteins, proteins, allow_empty=True, **options)
    assert none.count() == 0 and {"candidate_strategy", "embedding_cosine"} <= set(none.columns)


@pytest.mark.parametrize("name", ["m6_candidates", "m7_pair_features", "m8_heuristic_scores"])
def test_query_without_candidates(spark, many_orders, name):
    assert compare(spark, duck(many_orders), many_orders, entry.queries()[name], entry.oracle_sql()[name]).startswith("ok 0 rows")


def test_model_scores_without_candidates(spark, many_orders):
    assert entry.queries()["m9_model_scores"](spark, many_orders).count() == 0


def test_selection_without_pairs(spark):
    none = spark.createDataFrame([], "ligand_gene string, receptor_gene string, model_score double")
    for caps in ({}, {"max_pairs_per_ligand": 3, "max_pairs_per_receptor": 4}):
        with pytest.raises(ValueError, match="no pair"):
            ca.build_predicted_lr_table(none, density_prior=0.05, **caps)
        table = ca.build_predicted_lr_table(none, density_prior=0.05, allow_empty=True, **caps)
        assert table.interactions.count() == 0 and table.metadata["prediction_summary"].first()["selected_pair_count"] == 0


def test_predicted_lr_without_candidates(spark, many_orders):
    assert entry.queries()["m13_predicted_lr"](spark, many_orders).count() == 0


def test_predict_and_select_without_candidates(spark, many_orders):
    assert entry.queries()["m15_predict_and_select"](spark, many_orders).count() == 0
