"""Registered queries: names, and a spread of them against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "d8_tri_mean_sparse", "e2_rank_sums", "f5_f6_hill_cofactors", "f14_f15_sketches", "f16_permutation_pvalues", "g10_lr_contribution", "h4_betweenness",
    "i1_compare_communication", "j6_pathway_similarity", "c4_deduplicate_training", "l1_translate_cds", "n2_degree_matched_negatives", "n12_curve_metrics",
    "o4_o5_kernel_weights", "o16_top_k_enrichment", "o21_section_reproducibility", "p12_delta_summary",
]


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 190


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    assert compare(spark, duck(SF), SF, entry.queries()[name], entry.oracle_sql()[name]).startswith("ok")
