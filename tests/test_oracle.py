"""Every query with a SQL twin against DuckDB on the smallest tables; the grid queries are covered in test_grid."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
# one query per family runs by default; `python tests/oracle.py 0.01` runs all of them
SAMPLE = ["a1_pseudobulk", "a14_program_scores", "a15_control_genes", "a18_shift_share", "a33_cells_per_unit", "t1_spearman_trend",
          "t2_partial_spearman", "t9_difference_in_differences", "t10_mann_whitney", "t16_bootstrap_spearman", "t21_permutation_within_run",
          "w2_benjamini_hochberg", "w4_last_peak", "w5_relapse_count", "w6_relapse_count_held", "j5_identical_curves", "j8_knn",
          "g3_graph_lesions", "g4_density_clusters", "g7_signed_distance", "g12_segment_lesions", "g17_neighbourhood_enrichment",
          "g18_ligand_receptor", "m6_score_frozen_model", "m7_binomial_halves", "u5_exclusive_intersections"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    msg = compare(entry.queries()[name](spark, SF), con, SQL[name])
    assert msg in (None, "both empty"), msg


def test_every_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())
    assert len(SQL) > 150


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["gene_id", "n", "rho", "p", "q"] or set(df.columns) == {"gene_id", "n", "rho", "p", "q"}
    assert df.limit(1).count() == 1
