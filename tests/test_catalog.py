"""Every query with SQL agrees with DuckDB on the smallest tables, where those are."""

import math
import os

import pytest

from cytoloom import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows, names):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ""
        return f"{x + 0.0:.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(value(r[n]) for n in names) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", ["corr_knn", "score_rescale", "anchor_weights", "masked_labels", "quantile_gate", "marker_gate", "ref_normalize", "nb_cdf_fixed_params", "tpr_tnr", "cluster_purity", "knn_edges", "silhouette_corr", "consensus_distance", "corr_knn_in_blocks", "four_way_query_first", "distance_matrix", "discard_everywhere", "cca_orthonormal", "cca_singular_values", "pca_total_variance", "default_gene_means", "reference_files", "query_files", "wide_cells", "label_file", "cluster_name_file", "without_noise", "normal_cdf_fixed_params", "corrected_matrix", "label_modularity", "core_distances", "reach_tree_weight", "consensus_classes", "consensus_class_distance", "near_masked_labels", "corr_knn_by_cells", "euclid_knn_by_cells", "eps_knn_bound", "lanczos_largest_value", "streamed_labels", "drop_nan_rows"])
def test_against_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    table = duck.execute(catalog.ORACLES[name]).to_arrow_table()
    assert sorted(table.column_names) == names
    assert plain([r.asDict() for r in got.collect()], names) == plain(table.to_pylist(), names)


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())
