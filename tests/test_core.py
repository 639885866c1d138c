import duckdb
import numpy as np
import pytest

from dayline.functions import dense
from dayline.functions.curves import quadrature_weights
from dayline.plans import containers, fixed_basis, queries

SF = "/root/testdata/sf0.001"
#: Queries of which SQL is the only check.
NEW = [*containers.REGISTERED, *fixed_basis.REGISTERED]


@pytest.mark.parametrize("name", ["mean_curve", "observed_pairs_lag6", "lagcov_two_level", "cross_spectra", "cosinor_24h", "morph_bundle", "visit_means", "shape_total_variance", "two_level_within_variance", "adjusted_rand", "regression_metrics", "silhouette", "target_match", *NEW])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings", "customer", "lineitem", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    keys = list(want.columns)
    want, got = (x.sort_values(keys).reset_index(drop=True) for x in (want, got))
    assert len(got) == len(want)
    for c in keys:
        if want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].astype(float), want[c], atol=3e-6)
        else:
            assert got[c].tolist() == want[c].tolist()


#: Long fits that have tests of their own.
LONG_FITS = ("autoencoder_", "conv_", "panel_importance", "benchmark_summary")


@pytest.mark.parametrize("name", [n for n in queries.UNSTATED if not n.startswith(LONG_FITS)])
def test_query_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_quadrature_weights():
    assert quadrature_weights([0, 1, 3, 7, 15]) == [0.5, 1.5, 3, 6, 4]


def test_prior_orders_agree_for_one_mode():
    assert dense.aligned_order(2, 1).tolist() == [0, 1, 2, 3]
    assert dense.aligned_order(2, 3).tolist() != list(range(12))


def test_quasi_newton_finds_a_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    w, path = dense.minimised(lambda x: (0.5 * x @ a @ x - x.sum(), a @ x - 1), np.zeros(3))
    np.testing.assert_allclose(w, 1 / np.diag(a), atol=1e-4)
    assert path[-1] < path[0]
