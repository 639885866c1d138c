import duckdb
import numpy as np
import pytest

from dayline.dataset import CurveSet
from dayline.functions import dense
from dayline.operators import diagnostics as D
from dayline.operators import estimators, spectral
from dayline.plans import diagnostics as queries

SF = "/root/testdata/sf0.001"
SCALES = [0.0, 1.0, 2.0, 4.0, 8.0]


@pytest.mark.parametrize("name", list(queries.REGISTERED))
def test_queries_equal_sql(spark, name):
    run, sql = queries.REGISTERED[name]
    con = duckdb.connect()
    for table in ("events", "customer", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(sql)
    got = run(spark, SF)
    assert got.columns == want.columns
    rows, others = sorted(map(tuple, got.collect())), sorted(want.fetchall())
    assert len(rows) == len(others)
    for a, b in zip(rows, others, strict=True):
        assert a == b or all(x == y or abs(x - y) < 2e-6 for x, y in zip(a, b, strict=True)), (a, b)


def stationary(seed=1, subjects=400, share=1.0):
    """Days of a three-mode process with two harmonics whose amplitudes are coupled; with share < 1 hours are missing."""
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(2, 3, 3)) + 1j * rng.normal(size=(2, 3, 3))
    h, rows = np.arange(24), []
    for s in range(subjects):
        x = rng.normal(scale=0.3, size=(24, 3))
        for r in (1, 2):
            z = mix[r - 1] @ (rng.normal(size=3) + 1j * rng.normal(size=3))
            x += (np.exp(2j * np.pi * r * h / 24)[:, None] * z).real
        rows += [(f"s{s}", int(k), int(m), float(x[k, m])) for k in h if rng.random() < share for m in range(3)]
    return rows


@pytest.fixture(scope="module")
def whole_days(spark):
    return spectral.centred(spark.createDataFrame(stationary(), "subject_id string, hour int, m int, xi double")).cache()


def test_eigenvalues_of_the_whole_are_the_union_over_harmonics(whole_days):
    a, b = D.eigenvalues_both_ways(spectral.lag_covariance(whole_days), 3)
    assert len(a) == len(b) == 72
    np.testing.assert_allclose(a, b, atol=1e-9)
    assert abs(a[0] - a[1]) < 1e-9 * a[0] and a[11] > a[12]  # pairs, of two harmonics and three modes


def test_surface_agrees_with_its_harmonics(spark, whole_days):
    spectra = spectral.collected_spectra(spectral.cross_spectra(spectral.lag_covariance(whole_days), 2), 2, 3)
    found = D.surface(whole_days)
    rows = D.agreement(found, spectra)
    x = whole_days.toPandas().pivot_table(index="subject_id", columns=["hour", "m"], values="centred").to_numpy()
    np.testing.assert_allclose([r[1] for r in rows], np.linalg.eigvalsh(x.T @ x / len(x))[::-1][:12], rtol=1e-9)
    assert max(abs(r[1] - r[2]) / rows[0][1] for r in rows) < 0.12
    assert np.median([r[3] for r in rows]) < 0.1 and rows[-1][3] < 0.6  # the weakest mode is hardly above the noise
    lost = spectral.centred(spark.createDataFrame(stationary(2, 300, 0.6), "subject_id string, hour int, m int, xi double"))
    table = lost.toPandas().pivot_table(index="subject_id", columns=["hour", "m"], values="centred")
    y, there = table.fillna(0).to_numpy(), table.notna().to_numpy().astype(float)
    want, k = y.T @ y / (there.T @ there), there.T @ there
    at = {(r.h, r.m, r.g, r.n): (r.cov, r.k) for r in D.surface(lost).collect()}
    for i, (h, m) in enumerate(table.columns):
        for j, (g, n) in enumerate(table.columns):
            np.testing.assert_allclose(at[h, m, g, n], (want[i, j], k[i, j]), atol=1e-9)


def test_bootstrap_equals_separate_fits(spark):
    rng = np.random.default_rng(0)
    days = {f"s{i}": rng.normal(size=(int(rng.integers(4, 24)), 5)) + rng.normal(size=5) for i in range(60)}
    data = CurveSet(spark.createDataFrame([(s, h, c.tolist()) for s, x in days.items() for h, c in enumerate(x)], "subject_id string, hour int, curve array<double>"), SCALES)
    basis = estimators.fit_basis(data, 2)
    drawn = D.bootstrap(data, basis, 8)
    keys = {r.subject_id: r.k for r in data.subject_ids().selectExpr("subject_id", "xxhash64(subject_id) AS k").collect()}
    times = D.poisson_weights(np.array([keys[s] for s in days]), 8)
    for b in (0, 3, 7):
        again = [(f"{s}-{c}", h, v.tolist()) for (s, x), n in zip(days.items(), times[:, b], strict=True) for c in range(int(n)) for h, v in enumerate(x)]
        fit = estimators.fit_basis(CurveSet(spark.createDataFrame(again, "subject_id string, hour int, curve array<double>"), SCALES), 2)
        own = drawn[drawn["replicate"] == b].sort_values("k")
        np.testing.assert_allclose(own["eigenvalue"], fit.variances, rtol=1e-9)
        angles = np.arccos(np.minimum(1, np.abs(((fit.modes * fit.weights) * basis.modes).sum(axis=1))))
        np.testing.assert_allclose(own["angle"], angles, atol=1e-7)
    many = D.poisson_weights(np.arange(100_000) * 7919, 2)
    np.testing.assert_allclose([many.mean(), many.var(), np.corrcoef(many.T)[0, 1]], [1, 1, 0], atol=0.02)
    assert [r[0] for r in D.intervals(basis, drawn)] == [0, 1] and all(r[2] <= r[3] for r in D.intervals(basis, drawn))


def test_dual_posterior_equals_the_primal():
    rng = np.random.default_rng(3)
    b = rng.normal(size=(12, 12))
    precision = np.linalg.inv(b @ b.T + np.eye(12))
    for hours in ([3], [1, 9], [0, 5, 11], [0, 1, 2, 3, 20]):
        x = dense.fourier(np.array(hours), 2)
        primal, cheaper = (dense.posterior_covariance(precision, x, 3, 0.7, 1e-6, form) for form in ("primal", "cheaper"))
        np.testing.assert_allclose(dense.posterior_covariance(precision, x, 3, 0.7, 1e-6, "dual"), primal, atol=1e-9)
        np.testing.assert_allclose(cheaper, primal, atol=1e-9)


def test_offsets_shrink_to_the_truth(spark):
    rng = np.random.default_rng(8)
    rows = [(f"s{s}", h, 0, float(b + rng.normal(scale=2))) for s, b in enumerate(rng.normal(5, 1.5, 500)) for h in range(int(rng.integers(2, 24)))]
    got = D.offset_components(spark.createDataFrame(rows, "subject_id string, hour int, m int, xi double")).first()
    np.testing.assert_allclose([got.within, got.between, got["mean"]], [4, 2.25, 5], rtol=0.2)


def test_twins_in_blocks_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(70, 4))
    x[9] = x[3] * 2  # a tie: the smaller id counts
    first, second = (spark.createDataFrame([(f"s{i:02d}", (v + e).tolist()) for i, v in enumerate(x)], "subject_id string, fingerprint array<double>") for e in (0.0, 0.0))
    got = {r.subject_id: (r.twin, r.matched) for r in D.twin_matches(first, second, block=16).collect()}
    assert got["s03"] == ("s03", True) and got["s09"] in {("s03", False), ("s09", True)} and sum(m for _, m in got.values()) >= 69
    assert D.twin_matches(first, second.where("false")).count() == 0
