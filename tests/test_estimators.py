import numpy as np

from dayline.dataset import CurveSet
from dayline.functions import dense
from dayline.operators import estimators

SCALES = [0.0, 1.0, 2.0, 4.0, 8.0]


def curves(spark, subjects=30, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(subjects):
        amp = rng.normal(size=(2, 5))
        for h in range(24):
            if rng.random() < 0.8:
                w = 2 * np.pi * h / 24
                rows.append((f"s{i}", h, (amp[0] * np.cos(w) + amp[1] * np.sin(w) + i % 3 + 0.1 * rng.normal(size=5)).tolist()))
    return CurveSet(spark.createDataFrame(rows, "subject_id string, hour int, curve array<double>"), SCALES), rows


def test_modes_equal_a_weighted_svd(spark):
    data, rows = curves(spark)
    x = np.array([r[2] for r in rows])
    w = np.array(data.weights)
    _, s, v = np.linalg.svd((x - x.mean(0)) * np.sqrt(w), full_matrices=False)
    b = estimators.fit_basis(data, 3)
    np.testing.assert_allclose(b.variances, (s**2 / (len(x) - 1))[:3], rtol=1e-9)
    np.testing.assert_allclose(np.abs(b.modes), np.abs(v[:3] / np.sqrt(w)), atol=1e-8)
    got = {(r.subject_id, r.hour): r.xi for r in data.observations.select("subject_id", "hour", b.scores().alias("xi")).collect()}
    want = ((x - x.mean(0)) * w) @ b.modes.T
    np.testing.assert_allclose([got[r[:2]] for r in rows], want, atol=1e-9)


def test_posteriors_equal_the_full_kronecker_form(spark):
    data, rows = curves(spark)
    model = estimators.fit_spectral(data, 3, prior_layout="aligned", prior_scale=2.0)
    mine = [r for r in rows if r[0] == "s4"]
    xi = ((np.array([r[2] for r in mine]) - model.basis.mean) * model.basis.weights) @ model.basis.modes.T
    c = xi - xi.mean(0)
    h = np.kron(np.eye(3), dense.fourier([r[1] for r in mine], 2))
    cov = np.linalg.inv(model.precision() + h.T @ h / model.noise + model.ridge * np.eye(12))
    want = cov @ h.T @ c.T.reshape(-1) / model.noise
    got = model.posteriors(data).where("subject_id = 's4'").first()
    np.testing.assert_allclose(got.mean, want, atol=1e-8)
    np.testing.assert_allclose(got.offsets, xi.mean(0), atol=1e-9)
    prints = model.transform(data).collect()
    assert len(prints) == 30 and all(len(r.fingerprint) == 15 for r in prints)
    at = {(r.subject_id, r.hour): r.curve for r in model.reconstruct(data).collect()}
    error = np.mean([(np.array(at[r[:2]]) - r[2]) ** 2 for r in rows])
    assert len(at) == len(rows) and error < 0.5 * np.var([r[2] for r in rows], axis=0).mean()
    assert model.reconstruct(data, all_hours=True).count() == 30 * 24


def test_cosinor_residuals_are_orthogonal(spark):
    data, rows = curves(spark, 5)
    at = {(r.subject_id, r.hour): r.curve for r in estimators.cosinor(data, reconstruct=True).collect()}
    mine = [r for r in rows if r[0] == "s2"]
    rest = np.array([r[2] for r in mine]) - np.array([at[r[:2]] for r in mine])
    np.testing.assert_allclose(dense.fourier([r[1] for r in mine], 2, intercept=True).T @ rest, 0, atol=1e-8)
    assert all(len(r.fingerprint) == 25 for r in estimators.cosinor(data).collect())


def test_harmonic_forms_agree_with_least_squares(spark):
    data, rows = curves(spark)
    plain = estimators.fit_harmonic(data, rotate=False)
    mine = [r for r in rows if r[0] == "s7"]
    xi = (np.array([r[2] for r in mine]) - plain.basis.mean) @ plain.basis.modes.T
    b = np.linalg.lstsq(dense.fourier([r[1] for r in mine], 2), xi - xi.mean(0), rcond=None)[0]
    amp = np.hypot(b[0::2], b[1::2])
    got = np.array(plain.transform(data).where("subject_id = 's7'").first().fingerprint)
    np.testing.assert_allclose(got[:3], xi.mean(0), atol=1e-8)
    np.testing.assert_allclose([got[3:6], got[9:12]], amp, atol=1e-8)
    rotated = estimators.fit_harmonic(data)
    turned = np.array(rotated.transform(data).where("subject_id = 's7'").first().fingerprint)
    np.testing.assert_allclose((turned[3:6] ** 2).sum(), (amp[0] ** 2).sum(), rtol=1e-8)
    diagonal = estimators.fit_harmonic(data, "diagonal")
    scaled = np.array(diagonal.transform(data).where("subject_id = 's7'").first().fingerprint)[3:].reshape(3, 2, 2)
    np.testing.assert_allclose(scaled[:, :, 0].T, amp * np.sqrt(diagonal.powers), atol=1e-8)
    np.testing.assert_allclose(scaled[:, :, 1].T, np.arctan2(-b[1::2], b[0::2]), atol=1e-8)
    assert plain.reconstruct(data).count() == len(rows)
