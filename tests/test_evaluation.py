import numpy as np
import pytest
from test_estimators import SCALES, curves

from dayline.dataset import CurveSet
from dayline.operators import autoencoder, evaluation, two_level


def by_hand(rows, subjects):
    """Curves of (subject, visit), not a number where a subject has fewer visits."""
    days = [sorted(((h, c) for s, h, c in rows if s == name), key=lambda x: x[0]) for name in subjects]
    x = np.full((len(days), max(map(len, days)), len(SCALES)), np.nan)
    for i, day in enumerate(days):
        x[i, : len(day)] = [c for _, c in day]
    return x


def test_two_levels_equal_the_dense_form(spark):
    data, rows = curves(spark)
    names = sorted({r[0] for r in rows})
    x = by_hand(rows, names)
    c = x - np.nanmean(x, axis=0)
    m = np.nanmean(c, axis=1)
    rest = (c - m[:, None]).reshape(-1, len(SCALES))
    within = np.cov(rest[~np.isnan(rest).any(axis=1)], rowvar=False)
    between = np.cov(m, rowvar=False) - within / x.shape[1]
    model = two_level.fit_two_level(data)
    np.testing.assert_allclose(model.mean, np.nanmean(x, axis=(0, 1)), atol=1e-9)
    for k, values, modes in ((between, model.between_variances, model.between), (within, model.within_variances, model.within)):
        all_values = np.maximum(np.linalg.eigvalsh(k)[::-1], 0)
        kept = int(np.searchsorted(np.cumsum(all_values) / all_values.sum(), 0.95) + 1)
        assert len(values) == kept
        np.testing.assert_allclose(values, all_values[:kept], atol=1e-9)
        np.testing.assert_allclose(k @ modes.T, modes.T * values, atol=1e-7)
    got = {r.subject_id: r.fingerprint for r in model.transform(data).collect()}
    np.testing.assert_allclose([got[n] for n in names], m @ model.between.T, atol=1e-9)
    at = {(r.subject_id, r.hour): r.curve for r in model.reconstruct(data).collect()}
    i = names.index("s3")
    mine = sorted(r[1] for r in rows if r[0] == "s3")
    want = np.nanmean(x, axis=0)[: len(mine)] + model.between.T @ model.between @ m[i] + (c[i] - m[i])[: len(mine)] @ model.within.T @ model.within
    np.testing.assert_allclose([at["s3", h] for h in mine], want, atol=1e-9)
    assert len(at) == len(rows)


def test_autoencoder_gradient_and_descent(spark):
    rng = np.random.default_rng(0)
    form = autoencoder.shapes(5, 3, 2)
    w = autoencoder.first_weights(form)
    x, mask = rng.normal(size=(4, 24, 5)), (rng.random((4, 24)) < 0.7).astype(float)
    x *= mask[:, :, None]
    value = lambda v: autoencoder.loss_and_gradient(autoencoder.parted(v, form), x, mask)
    grad = value(w)[1:-1]
    for k in range(0, len(w), 37):
        step = np.zeros_like(w)
        step[k] = 1e-6
        assert (value(w + step)[0] - value(w - step)[0]) / 2e-6 == pytest.approx(grad[k], abs=1e-6)
    data, rows = curves(spark, 12)
    model = autoencoder.fit_autoencoder(data, code=4, hidden=6, steps=8)
    assert model.losses[-1] < 0.8 * model.losses[0]
    prints = model.transform(data).collect()
    assert len(prints) == 12 and all(len(r.fingerprint) == 4 for r in prints)
    assert model.reconstruct(data).count() == len(rows)
    first = autoencoder.Autoencoder(autoencoder.first_weights(autoencoder.shapes(5, 6, 4)), 5, 6, 4)
    error = [evaluation.reconstruction_mse(data, m.reconstruct(data)).first()[0] for m in (first, model)]
    assert error[1] < error[0]


def labelled(spark, n=90, seed=5):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    x = rng.normal(size=(n, 4)) + y[:, None] * 1.5
    rows = [(f"s{i}", x[i].tolist(), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "subject_id string, fingerprint array<double>, target double"), x, y


def test_ridge_folds(spark):
    rows, x, y = labelled(spark)
    at = {r.subject_id: r.f for r in rows.select("subject_id", evaluation.fold(3).alias("f")).collect()}
    f = np.array([at[f"s{i}"] for i in range(len(y))])
    for k, got in enumerate(evaluation.ridge_r2(rows)):
        a, t = x[f != k], y[f != k]
        b = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + np.eye(4), (a - a.mean(0)).T @ (t - t.mean()))
        p = t.mean() + (x[f == k] - a.mean(0)) @ b
        assert got == pytest.approx(1 - ((y[f == k] - p) ** 2).sum() / ((y[f == k] - y[f == k].mean()) ** 2).sum())


def test_clustering_figures(spark):
    rows, x, y = labelled(spark)
    placed = rows.selectExpr("subject_id", "fingerprint", "cast(target as int) as cluster", "cast(target as int) div 2 as label")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    s = []
    for i in range(len(y)):
        a = d[i, y == y[i]].sum() / ((y == y[i]).sum() - 1)
        b = min(d[i, y == c].mean() for c in range(3) if c != y[i])
        s.append((b - a) / max(a, b))
    for block in (20, 1000):
        assert evaluation.silhouette(placed, block).first()[0] == pytest.approx(np.mean(s))
    pairs = lambda v: (v * (v - 1) / 2).sum()
    table = np.array([[((y // 2 == a) & (y == c)).sum() for c in range(3)] for a in range(2)])
    both, inl, inc = pairs(table), pairs(table.sum(1)), pairs(table.sum(0))
    expected = inl * inc / pairs(np.array([len(y)]))
    assert evaluation.adjusted_rand(placed).first()[0] == pytest.approx((both - expected) / ((inl + inc) / 2 - expected))


def test_scores_and_regression(spark):
    rows, x, y = labelled(spark)
    found = evaluation.classification(evaluation.logistic_scores(rows, 5))
    assert found["accuracy"] > 0.7 and found["auc"] > 0.85
    p = x.mean(axis=1).round(1)
    got = evaluation.regression(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "target double, prediction double"))
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert got["spearman"] == pytest.approx(np.corrcoef(rank(y), rank(p))[0, 1])
    assert got["pearson"] == pytest.approx(np.corrcoef(y, p)[0, 1]) and got["mse"] == pytest.approx(((y - p) ** 2).mean())
    one = spark.createDataFrame([(0.1, 1.0), (0.4, 1.0)], "s double, l double")
    assert np.isnan(evaluation.auc(one, one.s, one.l))


def test_matched_keeps_first_and_drops_missing(spark):
    prints = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "subject_id string, fingerprint array<double>")
    features = spark.createDataFrame([("a", 2, 5.0), ("a", 1, 7.0), ("b", 1, None), ("d", 1, 1.0)], "subject_id string, seq int, bnp double")
    got = evaluation.matched(prints, features, "bnp", "seq").collect()
    assert [(r.subject_id, r.target) for r in got] == [("a", 7.0)]


def test_benchmark_names_what_fails(spark):
    data, rows = curves(spark, 24)
    labels = spark.createDataFrame([(f"s{i}", i % 2) for i in range(24)], "subject_id string, label int")

    def broken(data: CurveSet):
        raise ValueError("no")

    got = evaluation.benchmark({"two": two_level.fit_two_level, "bad": broken}, data, labels, 3).collect()
    assert {r.metric for r in got if r.estimator == "two"} == {"reconstruction_mse", "accuracy", "auc", "silhouette", "adjusted_rand"}
    assert [r.error for r in got if r.estimator == "bad"] == ["ValueError: no"]
