import numpy as np
import pytest

from dayline.operators import linkage

OUTER, INNER = 4, 3


def table(spark, n=160, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) @ rng.normal(size=(6, 6)) + 50
    x[:, 4] = 7.0  # no variance
    y = x @ np.array([1.0, 0, -2.0, 0, 3.0, 0.5]) + rng.normal(size=n) + 1000
    at = rng.integers(0, OUTER, n), rng.integers(0, INNER, n)
    names = [f"s{i}" for i in range(n)]
    rows = spark.createDataFrame([(s, a.tolist(), float(b)) for s, a, b in zip(names, x, y, strict=True)], "subject_id string, fingerprint array<double>, target double")
    placed = spark.createDataFrame([(s, int(o), int(i)) for s, o, i in zip(names, *at, strict=True)], "subject_id string, outer int, inner int")
    return x, y, at, rows, placed


def standard(x, y):
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-9, np.inf, scale)
    return (x - mean) / scale, y - y.mean(), mean, scale


def dense_pls(x, y, components):
    """One component after another taken out of the rows themselves."""
    z, t, mean, scale = standard(x, y)
    left, w, p, q, out = z.copy(), [], [], [], []
    for _ in range(components):
        a = left.T @ t
        if np.linalg.norm(a) < 1e-8:
            break
        a /= np.linalg.norm(a)
        score = left @ a
        load = left.T @ score / (score @ score)
        q.append(score @ t / (score @ score))
        left = left - np.outer(score, load)
        w.append(a)
        p.append(load)
        weights, loads = np.array(w).T, np.array(p).T
        out.append(weights @ np.linalg.solve(loads.T @ weights, np.array(q)) / scale)
    return [(mean, y.mean(), b) for b in out]


def test_components_equal_those_taken_out_of_rows(spark):
    x, y, at, rows, placed = table(spark)
    found = linkage.products(rows, OUTER, INNER, placed=placed)
    m = linkage.Moments.of(found.cells.sum(axis=(0, 1)))
    got = [m.line(b)[1:] for _, b in linkage.partial_least_squares(m)]
    want = [b for *_, b in dense_pls(x, y, 10)]
    assert len(got) >= 5
    for a, b in zip(got[:5], want[:5], strict=True):
        np.testing.assert_allclose(a, b, atol=1e-7)


def test_elastic_net_meets_its_optimality_conditions(spark):
    x, y, at, rows, placed = table(spark)
    m = linkage.Moments.of(linkage.products(rows, OUTER, INNER, placed=placed).cells.sum(axis=(0, 1)))
    z, t, _, _ = standard(x, y)
    for mix in linkage.MIXES:
        top = np.abs(z.T @ t / len(t)).max() / mix
        path = linkage.elastic_net(m, mix)
        assert np.count_nonzero(path[0][1]) < np.count_nonzero(path[-1][1]) == 5
        for share, (_, b) in zip(linkage.SHARES, path, strict=True):
            slope = z.T @ (t - z @ b) / len(t) - share * top * (1 - mix) * b
            on = b != 0
            np.testing.assert_allclose(slope[on], share * top * mix * np.sign(b[on]), atol=1e-6)
            assert (np.abs(slope[~on]) <= share * top * mix + 1e-6).all()


def test_nested_choices_and_errors_equal_loops_over_rows(spark):
    x, y, (outer, inner), rows, placed = table(spark)
    got = {(m, f): (c, n, mse, r2) for m, f, c, n, mse, r2 in linkage.nested(linkage.products(rows, OUTER, INNER, placed=placed))}
    assert len(got) == OUTER * len(linkage.METHODS)

    def pls(train, test):
        return [((y[test] - (my + (x[test] - mx) @ b)) ** 2).sum() for mx, my, b in dense_pls(x[train], y[train], 5)]

    def ridge(train, test):
        z, t, mean, scale = standard(x[train], y[train])
        out = []
        for a in linkage.ALPHAS:
            b = np.linalg.solve(z.T @ z + a * np.eye(6), z.T @ t) / scale
            out.append(((y[test] - y[train].mean() - (x[test] - mean) @ b) ** 2).sum())
        return out

    for name, errors, label in (("partial_least_squares", pls, lambda k: f"components={k + 1}"), ("ridge", ridge, lambda k: f"alpha={linkage.ALPHAS[k]:g}")):
        for o in range(OUTER):
            tried = sum(np.array(errors((outer != o) & (inner != i), (outer != o) & (inner == i))) for i in range(INNER))
            k = int(tried.argmin())
            test = outer == o
            choice, n, mse, r2 = got[name, o]
            want = errors(~test, test)[k]
            assert n == test.sum()
            np.testing.assert_allclose([mse, r2], [want / n, 1 - want / ((y[test] - y[test].mean()) ** 2).sum()], rtol=1e-6)
            if name == "ridge":
                assert choice == label(k)
    assert all(got["mean", o][3] <= 0 for o in range(OUTER))
    assert all(got[m, o][3] > 0.5 for m in ("ridge", "elastic_net", "partial_least_squares") for o in range(OUTER))


def test_the_model_of_all_rows_predicts_as_columns(spark):
    x, y, _, rows, placed = table(spark)
    model = linkage.linked(linkage.products(rows, OUTER, INNER, placed=placed), "partial_least_squares")
    got = {r.subject_id: r.prediction for r in model.predict(rows).collect()}
    k = int(model.choice.split("=")[1])
    mx, my, b = dense_pls(x, y, k)[k - 1]
    np.testing.assert_allclose([got[f"s{i}"] for i in range(len(y))], my + (x - mx) @ b, atol=1e-6)


def test_rows_without_numbers_take_no_part_and_folds_may_be_empty(spark):
    x, y, _, rows, _ = table(spark, 40)
    odd = spark.createDataFrame([("n", None, 1.0), ("m", [None] * 6, 1.0), ("i", [float("inf")] * 6, 1.0), ("y", [0.0] * 6, None), ("z", [0.0] * 6, float("nan"))], rows.schema)
    a, b = (linkage.products(r, 3, 2).cells for r in (rows, rows.unionByName(odd).repartition(5)))
    np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-6)
    few = linkage.nested(linkage.products(rows.limit(3), 7, 2))
    assert all(n >= 1 for *_, n, _, _ in few)
    with pytest.raises(ValueError):
        linkage.products(rows.limit(0))
    with pytest.raises(ValueError):
        linkage.products(rows.unionByName(spark.createDataFrame([("w", [1.0], 1.0)], rows.schema)))
