from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayline.operators import convolution as C
from dayline.operators import evaluation, training
from dayline.operators.training import Schedule, is_moment


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(48, 2, 22))
    y = x[:, 0, 5:9].mean(axis=1) * 2
    made = [(f"s{i % 16}", i // 16, v[0].tolist(), v[1].tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(made, "subject_id string, hour int, a array<double>, b array<double>, target double").repartition(2)


@pytest.mark.parametrize("kind", ["autoencoder", "regressor"])
def test_gradients_are_those_of_the_loss(kind):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(5, 2, 18)), rng.normal(size=5)
    w = C.first_weights(kind)
    _, grads, _ = C.block_sums(kind, w, x, y, None)
    assert set(grads) == {n for n in w if not is_moment(n)}
    for name, g in grads.items():
        at = tuple(rng.integers(0, s) for s in g.shape)
        ends = []
        for step in (1e-6, -1e-6):
            moved = {k: v.copy() for k, v in w.items()}
            moved[name][at] += step
            ends.append(C.block_sums(kind, moved, x, y, None)[0])
        assert abs((ends[0] - ends[1]) / 2e-6 - g[at]) < 1e-4 * max(1, abs(g[at])), name


def test_spread_is_the_adjoint_of_a_strided_convolution():
    rng = np.random.default_rng(1)
    k = rng.normal(size=(3, 4, 5))
    x, y = rng.normal(size=(2, 3, 6)), rng.normal(size=(2, 4, 12))
    up = C.Tape({"u.k": k, "u.b": np.zeros(4)}, False).spread(x, "u")
    down = C.Tape({"d.k": k, "d.b": np.zeros(3)}, False).conv(y, "d", 2)
    assert up.shape == y.shape and down.shape == x.shape
    np.testing.assert_allclose((up * y).sum(), (x * down).sum())


def test_training_lowers_the_loss_and_predicts(rows):
    auto = C.fit_conv_autoencoder(rows, Schedule(12, 16, 1e-3))
    assert auto.losses[-1] < auto.losses[0] and len(auto.losses) == 12
    assert auto.reconstruct(rows).where(F.size("a") == 22).count() == 48
    assert len(auto.transform(rows).first().fingerprint) == 64
    model = C.fit_conv_regressor(rows, auto, Schedule(30, 16, 2e-3, augment=False))
    assert model.losses[-1] < 0.6 * model.losses[0]
    got = model.predict(rows).toPandas()
    np.testing.assert_allclose(got["attention"].map(sum), 1)
    seen = np.stack(model.importance(rows).toPandas()["importance"])
    assert seen.shape == (48, 22) and seen.min() >= 0 and seen.max() <= 1
    assert C.importance_panel(rows, model.importance(rows), list(range(22))).count() == 22


def plain(rows, kind, start, s):
    """One process: every row in the order of its key, an Adam step for each batch."""
    table = rows.withColumn("key", F.xxhash64("subject_id", "hour")).toPandas().sort_values("key")
    x, y, keys = C.channels_of(table), table["target"].to_numpy(), table["key"].to_numpy()
    w = {n: v.copy() for n, v in start.items()}
    m, v, step = {n: 0 * a for n, a in w.items()}, {n: 0 * a for n, a in w.items()}, 0
    for epoch in range(s.epochs):
        rng = np.random.default_rng([s.seed, epoch, 0])
        order = rng.permutation(len(x))
        for i in range(0, len(x), s.batch):
            at, step = order[i : i + s.batch], step + 1
            _, grads, moments = C.block_sums(kind, w, x[at], y[at], keys[at] + epoch if s.augment else None, rng)
            for n in w:
                if n in moments:
                    w[n] = 0.9 * w[n] + 0.1 * moments[n]
                    continue
                g = grads[n] / len(at) + s.decay * w[n]
                m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.999 * v[n] + 0.001 * g * g
                w[n] = w[n] - s.rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return w


@pytest.mark.parametrize("kind", ["autoencoder", "regressor"])
def test_local_steps_equal_one_process(rows, kind):
    s = Schedule(3, 16, 1e-3, 1e-4)
    fit = C.fit_conv_autoencoder if kind == "autoencoder" else C.fit_conv_regressor
    found = fit(rows, schedule=s).weights
    for n, v in plain(rows, kind, C.first_weights(kind), s).items():
        np.testing.assert_allclose(found[n], v, atol=1e-10)


@pytest.mark.parametrize("shard_rows", [100, 12])
def test_a_fit_does_not_depend_on_partitions(rows, shard_rows):
    """All rows in one shard, or several shards whose weights are averaged after each epoch."""
    fits = []
    for parts in (1, 4, 16):
        dealt = rows.repartition(parts, F.rand(parts))
        fits.append(training.fitted(dealt, C.CHANNELS, C.first_weights("regressor"), partial(C.block_sums, "regressor"), Schedule(3, 8, 1e-3), "target", shard_rows=shard_rows)[0])
    for w, losses in fits[1:]:
        np.testing.assert_allclose(losses, fits[0][1], rtol=1e-9)
        for n, v in w.items():
            np.testing.assert_allclose(v, fits[0][0][n], atol=1e-9)


def test_averaged_shards_and_small_batches_learn(spark):
    """Rows that a fit has not seen: averaged shards are about as good as one, and both better than as many steps over all rows."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 2, 16))
    made = [(f"s{i}", 0, v[0].tolist(), v[1].tolist(), float(2 * v[0, 5:9].mean() - v[1, :4].mean())) for i, v in enumerate(x)]
    rows = spark.createDataFrame(made, "subject_id string, hour int, a array<double>, b array<double>, target double")
    learn, rest = rows.where("int(substr(subject_id, 2)) % 4 != 0"), rows.where("int(substr(subject_id, 2)) % 4 = 0")

    def error(batch, shard_rows):
        s = Schedule(20, batch, 2e-3, augment=False)
        w = training.fitted(learn, C.CHANNELS, C.first_weights("regressor"), partial(C.block_sums, "regressor"), s, "target", shard_rows=shard_rows)[0][0]
        got = C.ConvRegressor(w).predict(rest).join(rest.select("subject_id", "target"), "subject_id")
        return got.agg(F.avg((F.col("prediction") - F.col("target")) ** 2)).first()[0]

    small, averaged, whole = error(16, 1000), error(16, 60), error(None, 1000)
    spread = rest.agg(F.var_pop("target")).first()[0]
    assert small < whole and averaged < whole and max(small, averaged) < spread


def test_cross_validation_equals_separate_fits(rows):
    s = Schedule(2, 16, 1e-3)
    figures, said = C.cross_validated(rows, folds=2, repeats=2, schedule=s)
    assert [r.rep_fold for r in figures.orderBy("rep_fold").collect()] == [0, 1, 2, 3]
    assert said.count() == 2 * rows.count()
    own = evaluation.fold(2, repeat=1)
    left = rows.where(own == 1)
    model = C.fit_conv_regressor(rows.where(own != 1), schedule=s)
    both = left.select("subject_id", "hour", "target").join(model.predict(left), ["subject_id", "hour"])
    want = evaluation.regression(both)
    got = figures.where("rep_fold = 3").first()
    np.testing.assert_allclose([got.mse, got.r2, got.pearson_r, got.spearman_rho], [want["mse"], want["r2"], want["pearson"], want["spearman"]], rtol=1e-8)


def test_grouped_figures_have_mean_ranks_of_ties(spark):
    rng = np.random.default_rng(1)
    made = [(int(g), float(a), float(b)) for g, a, b in zip(rng.integers(0, 3, 400), rng.integers(0, 9, 400), rng.integers(0, 7, 400), strict=True)] + [(9, 1.0, 2.0)]
    rows = spark.createDataFrame(made, "k int, target double, prediction double")
    got = {r.k: r for r in evaluation.grouped_regression(rows, "k").collect()}
    for k in range(3):
        want = evaluation.regression(rows.where(F.col("k") == k))
        np.testing.assert_allclose([got[k][c] for c in ("mse", "r2", "pearson", "spearman")], [want[c] for c in ("mse", "r2", "pearson", "spearman")])
    assert got[9].mse == 1 and got[9].r2 is None and got[9].spearman is None


def test_augmentation_keeps_form_and_masks_a_run():
    x = np.ones((2, 30)) * 5
    out = C.augmented(x, np.random.default_rng(3))
    assert out.shape == x.shape and (out == 0).sum() == 6 and (x == 5).all()
    np.testing.assert_array_equal(out, C.augmented(x, np.random.default_rng(3)))


def test_drawing_out_reads_straight_lines():
    np.testing.assert_allclose(C.drawn_out(np.array([[0.0, 1.0]]), 4), [[0, 0.25, 0.75, 1]])
