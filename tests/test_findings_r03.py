"""Faults that a reviewer found, each with a small case that failed before."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayline.dataset import CurveSet
from dayline.operators import autoencoder, convolution, estimators, evaluation, geometry, selection, sums
from dayline.plans import fixed_basis
from dayline.plans.sql import events_set
from dayline.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_joined_without_copies_on_the_driver(spark):
    people = spark.range(50).selectExpr("CAST(id AS string) AS subject_id", "explode(sequence(0, 23)) AS hour", "CAST(id AS double) AS age")
    rows = spark.range(50 * 24).selectExpr("CAST(id div 24 AS string) AS subject_id", "CAST(id % 24 AS int) AS hour", "transform(sequence(0, 4), j -> CAST(id + j * j AS double)) AS curve")
    found = tables.features(rows, [0.7, 0.9, 1.1, 1.3, 1.45], people)
    assert "Broadcast" not in plan(found)
    assert found.count() == 50 * 24


def test_loss_of_the_day_autoencoder_is_one_job(spark, monkeypatch):
    calls, whole = [], autoencoder.dense.minimised

    def counted(loss, start, steps):
        return whole(lambda w: calls.append(1) or loss(w), start, steps)

    monkeypatch.setattr(autoencoder.dense, "minimised", counted)
    data = events_set(spark, SF)
    context = spark.sparkContext
    context.setJobGroup("autoencoder", "counted")
    try:
        found = autoencoder.fit_autoencoder(data, 3, 4, 12)
        jobs = context.statusTracker().getJobIdsForGroup("autoencoder")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= len(calls) + 8  # and those that lay the blocks out
    # the first loss is that of all days
    x, mask = autoencoder.laid_out(autoencoder.days(data).toPandas(), 5)
    form = autoencoder.shapes(5, 4, 3)
    w = autoencoder.first_weights(form)
    direct = autoencoder.loss_and_gradient(autoencoder.parted(w, form), x, mask)
    assert found.losses[0] == pytest.approx(direct[0] / direct[-1] + 0.5e-4 * w @ w)
    assert found.losses[-1] < found.losses[0]


def test_rows_are_augmented_together_as_one_by_one():
    x = np.random.default_rng(3).standard_normal((9, 2, 64))
    seeds = [5, 2**62 + 1, 7, 0, 11, 3, 99, 4, 8]
    one = np.stack([convolution.augmented(v, np.random.default_rng(k)) for v, k in zip(x, seeds, strict=True)])
    np.testing.assert_array_equal(convolution.augmented_rows(x, seeds), one)


@pytest.mark.parametrize("what", ["conv_fingerprint", "conv_reconstruct"])
def test_an_encoder_alone_does_not_fit_the_regressor(spark, monkeypatch, what):
    calls, whole = [], convolution.training.fitted
    monkeypatch.setattr(convolution.training, "fitted", lambda rows, columns, w, gradients, *more: calls.append(gradients.args[0]) or whole(rows, columns, w, gradients, convolution.Schedule(1, 64, 1e-3), *more[1:]))
    assert fixed_basis.UNSTATED[what](spark, SF).count() > 0
    assert calls == ["autoencoder"]


def test_ranks_are_taken_from_counted_pairs(spark, monkeypatch):
    seen, whole = [], evaluation.grouped_ranks
    monkeypatch.setattr(evaluation, "grouped_ranks", lambda rows, *more: seen.append(rows.count()) or whole(rows, *more))
    t, p = [float(i % 5) for i in range(300)], [float(i * i % 7) for i in range(300)]
    found = evaluation.regression(spark.createDataFrame(list(zip(t, p, strict=True)), "target double, prediction double"))
    ranks = [pd.Series(v).rank().to_numpy() for v in (t, p)]
    assert found["spearman"] == pytest.approx(np.corrcoef(*ranks)[0, 1])
    assert seen == [len(set(zip(t, p, strict=True)))] * 2


def test_distances_by_products_hold_for_rows_close_together():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 64)) + 1e6
    y = np.vstack([x[:20], x[20:] + 1e-3 * rng.standard_normal((20, 64)), rng.standard_normal((10, 64)) + 1e6])
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    found = evaluation.apart(x, y)
    np.testing.assert_allclose(found, want, rtol=1e-8)
    assert (found[np.arange(20), np.arange(20)] == 0).all()


def test_benchmark_makes_the_curves_once(spark):
    levels = []

    def fit(data):
        levels.append(data.observations.storageLevel.useMemory)
        raise ValueError("only asked")

    data = events_set(spark, SF)
    labels = data.subject_ids().withColumn("label", F.lit(0.0))
    assert evaluation.benchmark({"a": fit, "b": fit}, data, labels).count() == 2
    assert levels == [True, True] and not data.observations.storageLevel.useMemory


def jobs_of(spark, name, call):
    context = spark.sparkContext
    context.setJobGroup(name, "counted")
    try:
        out = call()
        return out, len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def some_days(spark, n: int = 30) -> CurveSet:
    """Days of 1 to 24 hours, among them hours at which harmonics look alike."""
    rng = np.random.default_rng(8)
    kept = [rng.permutation(24)[: 1 + 23 * k // (n - 1)] for k in range(n)] + [[0, 12], [0, 6, 12, 18], [0, 8, 16]]
    level = rng.normal(0, 3, (len(kept), 5)) + 1e3
    rows = [(f"s{k:02d}", int(h), (level[k] + np.cos(2 * np.pi * h / 24) * np.arange(5) + rng.standard_normal(5)).tolist()) for k, own in enumerate(kept) for h in own]
    return CurveSet(spark.createDataFrame(rows, "subject_id string, hour int, curve array<double>"), [0.0, 1.0, 2.0, 4.0, 8.0])


def test_hours_left_out_are_chosen_by_few_passes(spark):
    data = some_days(spark)
    (model, found), jobs = jobs_of(spark, "by hours", lambda: selection.selected_by_hours(data))
    assert len(found) == 9 and jobs <= 20
    one = estimators.fit_spectral(data, len(model.basis.modes), model.harmonics)
    for name in ("noise", "spectra"):
        np.testing.assert_allclose(getattr(model, name), getattr(one, name), rtol=1e-7, atol=1e-9)
    layout = sums.Layout(5, 3, fewer=(1, 2))
    total = sums.day_sums(data, layout)
    for h in (1, 2, 3):
        fit = sums.fit_of(total, layout, data.scales, 3, h)
        scores = data.observations.select("subject_id", "hour", fit.basis.scores().alias("xi"))
        np.testing.assert_allclose(fit.noise, estimators.mode_noise(scores, h, 24.0), rtol=1e-6)


def test_subjects_left_out_are_chosen_by_few_passes(spark):
    data = some_days(spark)
    (_, found), jobs = jobs_of(spark, "by subjects", lambda: selection.selected(data, "cv", 0.25, folds=2))
    assert len(found) == 3 and jobs <= 30
    placed = data.observations.join(selection.contiguous_folds(data.subject_ids(), 2, equal=True), "subject_id").persist()
    total = 0.0
    for k in range(2):
        left, rest = (CurveSet(placed.where(at).drop("fold"), data.scales) for at in (F.col("fold") == k, F.col("fold") != k))
        fitted = estimators.fit_spectral(rest, 2).reconstruct(left).withColumnRenamed("curve", "fitted").join(left.observations, ["subject_id", "hour"]).toPandas()
        e = [((np.array(a) - np.array(b)) ** 2).mean() for a, b in zip(fitted["fitted"], fitted["curve"], strict=True)]
        total += pd.Series(e).groupby(fitted["subject_id"]).mean().sum()
    placed.unpersist()
    assert found[0][:2] == (2, 0.25) and found[0][2] == pytest.approx(total / 2, rel=1e-7)


def test_copies_that_differ_by_rounding_are_one_node(spark):
    x = np.random.default_rng(4).uniform(1, 300, (40, 3))
    rows = [(f"s{i:02d}-{c}", (v * (1 + c * 2.0**-52)).tolist()) for i, v in enumerate(x) for c in range(4)]
    prints = spark.createDataFrame(rows, "subject_id string, fingerprint array<double>")
    assert sorted(geometry.nodes(prints).select("node", "w").collect()) == [(f"s{i:02d}-0", 4.0) for i in range(40)]
    found, spectrum = geometry.diffusion_map(prints, components=2, k=6)
    places = {r.subject_id: r.coordinates for r in found.collect()}
    assert len(places) == 160 and all(places[s] == places[s[:-1] + "0"] for s in places)
    _, one = geometry.diffusion_map(prints.where("subject_id LIKE '%-0'"), components=2, k=6)
    np.testing.assert_allclose(spectrum.values, one.values, rtol=1e-6)
