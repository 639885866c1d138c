import logging
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayline import schema
from dayline.dataset import CurveSet
from dayline.functions.curves import coherence, entropy, monotonicity
from dayline.operators import autoencoder, estimators, selection, two_level
from dayline.sources import models, tables


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Five subjects, one of them a child; scale 2 has a gap at hour 0; hour 3 lacks a scale; one subject has three hours only."""
    base = tmp_path_factory.mktemp("files")
    folder = Path(base) / "986"
    folder.mkdir()
    (folder / "covariates_1h.csv").write_text("Code,age,BNP,sex,hour\n01,40,100,m,0\n01,40,,m,1\n2,17,5,f,0\n3,50,,f,0\n4,60,0,m,0\n5,70,12,f,0\n")
    for hour in range(5):
        scales = ("0.8", "1.0", "1.2") if hour == 3 else ("0.8", "1.0", "1.2", "2.0")
        lines = ["Code," + ",".join(scales)]
        for s in ("01", "2", "3", "4", "5"):
            if s == "5" and hour > 2:
                continue
            values = [f"{int(s)}.{hour}{k}" for k in range(len(scales))]
            if hour == 0 and s == "3":
                values[-1] = ""
            lines.append(",".join([s, *values]))
        (folder / f"lmds_1h_{hour}.csv").write_text("\n".join(lines) + "\n")
    return str(base)


def test_covariates_keep_ids_as_text_and_adults_only(spark, root):
    rows = tables.covariates(spark, tables.covariate_path(root, "986", 1))
    assert {r.subject_id for r in rows.collect()} == {"01", "3", "4", "5"}
    types = dict(rows.dtypes)
    assert (types["BNP"], types["sex"], types["age"]) == ("double", "string", "double")


def test_hours_load_with_common_scales_and_missing_files_are_logged(spark, root, caplog):
    people = tables.covariates(spark, tables.covariate_path(root, "986", 1))
    with caplog.at_level(logging.WARNING):
        rows, scales = tables.hourly_curves(spark, {h: tables.curve_path(root, "986", "lmds", 1, h) for h in range(6)}, subjects=people)
    assert "hour 5" in caplog.text and scales == [0.8, 1.0, 1.2]
    assert {(r.subject_id, r.n) for r in rows.groupBy("subject_id").agg(F.count("*").alias("n")).collect()} == {("01", 5), ("3", 5), ("4", 5)}
    assert rows.where("subject_id = '01' AND hour = 2").first().curve == [1.20, 1.21, 1.22]
    with pytest.raises(ValueError, match="hours"):
        tables.hourly_curves(spark, {0: tables.curve_path(root, "986", "lmds", 1, 0)})
    with pytest.raises(ValueError, match="no curves"):
        tables.hourly_curves(spark, {9: root + "/none.csv"})
    assert tables.catalog(spark, root).count() == 3 * 4 * (2 * 24 + 1)


def test_a_gate_of_the_supervised_load_gives_no_rows(spark):
    curves = spark.createDataFrame([(str(i), 4, [float(i), 1.0]) for i in range(12)], "subject_id string, hour int, curve array<double>")
    people = spark.createDataFrame([(str(i), h, None if h == 0 else float(10**i)) for i in range(12) for h in (0, 1, 2)], "subject_id string, hour int, BNP double")
    got = tables.supervised(people, curves, curves, "BNP").toPandas()
    assert len(got) == 12 and dict(zip(got.subject_id, got.target))["3"] == 3
    assert tables.supervised(people, curves.limit(9), curves, "BNP").count() == 0


def test_sinks_write_the_named_columns(spark, tmp_path):
    rows = spark.createDataFrame([("a", "auc", 0.5, None), ("a", "accuracy", 0.25, None), ("b", None, None, "failed")], "estimator string, metric string, value double, error string")
    path = tables.written_benchmark(rows, str(tmp_path), "986", 1, "lmds")
    back = spark.read.csv(path, header=True)
    assert back.columns == ["estimator", "Reconstruction_MSE", "Classification_Acc", "Classification_AUC", "Silhouette_Score", "Adjusted_Rand_Index"] and back.count() == 2
    folds = spark.createDataFrame([(0, 1.0, 0.5, 0.7, 0.6)], "rep_fold int, mse double, r2 double, pearson_r double, spearman_rho double")
    assert spark.read.csv(tables.written_folds(folds, str(tmp_path), "986", 1, 4), header=True).first().r2 == "0.5"


def days(spark, n=12, points=6, hours=range(24)):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        a, b = rng.normal(size=(2, points))
        rows += [(f"s{i:02d}", h, (a * math.cos(2 * math.pi * h / 24) + b * math.sin(2 * math.pi * h / 24) + rng.normal(size=points) * 0.1 + i).tolist()) for h in hours if (h + i) % 7 or i < 3]
    return CurveSet(spark.createDataFrame(rows, "subject_id string, hour int, curve array<double>"), list(range(points)))


def test_containers_raise_and_look_up(spark):
    data = days(spark, 4)
    assert data.checked() is data and data.subject("s01").count() == 24
    with pytest.raises(KeyError):
        data.subject("zz")
    with pytest.raises(ValueError):
        data.copy_with(scales=[0.0, 1.0])
    with pytest.raises(ValueError):
        CurveSet(data.observations.where("false"), data.scales).checked()
    with pytest.raises(ValueError):
        schema.validated(data.observations.union(data.observations.limit(1)), 6)
    with pytest.raises(ValueError):
        data.tensor()
    assert data.subset([0, 3]).subject_ids().count() == 2 and [r.hour for r in data.ordered().limit(3).collect()] == [0, 1, 2]


def test_flat_curves_have_defined_features(spark):
    row = spark.createDataFrame([([2.0] * 5,)], "v array<double>").select(coherence(F.col("v")).alias("c"), monotonicity(F.col("v")).alias("m"), entropy(F.col("v")).alias("e")).first()
    assert (row.c, row.m, row.e) == (None, 1.0, 0.0)


def test_models_come_back_from_files(spark, tmp_path):
    data = days(spark, 6)
    auto = autoencoder.fit_autoencoder(data, code=3, hidden=4, steps=2)
    for k, model in enumerate((estimators.fit_spectral(data, 2), estimators.fit_harmonic(data, "diagonal", 2), two_level.fit_two_level(data), auto)):
        models.saved(model, spark, f"{tmp_path}/{k}")
        back = models.loaded(spark, f"{tmp_path}/{k}")
        assert type(back) is type(model)
        a, b = (m.transform(data).toPandas().set_index("subject_id").fingerprint for m in (model, back))
        for s in a.index:
            np.testing.assert_allclose(a[s], b[s])


def test_selection_equals_a_loop_over_fits(spark):
    data = days(spark, 10)
    model, found = selection.selected(data, "cv", 0.25, folds=3, harmonics=1)
    assert [m for m, _, _ in found] == [2, 3, 5]
    ids = sorted(r.subject_id for r in data.subject_ids().collect())
    want = []
    for m in (2, 3, 5):
        total = 0.0
        for k in range(3):
            left = ids[3 * k : 3 * k + 3]
            train = CurveSet(data.observations.where(~F.col("subject_id").isin(left)), data.scales)
            test = CurveSet(data.observations.where(F.col("subject_id").isin(left)), data.scales)
            one = estimators.fit_spectral(train, m, 1, 0.25)
            both = test.observations.join(one.reconstruct(test).withColumnRenamed("curve", "fitted"), ["subject_id", "hour"]).toPandas()
            both["e"] = [((np.array(a) - np.array(b)) ** 2).mean() for a, b in zip(both.curve, both.fitted)]
            total += both.groupby("subject_id").e.mean().sum()
        want.append(total / 3)
    np.testing.assert_allclose([e for _, _, e in found], want, rtol=1e-8)
    assert len(model.basis.modes) == (2, 3, 5)[int(np.argmin(want))]
    with pytest.raises(ValueError, match="n_modes"):
        estimators.fit_basis(data, "cv")
