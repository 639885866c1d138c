import numpy as np
import pytest
from pyspark.sql import functions as F

from dayline.operators.training import Schedule
from dayline.plans import experiment
from dayline.sources import models, tables


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Two of three cohorts, 14 subjects with the same numbers in both, hours 0 and 4; one more scale in the second cohort."""
    base, rng = tmp_path_factory.mktemp("cohorts"), np.random.default_rng(3)
    for cohort in ("986", "108"):
        folder = base / cohort
        folder.mkdir()
        lines = ["Code,age,BNP,hour", *(f"{s},{30 + s},{10 ** (1 + s / 10):.3f},0" for s in range(14))]
        (folder / "covariates_2h.csv").write_text("\n".join(lines) + "\n")
        for feature in tables.CURVES:
            for hour in (0, 4):
                scales = [0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.2] + [2.4] * (cohort == "108")
                rows = ["Code," + ",".join(map(str, scales)), *(f"{s}," + ",".join(f"{v:.4f}" for v in rng.normal(s / 5, 1, len(scales))) for s in range(14 if feature == "lmds" else 13))]
                (folder / f"{feature}_2h_{hour}.csv").write_text("\n".join(rows) + "\n")
    return str(base)


def test_cohorts_share_numbers_but_no_subjects(spark, root, caplog):
    rows, scales = tables.cohort_channels(spark, root, 2)
    assert scales == [0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.2] and "Healthy is left out" in caplog.text
    got = {(r.cohort, r.hour): r.n for r in rows.groupBy("cohort", "hour").agg(F.countDistinct("subject_id").alias("n")).collect()}
    assert got == {(c, h): 13 for c in ("986", "108") for h in (0, 4)}
    assert rows.select("subject_id").distinct().count() == 26
    both = tables.standardised(rows).select(F.explode("a").alias("v")).agg(F.avg("v"), F.stddev_pop("v")).first()
    np.testing.assert_allclose(both, [0, 1], atol=1e-4)
    nothing, none = tables.cohort_channels(spark, root, 6)
    assert none == [] and nothing.isEmpty() and nothing.columns == rows.columns


def test_experiment_writes_models_figures_and_panels(spark, root, tmp_path, caplog):
    out = str(tmp_path / "results")
    small = Schedule(2, 16, 1e-3)
    got = experiment.run(spark, root, out, (1, 2), (0, 4, 8), folds=2, repeats=2, pretraining=small, tuning=small).collect()
    assert {(r.window, r.hour) for r in got} == {(2, 0), (2, 4)} and len(got) == 8
    assert "window 1 is left out" in caplog.text and "window 2, hour 8 is left out" in caplog.text
    at = f"{out}/986/deep_learning_results/2"
    folds = spark.read.csv(f"{at}/metrics/cv_metrics_hour_0.csv", header=True, inferSchema=True)
    mse = [r.mse for r in folds.collect()]
    row = next(r for r in got if (r.hour, r.metric) == (0, "mse"))
    np.testing.assert_allclose([row.mean, row.deviation], [np.mean(mse), np.std(mse, ddof=1)])
    panel = spark.read.csv(f"{at}/figures/importance_hour_4.csv", header=True, inferSchema=True)
    assert panel.count() == 8 and panel.where("importance < 0 OR importance > 1").count() == 0
    assert set(models.loaded(spark, f"{at}/models/autoencoder").weights) >= {"conv0.k", "out.b"}
