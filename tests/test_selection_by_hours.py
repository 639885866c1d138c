import numpy as np
import pytest
from pyspark.sql import functions as F
from test_estimators import curves

from dayline.dataset import CurveSet
from dayline.operators import estimators, selection


def test_errors_of_hours_left_out_equal_refits(spark):
    data, rows = curves(spark, 12)
    lone = spark.createDataFrame([("lone", 5, [1.0, 2.0, 3.0, 4.0, 5.0])], data.observations.schema)
    data = CurveSet(data.observations.unionByName(lone), data.scales)
    model, found = selection.selected_by_hours(data, (1, 2), (1, 2), folds=2)
    placed = data.observations.withColumn("fold", selection.hour_fold(2, 42))
    at = {(r.subject_id, r.hour): (r.fold, np.array(r.curve)) for r in placed.collect()}
    assert {f for f, _ in at.values()} == {0, 1}
    for m, h, error in found:
        if m == 1 and h == 1:
            continue  # three of the four pairs
        total = 0.0
        for k in range(2):
            rest = CurveSet(placed.where(F.col("fold") != k).drop("fold"), data.scales)
            fitted = estimators.fit_spectral(rest, m, h, 0.25)
            whole = {(r.subject_id, r.hour): np.array(r.curve) for r in fitted.reconstruct(rest, all_hours=True).collect()}
            total += sum(((c - whole.get(key, fitted.basis.mean)) ** 2).mean() for key, (f, c) in at.items() if f == k)
        assert error == pytest.approx(total / len(at), rel=1e-9)
    best = min(found, key=lambda x: x[2])
    assert (len(model.basis.modes), model.harmonics) == best[:2]
