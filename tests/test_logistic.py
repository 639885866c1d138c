import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from dayline.operators import evaluation, logistic


def table(spark, classes, n=240, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, 4)) * [1, 30, 0.1, 5] + np.outer(y, [0.8, 10, 0.05, 0]) + [0, 100, 0, 3]
    return spark.createDataFrame([(f"s{i}", a.tolist(), int(b), i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))], "subject_id string, fingerprint array<double>, target int, fold int")


@pytest.mark.parametrize("classes", [2, 4])
def test_all_folds_equal_separate_fits(spark, classes):
    rows = table(spark, classes)
    got = {r.subject_id: r for r in evaluation.logistic_scores(rows.drop("fold"), 3, placed=rows.select("subject_id", "fold")).collect()}
    assert len(got) == rows.count()
    at = rows.withColumn("features", array_to_vector("fingerprint"))
    for k in range(3):
        train = at.where(F.col("fold") != k)
        model = LogisticRegression(labelCol="target", maxIter=2000, tol=1e-12, standardization=False, regParam=1 / train.count()).fit(train)
        want = model.transform(at.where(F.col("fold") == k)).select("subject_id", vector_to_array("probability").alias("p"))
        for r in want.collect():
            np.testing.assert_allclose(got[r.subject_id].probability, r.p, atol=2e-4)
            assert got[r.subject_id].fold == k
    scored = evaluation.logistic_scores(rows.drop("fold"), 3)
    found = evaluation.classification(scored)
    areas = []
    for c in range(classes) if classes > 2 else [1]:
        one = scored.select(F.col("probability")[c].alias("s"), (F.col("target") == c).cast("double").alias("l"))
        areas.append(BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="l", numBins=0).evaluate(one))
    assert found["auc"] == pytest.approx(np.mean(areas), abs=1e-9)


def test_gradient_is_nought_at_the_models(spark):
    rows = table(spark, 3)
    w, counts = logistic.fold_models(rows, 3, 0.5)
    data = rows.collect()
    for f in range(3):
        some = [r for r in data if r.fold != f]
        x, y = np.array([[1.0, *r.fingerprint] for r in some]), np.array([r.target for r in some])
        left = logistic.probabilities(x, w[f], counts[f]) - np.eye(3)[y]
        g = 0.5 * left.T @ x + np.column_stack([np.zeros(3), w[f][:, 1:]])
        assert np.abs(g).max() < 1e-4


def test_a_training_set_may_lack_classes(spark):
    rows = spark.createDataFrame([(f"s{i}", [float(i % 5)], [0, 1, 2][i % 3] if i < 20 else 3, 0 if i >= 20 else i % 2) for i in range(24)], "subject_id string, fingerprint array<double>, target int, fold int")
    got = evaluation.logistic_scores(rows.drop("fold"), 2, placed=rows.select("subject_id", "fold")).collect()
    assert all(r.probability[3] == 0 for r in got if r.fold == 0) and all(sum(r.probability) == pytest.approx(1) for r in got)
    one = rows.where("target = 1").withColumn("target", F.lit(1))
    assert all(r.prediction == 1 for r in evaluation.logistic_scores(one.drop("fold"), 2, placed=one.select("subject_id", "fold")).collect())
    assert np.isnan(evaluation.classification(evaluation.logistic_scores(one.drop("fold"), 2, placed=one.select("subject_id", "fold")))["auc"])
