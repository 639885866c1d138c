"""Faults that a reviewer found in round 4, each with a small case that failed before."""

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from dayline.operators import convolution, evaluation, training
from dayline.operators.training import Schedule

LIKE = {"k": np.zeros(2)}


def noted(folder):
    """Gradients that leave a file for each task's attempt and partition."""

    def gradients(w, x, y, keys, rng):
        at = TaskContext.get()
        (folder / f"{at.stageId()}-{at.partitionId()}").write_text("")
        return 0.0, {"k": np.ones(2) * len(x)}, {}

    return gradients


@pytest.fixture(scope="module")
def numbered(spark):
    return spark.range(120).selectExpr("CAST(id AS string) AS subject_id", "0 AS hour", "array(CAST(id AS double), 1D) AS a").persist()


def test_each_shard_has_a_task_of_its_own_in_each_epoch(numbered, tmp_path):
    training.fitted(numbered, ("a",), LIKE, noted(tmp_path), Schedule(3, 8, 1e-3), shard_rows=20)
    assert len(list(tmp_path.iterdir())) == 3 * 6


def test_seeds_give_the_generators_that_they_give_alone():
    from dayline.functions import draws

    seeds = [0, 1, 2**32 - 1, 2**32, 2**63 - 1, 2**64 - 1, *np.random.default_rng(1).integers(0, 2**63, 500).tolist()]
    for seed, rng in zip(seeds, draws.generators(seeds), strict=True):
        one = np.random.default_rng(seed)
        assert rng.bit_generator.state == one.bit_generator.state
        assert rng.integers(-3, 4) == one.integers(-3, 4)  # half of a word stays behind, for the next state to drop


@pytest.mark.parametrize("length", [3, 8, 21, 64])
def test_few_channels_come_out_of_a_convolution_by_its_adjoint(length):
    rng = np.random.default_rng(length)
    w = {"out.k": rng.standard_normal((2, 6, 5)), "out.b": rng.standard_normal(2)}
    x, dy = rng.standard_normal((4, 6, length)), rng.standard_normal((4, 2, length))
    wide = np.pad(x, ((0, 0), (0, 0), (2, 2)))
    seen = np.stack([wide[:, :, i : i + length] for i in range(5)], axis=-1)
    t = convolution.Tape(w, True)
    np.testing.assert_allclose(t.conv(x, "out"), np.einsum("bcpi,oci->bop", seen, w["out.k"]) + w["out.b"][:, None], atol=1e-12)
    back = t.back(dy)
    np.testing.assert_allclose(t.grads["out.k"], np.einsum("bcpi,bop->oci", seen, dy), atol=1e-12)
    np.testing.assert_allclose((back * x).sum(), (dy * (t.conv(x, "out") - w["out.b"][:, None])).sum())
    assert back.shape == x.shape


def test_epochs_do_not_deal_rows_anew(spark, numbered, tmp_path):
    context, stages = spark.sparkContext, []
    for epochs in (2, 6):
        context.setJobGroup(f"epochs {epochs}", "counted")
        try:
            training.fitted(numbered, ("a",), LIKE, noted(tmp_path), Schedule(epochs, 8, 1e-3), shard_rows=20)
            tracker = context.statusTracker()
            stages.append(sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"epochs {epochs}")))
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
    assert stages[1] - stages[0] <= 4 * 3  # the stage that steps, beside those that lay the shards out, which it finds made


def test_each_model_has_a_task_of_its_own(numbered, tmp_path):
    models = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda k: k != F.col("subject_id").cast("int") % 10)
    found = training.fitted(numbered, ("a",), LIKE, noted(tmp_path), Schedule(2, 8, 1e-3), models=models, many=10)
    assert sorted(found) == list(range(10)) and len(list(tmp_path.iterdir())) == 10


@pytest.mark.parametrize("block", [7, 1000])
def test_copies_are_one_point_of_a_silhouette(spark, block):
    rng = np.random.default_rng(6)
    x, own = rng.uniform(1, 300, (40, 3)), np.append(np.arange(39) % 3, 9)  # the last one alone, but for its copies
    made = [(f"s{i:02d}-{c}", (v * (1 + c * 2.0**-52)).tolist(), int(k)) for i, (v, k) in enumerate(zip(x, own, strict=True)) for c in range(1 + i % 4)]
    made += [("one", [0.0, 5.0, 7.0], 11)]
    rows = spark.createDataFrame(made, "subject_id string, fingerprint array<double>, cluster int")
    assert sorted((r.point, r.w) for r in evaluation.points(rows).collect()) == [("one", 1.0)] + [(f"s{i:02d}-0", 1.0 + i % 4) for i in range(40)]
    z, k = np.array([r[1] for r in made]), np.array([r[2] for r in made])
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    s = []
    for i, c in enumerate(k):
        a = d[i, k == c].sum() / max((k == c).sum() - 1, 1)
        b = min(d[i, k == other].mean() for other in set(k) - {c})
        s.append((b - a) / max(a, b) if (k == c).sum() > 1 else 0.0)
    assert evaluation.silhouette(rows, block).first()[0] == pytest.approx(np.mean(s), rel=1e-10)


def test_starts_of_clusters_lay_vectors_out_themselves(spark, monkeypatch):
    seen, whole = [], evaluation.KMeans.fit
    monkeypatch.setattr(evaluation.KMeans, "fit", lambda self, rows: seen.append(rows.storageLevel.useMemory) or whole(self, rows))
    rows = spark.range(60).selectExpr("CAST(id AS string) AS subject_id", "array(CAST(id % 3 AS double), CAST(id % 2 AS double) / 9) AS fingerprint")
    found = evaluation.clusters(rows, 3, starts=2).selectExpr("cast(subject_id AS int) % 3 AS k", "cluster").distinct()
    assert seen == [False, False] and found.count() == 3
