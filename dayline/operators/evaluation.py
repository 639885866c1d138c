"""How well fingerprints and reconstructions do: errors, regression, classification, clustering, and a table of estimators.

Fingerprints are DataFrames of subject_id and fingerprint (array). Folds come from a hash of subject_id, so that a subject's fold is
the same in every job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.dataset import CurveSet
from dayline.functions.curves import total
from dayline.operators import logistic, training
from dayline.operators.partial import summed
from dayline.operators.selection import stratified_folds

#: Points of a block in the pairwise distances of a silhouette, and points of both blocks that meet at once: their distances stay in a core's cache.
BLOCK, CHUNK, ACROSS = 8000, 250, 500
#: Rows whose components agree to so many digits of the largest value of each are one point of a silhouette.
DIGITS = 13
#: Rows of a partition of what is read many times.
FILLED = 20000


def fold(folds: int, seed: int = 42, repeat: int = 0) -> Column:
    """0 to folds - 1, from subject_id."""
    return F.pmod(F.xxhash64("subject_id", F.lit(seed), F.lit(repeat)), F.lit(folds)).cast("int")


def matched(fingerprints: DataFrame, features: DataFrame, target: str, order: str | None = None) -> DataFrame:
    """subject_id, fingerprint and target of subjects that have one; a subject's first row by ``order`` (the target if none) counts."""
    rows = features.select(F.col("subject_id").cast("string").alias("subject_id"), F.col(target).cast("double").alias("target"), F.col(order or target).alias("_order"))
    first = rows.groupBy("subject_id").agg(F.min_by("target", "_order").alias("target")).where("target IS NOT NULL AND NOT isnan(target)")
    return fingerprints.select("subject_id", "fingerprint").join(first, "subject_id")


def curve_errors(data: CurveSet, rebuilt: DataFrame) -> DataFrame:
    """subject_id and mse over the observed curves."""
    both = data.observations.select("subject_id", "hour", "curve").join(rebuilt.select("subject_id", "hour", F.col("curve").alias("fitted")), ["subject_id", "hour"])
    error = total(F.zip_with("curve", "fitted", lambda a, b: (a - b) * (a - b))) / F.size("curve")
    return both.groupBy("subject_id").agg(F.avg(error).alias("mse"))


def reconstruction_mse(data: CurveSet, rebuilt: DataFrame) -> DataFrame:
    """One row: mse, every subject counting alike."""
    return curve_errors(data, rebuilt).agg(F.avg("mse").alias("mse"))


def ridge_r2(rows: DataFrame, alpha: float = 1.0, folds: int = 3, seed: int = 42, placed: DataFrame | None = None) -> list[float]:
    """R squared of each fold, from sums of products by fold: one job. rows: subject_id, fingerprint, target.

    placed: subject_id and fold, where folds are not hashed. A fold whose figure is not finite raises.
    """
    width = rows.select(F.size("fingerprint").alias("n")).first()
    if width is None:
        raise ValueError("no subject has a target")
    size = width.n + 2

    def part(batch: pd.DataFrame) -> np.ndarray:
        out = np.zeros((folds, size, size))
        x = np.column_stack([np.ones(len(batch)), np.stack(batch["fingerprint"].to_numpy()), batch["target"].to_numpy(float)])
        for k in range(folds):
            z = x[batch["fold"].to_numpy() == k]
            out[k] = z.T @ z
        return out.ravel()

    at = rows.withColumn("fold", fold(folds, seed)) if placed is None else rows.join(placed, "subject_id")
    each = summed(at.select("fingerprint", "target", "fold"), part, folds * size * size).reshape(folds, size, size)
    found = []
    for test in each:
        train = each.sum(axis=0) - test
        n, mean = train[0, 0], train[0, 1:] / max(train[0, 0], 1)
        c = train[1:, 1:] - n * np.outer(mean, mean)
        b = np.linalg.solve(c[:-1, :-1] + alpha * np.eye(size - 2), c[:-1, -1])
        line = np.concatenate([[-(mean[-1] - mean[:-1] @ b)], -b, [1.0]])  # target minus prediction
        around = test[-1, -1] - test[0, -1] ** 2 / max(test[0, 0], 1)
        found.append(1 - line @ test @ line / around if around > 0 else float("nan"))
    if not np.isfinite(found).all():
        raise ValueError(f"R squared of a fold is not finite: {found}")
    return found


def logistic_scores(rows: DataFrame, folds: int = 3, seed: int = 42, strength: float = 1.0, placed: DataFrame | None = None) -> DataFrame:
    """subject_id, target, probability (array by class), prediction and fold, each subject scored by the model of the other folds.

    The penalty is half the squared coefficients against ``strength`` times the summed loss. placed: subject_id and fold, where folds are not
    hashed (selection.stratified_folds, for classes alike in all folds).
    """
    at = rows.withColumn("fold", fold(folds, seed)) if placed is None else rows.join(placed.select("subject_id", "fold"), "subject_id")
    at = at.select("subject_id", F.col("target").cast("double").alias("target"), "fingerprint", F.col("fold").cast("int").alias("fold")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return logistic.fold_scores(at, folds, strength)
    finally:
        at.unpersist()


def auc(scored: DataFrame, score: Column, label: Column) -> float:
    """Area under the curve of a 0/1 label; not a number with one class only."""
    rows = scored.select(score.cast("double").alias("s"), label.cast("double").alias("l"))
    if rows.select("l").distinct().count() < 2:
        return float("nan")
    return BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="l", metricName="areaUnderROC", numBins=0).evaluate(rows)


def classification(scored: DataFrame) -> dict[str, float]:
    """Accuracy, and the mean over classes of the area of each against the rest. Classes are 0 to C - 1."""
    rows = scored.select("target", "prediction", "probability").persist(StorageLevel.MEMORY_AND_DISK)
    kept = [rows]
    try:
        classes = sorted(int(r[0]) for r in rows.select("target").distinct().collect())
        asked = F.explode(F.array(*map(F.lit, classes if len(classes) > 2 else [1])))
        each = rows.select("target", "probability", asked.alias("c")).select("c", F.get("probability", "c").alias("s"), (F.col("target") == F.col("c")).alias("hit"))
        ranked, dealt = grouped_ranks(each, "c", "s")
        kept.append(dealt)
        sums = each.join(ranked, ["c", "s"]).groupBy("c").agg(F.sum(F.when(F.col("hit"), F.col("rank_s"))).alias("r"), F.count_if("hit").alias("n"), F.count_if(~F.col("hit")).alias("m"))
        areas = [(x["r"] - x["n"] * (x["n"] + 1) / 2) / (x["n"] * x["m"]) if x["n"] and x["m"] else float("nan") for x in sums.collect()]
        right = rows.agg(F.avg((F.col("prediction") == F.col("target")).cast("double"))).first()[0]
    finally:
        for df in kept:
            df.unpersist()
    return {"accuracy": right, "auc": float(np.mean(areas)) if areas else float("nan")}


def confusion(rows: DataFrame) -> DataFrame:
    """target, prediction, n, and share, their part of the rows with that target."""
    counts = rows.groupBy("target", "prediction").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("target")))


def clusters(fingerprints: DataFrame, k: int, starts: int = 10, seed: int = 42) -> DataFrame:
    """subject_id, fingerprint and cluster: the best of several starts by within-cluster squares."""
    kept = fingerprints.select("subject_id", "fingerprint").persist(StorageLevel.MEMORY_AND_DISK)
    rows = kept.withColumn("features", array_to_vector("fingerprint"))  # not kept: a fit lays out what is not kept, and unpacks kept vectors in each step
    try:
        with ThreadPoolExecutor(starts) as pool:  # the starts' small jobs side by side
            models = list(pool.map(lambda i: KMeans(k=k, seed=seed + i).fit(rows), range(starts)))
        best = min(models, key=lambda m: m.summary.trainingCost)
    finally:
        kept.unpersist()
    return best.transform(rows).select("subject_id", "fingerprint", F.col("prediction").alias("cluster"))


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows by one product; where that would lose digits, of rows close together, from their differences."""
    middle = y.mean(axis=0)
    u, v = x - middle, y - middle
    size = (u * u).sum(axis=1)[:, None] + (v * v).sum(axis=1)
    squares = (-2 * u) @ v.T
    squares += size
    size *= 1e-4
    there = squares > size
    if not there.all():
        i, j = np.nonzero(~there)
        for k in range(0, len(i), 1 << 16):
            some = slice(k, k + (1 << 16))
            squares[i[some], j[some]] = ((x[i[some]] - y[j[some]]) ** 2).sum(axis=1)
    return np.sqrt(squares, out=squares)


def points(rows: DataFrame) -> DataFrame:
    """point (the smallest subject_id), fingerprint, cluster and w: rows of a cluster that are equal but for rounding are one point of that weight."""
    largest = rows.select(F.posexplode("fingerprint").alias("j", "x")).groupBy("j").agg(F.max(F.abs("x")).alias("x")).orderBy("j").collect()  # a row for each component
    digits = [DIGITS - 1 - math.floor(math.log10(r["x"])) if r["x"] and math.isfinite(r["x"]) else None for r in largest]
    parts = [F.get("fingerprint", F.lit(j)) for j in range(len(digits))]
    key = F.array(*(x if d is None else F.round(x, d) for x, d in zip(parts, digits, strict=True))) if parts else F.col("fingerprint")
    least = F.min(F.struct("subject_id", "fingerprint")).alias("least")
    found = rows.groupBy("cluster", key.alias("key")).agg(least, F.count(F.lit(1)).cast("double").alias("w"))
    return found.select(F.col("least.subject_id").alias("point"), "least.fingerprint", "cluster", "w")


def silhouette(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row: the mean Euclidean silhouette of subject_id, fingerprint, cluster.

    All distances between points are needed, so points are cut into hashed blocks and each two blocks meet once, in one group, which returns sums
    by point and cluster for both and never pairs. Equal rows of a cluster are one point with their number as its weight; a row alone in its cluster counts 0.
    """
    found = points(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        value = silhouette_of(found, max(1, -(-found.count() // block)))
        return rows.sparkSession.createDataFrame([(value,)], "silhouette double")
    finally:
        found.unpersist()


def weights_by_cluster(points: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The clusters, and of each point its weight in the column of its own."""
    names, code = np.unique(points["cluster"].to_numpy(), return_inverse=True)
    return names, np.eye(len(names))[code] * points["w"].to_numpy()[:, None]


def silhouette_of(found: DataFrame, parts: int) -> float | None:
    """The silhouette of points dealt to so many blocks."""
    own, met = F.col("own"), F.col("met")
    at = found.select("point", "fingerprint", "cluster", "w", F.pmod(F.xxhash64("point", F.lit(7)), F.lit(parts)).cast("int").alias("own"))
    at = at.withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumns({"p": F.least(own, met), "q": F.greatest(own, met)}).drop("met")
    # two blocks that meet have a partition to themselves, up to MOST: hashes of so few keys would put several into one task
    places = min(training.MOST, parts * (parts + 1) // 2)
    at = at.withColumn("place", F.pmod(F.expr("q * (q + 1) div 2 + p"), F.lit(places)).cast("int")).repartitionById(places, F.col("place"))

    def distances(group: pd.DataFrame) -> pd.DataFrame:
        both = group["p"].iloc[0] != group["q"].iloc[0]
        a, b = (group[group["own"] == group[c].iloc[0]] for c in "pq")
        if not len(a) or not len(b):
            return pd.DataFrame({"point": [], "other": [], "d": []})
        (x, own_names, to), (y, names, back) = ((np.stack(t["fingerprint"].to_numpy()), *weights_by_cluster(t)) for t in (a, b))
        sums, others = np.zeros((len(x), len(names))), np.zeros((len(y), len(own_names)))
        for i in range(0, len(x), CHUNK):
            some = slice(i, i + CHUNK)
            for j in range(0, len(y), ACROSS):
                there = slice(j, j + ACROSS)
                away = apart(x[some], y[there])
                sums[some] += away @ back[there]
                if both:
                    others[there] += away.T @ to[some]
        out = [pd.DataFrame({"point": np.repeat(a["point"].to_numpy(), len(names)), "other": np.tile(names, len(a)), "d": sums.ravel()})]
        if both:
            out.append(pd.DataFrame({"point": np.repeat(b["point"].to_numpy(), len(own_names)), "other": np.tile(own_names, len(b)), "d": others.ravel()}))
        return pd.concat(out)

    sums = at.groupBy("place", "p", "q").applyInPandas(distances, "point string, other int, d double")
    sums = sums.groupBy("point", "other").agg(F.sum("d").alias("d"))
    sizes = found.groupBy(F.col("cluster").alias("other")).agg(F.sum("w").alias("n"))
    each = sums.join(found.select("point", "cluster", "w"), "point").join(sizes, "other")
    inside = F.max(F.when(F.col("other") == F.col("cluster"), F.when(F.col("n") > 1, F.col("d") / (F.col("n") - 1))))
    outside = F.min(F.when(F.col("other") != F.col("cluster"), F.col("d") / F.col("n")))
    s = each.groupBy("point").agg(inside.alias("a"), outside.alias("b"), F.first("w").alias("w"))
    value = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    return s.agg((F.sum(F.col("w") * value) / F.sum("w")).alias("silhouette")).first()[0]


def adjusted_rand(rows: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """One row: the adjusted Rand index of two labellings; 1 where both put all rows together or all apart."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    table = rows.groupBy(F.col(label).alias("l"), F.col(cluster).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    both = table.agg(pairs("n").alias("both"), F.sum("n").alias("rows"))
    by = [table.groupBy(k).agg(F.sum("n").alias("n")).agg(pairs("n").alias(f"in_{k}")) for k in "lc"]
    one = both.join(by[0]).join(by[1])  # three tables of one row
    expected = F.col("in_l") * F.col("in_c") / (F.col("rows") * (F.col("rows") - 1) / 2)
    most = (F.col("in_l") + F.col("in_c")) / 2
    return one.select(F.coalesce((F.col("both") - expected) / F.nullif(most - expected, F.lit(0.0)), F.lit(1.0)).alias("adjusted_rand"))


def regression(rows: DataFrame, truth: str = "target", predicted: str = "prediction") -> dict[str, float]:
    """mse, mae, r2, Pearson's and Spearman's correlation; ties share their mean rank. Equal pairs are counted before anything is ranked."""
    t, p = F.col(truth), F.col(predicted)
    r = rows.agg(F.avg((t - p) ** 2).alias("mse"), F.avg(F.abs(t - p)).alias("mae"), F.var_pop(t).alias("v"), F.corr(t, p).alias("pearson")).first()
    pairs = rows.groupBy(t.alias("t"), p.alias("p")).agg(F.count(F.lit(1)).alias("n")).where("t IS NOT NULL AND p IS NOT NULL").withColumn("all", F.lit(0)).persist(StorageLevel.MEMORY_AND_DISK)
    kept = [pairs]
    try:
        both = pairs
        for c in ("t", "p"):
            ranked, dealt = grouped_ranks(pairs, "all", c, "n")
            kept.append(dealt)
            both = both.join(ranked.drop("all"), c)
        # ranks have the mean (n + 1) / 2
        middle = pairs.agg(F.sum("n")).first()[0]
        x, y = (F.col(c) - ((middle or 0) + 1) / 2 for c in ("rank_t", "rank_p"))
        s = both.agg(*(F.sum(F.col("n") * u * v).alias(k) for k, u, v in (("xy", x, y), ("xx", x, x), ("yy", y, y)))).first()
        spearman = s.xy / (s.xx * s.yy) ** 0.5 if s.xx and s.yy else float("nan")
    finally:
        for df in kept:
            df.unpersist()
    return {"mse": r.mse, "mae": r.mae, "r2": 1 - r.mse / r.v if r.v else float("nan"), "pearson": r.pearson, "spearman": spearman}


def grouped_ranks(rows: DataFrame, by: str, value: str, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """by, value and rank, the mean rank of equal values within a group, and the persisted table that they read, for its release.

    Distinct values are dealt by range and counted there, so that a large group is ranked by many tasks. A row counts ``weight`` times.
    """
    counts = rows.groupBy(by, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    dealt = counts.repartitionByRange(by, value).withColumn("part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    start = Window.unboundedPreceding
    sizes = dealt.groupBy(by, "part").agg(F.sum("n").alias("m"))  # a row for each partition and the groups that begin or end there
    before = sizes.select(by, "part", F.coalesce(F.sum("m").over(Window.partitionBy(by).orderBy("part").rowsBetween(start, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part", by).orderBy(value).rowsBetween(start, -1)), F.lit(0))
    ranked = dealt.withColumn("inside", inside).join(before, [by, "part"])
    return ranked.select(by, value, (F.col("before") + F.col("inside") + (F.col("n") + 1) / 2).alias(f"rank_{value}")), dealt


def grouped_regression(rows: DataFrame, by: str) -> DataFrame:
    """by, mse, r2, pearson and spearman of each group, for a bounded number of groups; rows: by, target, prediction. A figure that is not defined is null."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    kept = [rows]
    try:
        t, p = F.col("target"), F.col("prediction")
        plain = rows.groupBy(by).agg(F.avg((t - p) ** 2).alias("mse"), F.var_pop(t).alias("v"), F.corr(t, p).alias("pearson"))
        both = rows
        for c in ("target", "prediction"):
            ranked, dealt = grouped_ranks(rows, by, c)
            kept.append(dealt)
            both = both.join(ranked, [by, c])
        spearman = both.groupBy(by).agg(F.corr("rank_target", "rank_prediction").alias("spearman"))
        r2 = F.when(F.col("v") > 0, 1 - F.col("mse") / F.col("v")).alias("r2")
        out = plain.join(spearman, by).select(by, "mse", r2, *(F.nanvl(c, F.lit(None)).alias(c) for c in ("pearson", "spearman")))
        return rows.sparkSession.createDataFrame(out.collect(), out.schema)
    finally:
        for df in kept:
            df.unpersist()


def summary(metrics: DataFrame) -> DataFrame:
    """metric, mean and sample deviation of rows of metric and value."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))


def evaluated(model, data: CurveSet, labels: DataFrame, folds: int = 5) -> dict[str, float]:
    """The five figures of a fitted model; labels: subject_id and label, 0 to C - 1. Classes are alike in the folds of the classifier."""
    first = matched(model.transform(data), labels, "label").persist(StorageLevel.MEMORY_AND_DISK)
    rows = dealt_by_subject(first).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        k = rows.select("target").distinct().count()
        placed = clusters(rows, k).join(rows.select("subject_id", "target"), "subject_id")
        return {
            "reconstruction_mse": reconstruction_mse(data, model.reconstruct(data)).first()[0],
            **classification(logistic_scores(rows, folds, placed=stratified_folds(rows, "target", folds))),
            "silhouette": silhouette(placed).first()[0],
            "adjusted_rand": adjusted_rand(placed, "target").first()[0],
        }
    finally:
        rows.unpersist()
        first.unpersist()


def dealt_by_subject(rows: DataFrame) -> DataFrame:
    """The rows in as many partitions as they fill: clusters and classifiers run hundreds of jobs over them."""
    return rows.repartition(max(1, -(-rows.count() // FILLED)), "subject_id")


def benchmark(fits: dict[str, Callable[[CurveSet], object]], data: CurveSet, labels: DataFrame, folds: int = 5) -> DataFrame:
    """estimator, metric, value and error: a failing estimator has one row with its error and no figures."""

    # every figure of every estimator reads the curves: they are made once
    made = data.observations.persist(StorageLevel.MEMORY_AND_DISK)
    kept, labels = replace(data, observations=dealt_by_subject(made).persist(StorageLevel.MEMORY_AND_DISK)), labels.persist(StorageLevel.MEMORY_AND_DISK)

    def rows() -> Iterator[tuple]:
        for name, fit in fits.items():
            try:
                yield from ((name, metric, float(value), None) for metric, value in evaluated(fit(kept), kept, labels, folds).items())
            except Exception as e:  # the table says what failed; the others still run
                yield (name, None, None, f"{type(e).__name__}: {e}"[:500])

    try:
        return labels.sparkSession.createDataFrame(list(rows()), "estimator string, metric string, value double, error string")
    finally:
        kept.observations.unpersist()
        made.unpersist()
        labels.unpersist()
