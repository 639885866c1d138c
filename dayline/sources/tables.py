"""Curve tables from files and from tables of the usual shapes; sinks.

A wide CSV of curves has a subject column and one column for each scale; one file holds one hour.
"""

from __future__ import annotations

import csv
import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayline import schema
from dayline.functions.curves import morphology, total

log = logging.getLogger(__name__)

MIN_HOURS = 4
ADULT = 18
#: Rows under which paired data of one hour are too few to learn from.
LEAST_PAIRED = 10
# Figures and their columns in the summary file.
SUMMARY = {"reconstruction_mse": "Reconstruction_MSE", "accuracy": "Classification_Acc", "auc": "Classification_AUC", "silhouette": "Silhouette_Score", "adjusted_rand": "Adjusted_Rand_Index"}
# Cohorts, windows in hours, curve features, and hours of the supervised task.
COHORTS = ("986", "108", "Healthy")
WINDOWS = (1, 2, 4, 6)
CURVES = ("lmds", "alphas")
TASK_HOURS = (0, 4, 8, 12, 16, 20)


def covariate_path(root: str, cohort: str, window: int) -> str:
    return f"{root}/{cohort}/covariates_{window}h.csv"


def curve_path(root: str, cohort: str, feature: str, window: int, hour: int) -> str:
    return f"{root}/{cohort}/{feature}_{window}h_{hour}.csv"


def curve_paths(root: str, cohort: str, feature: str, window: int) -> dict[int, str]:
    return {hour: curve_path(root, cohort, feature, window, hour) for hour in range(schema.HOURS)}


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """cohort, window, feature, hour and path of every file that the layout has: curves by hour, covariates with no hour."""
    rows = [(c, w, f, h, curve_path(root, c, f, w, h)) for c in COHORTS for w in WINDOWS for f in CURVES for h in range(schema.HOURS)]
    rows += [(c, w, "covariates", None, covariate_path(root, c, w)) for c in COHORTS for w in WINDOWS]
    return spark.createDataFrame(rows, "cohort string, window int, feature string, hour int, path string")


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file: only its first line is read. A missing file raises AnalysisException."""
    first = spark.read.text(path).first()
    return [] if first is None else next(csv.reader([first[0]]))


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, in one scan; readers cast what they need."""
    names = header(spark, path)
    if not names:
        return spark.createDataFrame([], "subject_id string")
    types = T.StructType([T.StructField(n or "subject_id", T.StringType()) for n in names])
    return spark.read.csv(path, header=True, schema=types, mode="FAILFAST", enforceSchema=True)


def number(name: str) -> Column:
    """A column of numbers; what is no number is missing."""
    return F.nanvl(F.expr(f"try_cast(`{name}` AS DOUBLE)"), F.lit(None))


def covariates(spark: SparkSession, path: str, age: str = "age") -> DataFrame:
    """Rows of adults; the first column is the key, as a string ``subject_id``; columns of numbers come as doubles."""
    raw = raw_csv(spark, path)
    key, *names = raw.columns
    seen = raw.agg(*(F.max(F.col(f"`{n}`").isNotNull() & (F.trim(f"`{n}`") != "") & F.expr(f"try_cast(`{n}` AS DOUBLE)").isNull()).alias(f"t{i}") for i, n in enumerate(names))).first()
    typed = [F.col(f"`{n}`").alias(n) if seen[f"t{i}"] else number(n).alias(n) for i, n in enumerate(names)]
    return adults(raw.select(F.col(f"`{key}`").alias("subject_id"), *typed), age)


def adults(rows: DataFrame, age: str = "age", least: float = ADULT) -> DataFrame:
    return rows.where(F.nanvl(F.col(age).cast("double"), F.lit(None)) >= least)


def wide_curves(spark: SparkSession, path: str, hour: int, subjects: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """Observations of one file and its scales. Columns with a missing value in any row are left out; of rows, those without a subject in ``subjects``."""
    raw = raw_csv(spark, path)
    key, *names = raw.columns
    whole = raw.agg(F.count(F.lit(1)).alias("rows"), *(F.count(number(n)).alias(f"c{i}") for i, n in enumerate(names))).first()
    kept = sorted((n for i, n in enumerate(names) if whole["rows"] and whole[f"c{i}"] == whole["rows"]), key=float)
    curve = F.array(*map(number, kept)) if kept else F.array().cast("array<double>")
    rows = raw.select(F.col(f"`{key}`").alias("subject_id"), F.lit(hour).alias("hour"), curve.alias("curve"))
    if subjects is not None:
        rows = rows.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    return rows, [float(n) for n in kept]


def hourly_curves(spark: SparkSession, paths: dict[int, str], min_hours: int = MIN_HOURS, subjects: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """All hours that have a file with curves, subjects with too few hours left out; raises if none remain.

    A missing file is an hour without rows, and is logged; any other fault raises. Scales are those that all files have.
    """
    parts, scales, skipped = [], None, []
    for hour, path in sorted(paths.items()):
        try:
            part, own = wide_curves(spark, path, hour, subjects)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            log.warning("hour %d is left out: no file %s", hour, path)
            skipped.append(hour)
            continue
        if not own:
            log.warning("hour %d is left out: no column of %s is whole", hour, path)
            skipped.append(hour)
            continue
        if scales is not None and own != scales:
            both = [s for s in scales if s in own]
            parts = [at_scales(p, scales, both) for p in parts]
            part, scales = at_scales(part, own, both), both
        scales = scales or own
        parts.append(part)
    if not parts:
        raise ValueError(f"no curves; hours without any: {skipped}")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = enough_hours(some_value(rows), min_hours)
    if rows.isEmpty():
        raise ValueError(f"no subject has {min_hours} hours")
    return rows, scales


def features(curves: DataFrame, scales: list[float], subjects: DataFrame) -> DataFrame:
    """Shape features of every hour beside the covariates of the same subject and hour, of subjects with all 24 hours.

    Both sides grow with the subjects, and what explodes is taken for small by its file: joins are by sorted rows, never by a copy on the driver.
    """
    rows = complete_days(curves.join(subjects.select("subject_id").distinct().hint("merge"), "subject_id", "left_semi"))
    found = rows.select("subject_id", "hour", *(c.alias(n) for n, c in morphology(F.col("curve"), scales).items()))
    return subjects.hint("merge").join(found, ["subject_id", "hour"])


def supervised(rows: DataFrame, first: DataFrame, second: DataFrame, target: str, least: int = LEAST_PAIRED) -> DataFrame:
    """subject_id, a, b and log10 of the target: of one hour, the two curves of subjects with a positive target, their first by hour.

    No rows come back if fewer than ``least`` have a target, have both curves too, or have no missing value in them.
    """
    value = F.nanvl(F.col(target).cast("double"), F.lit(None))
    targets = rows.where(value.isNotNull()).groupBy("subject_id").agg(F.min_by(value, "hour").alias("y")).where("y > 0")
    both = first.select("subject_id", F.col("curve").alias("a")).join(second.select("subject_id", F.col("curve").alias("b")), "subject_id").join(targets, "subject_id")
    valid = both.where(whole("a") & whole("b"))
    counts = targets.agg(F.count(F.lit(1)).alias("n0")).join(both.agg(F.count(F.lit(1)).alias("n1"))).join(valid.agg(F.count(F.lit(1)).alias("n2")))  # one row each
    gate = counts.where((F.col("n0") >= least) & (F.col("n1") >= least) & (F.col("n2") >= least)).select(F.lit(True).alias("enough"))
    return valid.crossJoin(F.broadcast(gate)).select("subject_id", "a", "b", F.log10("y").alias("target"))


def samples(first: DataFrame, second: DataFrame | None = None, targets: DataFrame | None = None, target: str = "BNP") -> DataFrame:
    """subject_id, hour, one or two channels standardised over all their values, missing values 0, and log10 of the target where there is one."""
    rows, names = first.select("subject_id", "hour", F.col("curve").alias("a")), ("a",)
    if second is not None:
        rows, names = rows.join(second.select("subject_id", "hour", F.col("curve").alias("b")), ["subject_id", "hour"]), ("a", "b")
    if targets is not None:
        known = targets.select("subject_id", F.nanvl(F.col(target).cast("double"), F.lit(None)).alias("y")).where("y IS NOT NULL")
        rows = rows.join(known, "subject_id").select("subject_id", "hour", *names, F.log10("y").alias("target"))
    return standardised(rows, names)


def transformed(rows: DataFrame, columns: tuple[str, ...], change: Callable[[np.ndarray, np.random.Generator], np.ndarray], seed: int = 0) -> DataFrame:
    """rows with change(x, rng) in place of the channels x (channel, scale) of each; a row's generator hangs on its key and the seed only."""
    types = ", ".join(f"{n} array<double>" for n in columns)
    keyed = rows.withColumn("seed", F.xxhash64("subject_id", "hour", F.lit(seed)))
    other = [c for c in rows.columns if c not in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {c: batch[c] for c in other}
            made = [change(np.array([batch[c].iloc[i] for c in columns], float), np.random.default_rng(int(s) & (2**63 - 1))) for i, s in enumerate(batch["seed"])]
            yield pd.DataFrame(out | {c: [m[k] for m in made] for k, c in enumerate(columns)}, index=batch.index)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in other)
    return keyed.mapInPandas(run, f"{kept}, {types}").select(*rows.columns)


def at_scales(rows: DataFrame, scales: list[float], kept: list[float]) -> DataFrame:
    return rows.withColumn("curve", F.array(*(F.col("curve")[scales.index(s)] for s in kept)))


def some_value(rows: DataFrame) -> DataFrame:
    """Without curves that are missing at every scale."""
    return rows.where(F.exists("curve", lambda x: x.isNotNull() & ~F.isnan(x)))


def enough_hours(rows: DataFrame, least: int = MIN_HOURS) -> DataFrame:
    """Observations of subjects with at least so many hours."""
    n = F.count(F.lit(1)).over(Window.partitionBy("subject_id"))
    return rows.withColumn("n_", n).where(F.col("n_") >= least).drop("n_")


def complete_days(rows: DataFrame) -> DataFrame:
    """Observations of subjects present in all 24 hours."""
    whole = rows.groupBy("subject_id").agg(F.countDistinct("hour").alias("n")).where("n = 24").select("subject_id")
    return rows.join(whole.hint("merge"), "subject_id", "left_semi")


def channels(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two curves at one subject and hour: the inner intersection, without rows that miss a value."""
    both = first.select("subject_id", "hour", F.col("curve").alias("a")).join(second.select("subject_id", "hour", F.col("curve").alias("b")), ["subject_id", "hour"])
    return both.where(whole("a") & whole("b"))


def cohort_channels(spark: SparkSession, root: str, window: int, cohorts: tuple[str, ...] = COHORTS, hours: tuple[int, ...] = tuple(range(schema.HOURS))) -> tuple[DataFrame, list[float]]:
    """cohort, subject_id, hour, a and b of all cohorts and hours that have files of both curves, and the scales that all share.

    ``subject_id`` begins with the cohort, since cohorts number their subjects alike. A cohort without curves is logged; without any, there are no rows.
    """
    parts: list[tuple[DataFrame, list[float]]] = []
    for cohort in cohorts:
        try:
            both = [hourly_curves(spark, {h: curve_path(root, cohort, f, window, h) for h in hours}, 1) for f in CURVES]
        except ValueError as e:
            log.warning("cohort %s is left out: %s", cohort, e)
            continue
        scales = [s for s in both[0][1] if s in both[1][1]]
        rows = channels(*(at_scales(r, own, scales) for r, own in both))
        parts.append((rows.select(F.lit(cohort).alias("cohort"), F.concat(F.lit(f"{cohort}/"), "subject_id").alias("subject_id"), "hour", "a", "b"), scales))
    if not parts:
        return spark.createDataFrame([], "cohort string, subject_id string, hour int, a array<double>, b array<double>"), []
    common = [s for s in parts[0][1] if all(s in own for _, own in parts)]
    out = None
    for rows, own in parts:
        cut = rows.withColumns({c: F.array(*(F.col(c)[own.index(s)] for s in common)) for c in ("a", "b")})
        out = cut if out is None else out.unionByName(cut)
    return out, common


def whole(curve: str) -> Column:
    return F.forall(curve, lambda x: x.isNotNull() & ~F.isnan(x))


def standardised(rows: DataFrame, columns: tuple[str, ...] = ("a", "b"), eps: float = 1e-6, of: DataFrame | None = None) -> DataFrame:
    """Each channel less its mean over all values that are there, over their standard deviation; missing values are 0.

    One row of statistics is joined, taken from the rows ``of`` if given.
    """
    there = {c: F.filter(F.transform(c, lambda x: F.nanvl(x, F.lit(None))), lambda x: x.isNotNull()) for c in columns}
    stats = [s for c, v in there.items() for s in (F.sum(total(v)).alias(f"s_{c}"), F.sum(total(F.transform(v, lambda x: x * x))).alias(f"q_{c}"), F.sum(F.size(v)).alias(f"n_{c}"))]
    joined = rows.crossJoin(F.broadcast((rows if of is None else of).agg(*stats)))

    def scaled(c: str) -> Column:
        mean = F.col(f"s_{c}") / F.col(f"n_{c}")
        deviation = F.sqrt(F.greatest(F.col(f"q_{c}") / F.col(f"n_{c}") - mean * mean, F.lit(0.0)))
        return F.transform(c, lambda x: F.coalesce((F.nanvl(x, F.lit(None)) - mean) / (deviation + eps), F.lit(0.0)))

    return joined.withColumns({c: scaled(c) for c in columns}).select(*rows.columns)


def written_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """A row for each estimator with a column for each figure, from estimator, metric and value; a failed estimator has none."""
    return rows.groupBy("estimator").pivot("metric", list(SUMMARY)).agg(F.first("value")).select("estimator", *(F.col(k).alias(v) for k, v in SUMMARY.items())).orderBy("estimator")


def written_benchmark(rows: DataFrame, root: str, cohort: str, window: int, feature: str) -> str:
    path = f"{root}/{cohort}/benchmark/{window}/{feature}_benchmark_summary.csv"
    written_csv(benchmark_summary(rows).coalesce(1), path)
    return path


def written_folds(rows: DataFrame, root: str, cohort: str, window: int, hour: int) -> str:
    """Figures of each fold: rep_fold, mse, r2, pearson_r, spearman_rho."""
    path = f"{root}/{cohort}/deep_learning_results/{window}/metrics/cv_metrics_hour_{hour}.csv"
    written_csv(rows.select("rep_fold", "mse", "r2", "pearson_r", "spearman_rho").coalesce(1), path)
    return path


# Stand-ins made from the tables of the test data.

EVENT_SCALES = [0.0, 1.0, 2.0, 4.0, 8.0]
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def event_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve over event types for each user and hour of day: sums of value, zero where there was none."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sums = [F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("value"))), F.lit(0.0)).cast("double") for t in EVENT_TYPES]
    return events.groupBy(F.col("user_id").cast("string").alias("subject_id"), F.hour("ts").alias("hour")).agg(F.array(*sums).alias("curve"))


def embedding_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-point curves: 24 vectors are the day of a subject."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(
        F.expr("vec_id div 24").cast("string").alias("subject_id"), (F.col("vec_id") % 24).cast("int").alias("hour"), F.transform("embedding", lambda x: x.cast("double")).alias("curve")
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariates of users: stand-ins for age, a positive target and two labels."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(
        F.col("c_custkey").cast("string").alias("subject_id"), F.col("c_nationkey").cast("double").alias("age"), F.col("c_acctbal").cast("double").alias("bnp"), F.col("c_mktsegment").alias("segment"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("state")
    )
