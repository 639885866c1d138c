"""The experiment over files: for each window an encoder from all cohorts, and for each hour a regressor held against rows left out."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.operators import convolution
from dayline.operators.training import Schedule
from dayline.sources import models, tables

log = logging.getLogger(__name__)


def supervised_hour(spark: SparkSession, root: str, cohort: str, window: int, hour: int, scales: list[float], target: str) -> DataFrame:
    """subject_id, hour, a, b and target of one hour of a cohort at the given scales; no rows if a file is missing or rows are too few."""
    people = tables.covariates(spark, tables.covariate_path(root, cohort, window))
    both = []
    for feature in tables.CURVES:
        rows, own = tables.wide_curves(spark, tables.curve_path(root, cohort, feature, window, hour), hour, people)
        if missing := [s for s in scales if s not in own]:
            raise ValueError(f"hour {hour} of {cohort} lacks the scales {missing}")
        both.append(tables.at_scales(rows, own, scales))
    return tables.supervised(people, *both, target).withColumn("hour", F.lit(hour))


def run(
    spark: SparkSession, root: str, out: str, windows: tuple[int, ...] = tables.WINDOWS, hours: tuple[int, ...] = tables.TASK_HOURS, cohort: str = "986", target: str = "BNP",
    folds: int = 5, repeats: int = 10, pretraining: Schedule = convolution.PRETRAINING, tuning: Schedule = convolution.TUNING,
) -> DataFrame:
    """window, hour, metric, mean and deviation over folds. Encoders, figures of each fold and importance panels are written under ``out``.

    Inputs are standardised by the statistics of all cohorts. A window without curves, and an hour without files or with too few rows, is logged and left out.
    """
    found = []
    for window in windows:
        curves, scales = tables.cohort_channels(spark, root, window)
        if not scales:
            log.warning("window %d is left out: no curves", window)
            continue
        auto = convolution.fit_conv_autoencoder(tables.standardised(curves), pretraining)
        models.saved(auto, spark, f"{out}/{cohort}/deep_learning_results/{window}/models/autoencoder")
        for hour in hours:
            try:
                rows = supervised_hour(spark, root, cohort, window, hour, scales, target)
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                log.warning("window %d, hour %d is left out: no file", window, hour)
                continue
            if rows.isEmpty():
                log.warning("window %d, hour %d is left out: too few rows", window, hour)
                continue
            figures, said = convolution.cross_validated(tables.standardised(rows, of=curves), auto, folds, repeats, tuning)
            tables.written_folds(figures, out, cohort, window, hour)
            panel = convolution.importance_panel(rows, said, scales)
            tables.written_csv(panel.coalesce(1), f"{out}/{cohort}/deep_learning_results/{window}/figures/importance_hour_{hour}.csv")  # a row for each scale
            long = figures.selectExpr("stack(4, 'mse', mse, 'r2', r2, 'pearson_r', pearson_r, 'spearman_rho', spearman_rho) AS (metric, value)")
            stats = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
            found += [(window, hour, *r) for r in stats.orderBy("metric").collect()]
    return spark.createDataFrame(found, "window int, hour int, metric string, mean double, deviation double")
