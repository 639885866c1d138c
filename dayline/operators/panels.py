"""What figures show, as DataFrames: mean and modes over scales, offsets, trajectories, fitted curves, spectra, amplitude and phase."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.dataset import CurveSet
from dayline.functions.curves import linear_axis, literal
from dayline.operators.estimators import Basis, SpectralModel
from dayline.operators.two_level import TwoLevelModel

# Modes, bins, subjects and hours that are shown.
SHOWN, BINS, TRAJECTORIES = 3, 15, 10
SHOWN_HOURS = (0, 4, 8, 12, 16, 20)


def mean_panel(data: CurveSet) -> DataFrame:
    """scale and mean."""
    axis = literal(linear_axis(data.scales))
    return data.mean_curve().select(axis[F.col("j")].alias("scale"), "mean")


def shape_panel(spark: SparkSession, basis: Basis, scales: list[float]) -> DataFrame:
    """m, scale, phi and eigenvalue of the first modes."""
    axis = linear_axis(scales)
    rows = [(m, axis[j], float(phi), float(basis.variances[m])) for m, mode in enumerate(basis.modes[:SHOWN]) for j, phi in enumerate(mode)]
    return spark.createDataFrame(rows, "m int, scale double, phi double, eigenvalue double")


def level_panel(spark: SparkSession, model: TwoLevelModel, scales: list[float]) -> DataFrame:
    """level (1 between subjects, 2 within), scale and value of each level's first component."""
    axis = linear_axis(scales)
    rows = [(level, axis[j], float(v)) for level, modes in ((1, model.between), (2, model.within)) for first in modes[:1] for j, v in enumerate(first)]
    return spark.createDataFrame(rows, "level int, scale double, value double")


def offset_histogram(fingerprints: DataFrame, modes: int, bins: int = BINS) -> DataFrame:
    """m, bin, low, high and n: offsets of the first modes in equal bins from least to largest, which belongs to the last bin; empty bins have 0."""
    shown = min(modes, SHOWN)
    values = fingerprints.select(F.posexplode(F.slice("fingerprint", 1, shown)).alias("m", "x"))
    spans = values.groupBy("m").agg(F.min("x").alias("least"), F.max("x").alias("most"))
    # as many bins around a single value as between two
    wide = spans.select("m", F.when(F.col("least") == F.col("most"), F.col("least") - 0.5).otherwise(F.col("least")).alias("from"), F.when(F.col("least") == F.col("most"), F.col("most") + 0.5).otherwise(F.col("most")).alias("to"))
    placed = values.join(F.broadcast(wide), "m").select("m", F.least(F.floor((F.col("x") - F.col("from")) * bins / (F.col("to") - F.col("from"))), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.groupBy("m", "bin").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("to") - F.col("from")) / bins
    cells = wide.select("m", "from", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return cells.join(counts, ["m", "bin"], "left").select("m", "bin", (F.col("from") + F.col("bin") * F.col("width")).alias("low"), (F.col("from") + (F.col("bin") + 1) * F.col("width")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def first_subjects(data: CurveSet, n: int) -> CurveSet:
    """The first subjects by id: a top-n of their ids, joined as a broadcast of n rows."""
    return CurveSet(data.observations.join(F.broadcast(data.subject_ids().orderBy("subject_id").limit(n)), "subject_id", "left_semi"), data.scales)


def trajectories(data: CurveSet, basis: Basis, subjects: int = TRAJECTORIES) -> DataFrame:
    """subject_id, hour and score: the first subjects' plain projections on the first mode."""
    plain = Basis(basis.mean, basis.modes[:1], basis.variances[:1], np.ones(len(basis.mean)), basis.all_variances)
    return first_subjects(data, subjects).observations.select("subject_id", "hour", plain.scores()[0].alias("score"))


def fitted_panel(data: CurveSet, rebuilt: DataFrame, hours: tuple[int, ...] = SHOWN_HOURS) -> DataFrame:
    """hour, scale, observed and fitted of the first subject, at the hours shown. rebuilt: subject_id, hour, curve."""
    one = first_subjects(data, 1).observations.where(F.col("hour").isin(*hours))
    both = one.join(rebuilt.select("subject_id", "hour", F.col("curve").alias("fitted")), ["subject_id", "hour"])
    return both.select("hour", F.explode(F.arrays_zip(literal(linear_axis(data.scales)).alias("scale"), F.col("curve").alias("observed"), F.col("fitted").alias("fitted"))).alias("p")).select(
        "hour", F.col("p")["scale"].alias("scale"), F.col("p")["observed"].alias("observed"), F.col("p")["fitted"].alias("fitted")
    )


def spectral_panel(spark: SparkSession, model: SpectralModel, harmonic: int = 1) -> DataFrame:
    """m (from 1), re and im of the first spectral mode of a harmonic."""
    return spark.createDataFrame([(m + 1, float(u.real), float(u.imag)) for m, u in enumerate(model.vectors[harmonic - 1][0])], "m int, re double, im double")


def amplitude_phase(fingerprints: DataFrame, modes: int, harmonic: int = 1, mode: int = 0) -> DataFrame:
    """subject_id, amp and phase of a harmonic along a spectral mode, by their places in the fingerprint."""
    at = modes + 2 * modes * (harmonic - 1) + mode
    return fingerprints.select("subject_id", F.col("fingerprint")[at].alias("amp"), F.col("fingerprint")[at + modes].alias("phase"))
