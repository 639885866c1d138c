"""Scores of shape modes in long form (subject_id, hour, m, xi): centring, lags around the clock, and spectra."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayline.schema import HOURS

#: Lags 0 to 12; the rest mirrors. Days that are laid out at once.
HALF, DAYS = 13, 512


def centred(scores: DataFrame) -> DataFrame:
    """scores with ``offset``, the subject's mean of a mode, and ``centred``. Rows are dealt by subject once, also for what packs them later."""
    mean = F.avg("xi").over(Window.partitionBy("subject_id", "m"))
    return scores.repartition("subject_id").withColumn("offset", mean).withColumn("centred", F.col("xi") - mean)


def lag_sums(scores: DataFrame, pooled: bool, diagonal: bool) -> DataFrame:
    """lag (0 to 12), m, n, the sum of products over pairs of a subject's hours, and how many there are, by partition.

    A subject's day is one bounded row. Pooled: every pair counts; otherwise a subject counts once for each lag, with its mean.
    """
    days = scores.groupBy("subject_id").agg(F.collect_list(F.struct("hour", "m", "centred")).alias("day"))
    days = days.select(F.transform("day", lambda x: x["hour"]).alias("hour"), F.transform("day", lambda x: x["m"]).alias("m"), F.transform("day", lambda x: x["centred"]).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = {}, np.zeros(HALF)
        for batch in batches:
            for first in range(0, len(batch), DAYS):
                some = batch.iloc[first : first + DAYS]
                row = np.repeat(np.arange(len(some)), some["hour"].map(len))
                hour, m = np.concatenate(some["hour"].to_list()), np.concatenate(some["m"].to_list())
                x, seen = np.zeros((len(some), HOURS, int(m.max()) + 1)), np.zeros((len(some), HOURS))
                x[row, hour, m] = np.concatenate(some["x"].to_list())
                seen[row, hour] = 1
                for lag in range(HALF):
                    pairs = (seen * np.roll(seen, -lag, axis=1)).sum(axis=1)
                    weight = np.ones(len(some)) if pooled else 1 / np.maximum(pairs, 1)
                    later = np.roll(x, -lag, axis=1)
                    found = np.einsum("i,ihm,ihm->m", weight, x, later) if diagonal else np.tensordot(x * weight[:, None, None], later, axes=([0, 1], [0, 1]))
                    sums[lag] = grown(sums[lag], found) if lag in sums else found
                    counts[lag] += pairs.sum() if pooled else (pairs > 0).sum()
        for lag, found in sums.items():
            at = np.nonzero(np.ones_like(found))
            yield pd.DataFrame({"lag": lag, "m": at[0], "n": at[-1], "s": found[at], "k": counts[lag]})

    return days.mapInPandas(run, "lag int, m int, n int, s double, k double")


def grown(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two square arrays, or vectors, the smaller one filled with zeros."""
    size = max(len(a), len(b))
    return sum(np.pad(x, [(0, size - len(x))] * x.ndim) for x in (a, b))


def mirrored(half: DataFrame) -> DataFrame:
    """Lags 0 to 23 from 0 to 12: the covariance at 24 - d is the transpose of that at d. Each row gives both, so that what it comes from runs once."""
    own = F.struct("lag", "m", "n", "cov")
    other = F.struct((HOURS - F.col("lag")).alias("lag"), F.col("n").alias("m"), F.col("m").alias("n"), "cov")
    return half.select(F.inline(F.when(F.col("lag").between(1, 11), F.array(own, other)).otherwise(F.array(own))))


def lag_covariance(scores: DataFrame, pooled: bool = False, diagonal: bool = False) -> DataFrame:
    """lag, m, n and cov. Subjects count alike, their pairs averaged first; pooled: every pair counts alike."""
    sums = lag_sums(scores, pooled, diagonal).groupBy("lag", "m", "n").agg((F.sum("s") / F.sum("k")).alias("cov"), F.sum("k").alias("k"))
    return mirrored(sums.where("k > 0"))


def cross_spectra(lags: DataFrame, harmonics: int, symmetric: bool = True) -> DataFrame:
    """r, m, n, re and im: the discrete Fourier transform over lags -11 to 12, over 24; lags never seen add nothing.

    Symmetric: the mean of the matrix and its conjugate transpose, as a sum over each entry's two places.
    """
    rows = lags.select("m", "n", "cov", "lag", F.explode(F.sequence(F.lit(1), F.lit(harmonics))).alias("r"))
    if symmetric:
        own = F.struct(F.col("m").alias("m"), F.col("n").alias("n"), (F.col("cov") / 2).alias("cov"), F.lit(1).alias("sign"))
        other = F.struct(F.col("n").alias("m"), F.col("m").alias("n"), (F.col("cov") / 2).alias("cov"), F.lit(-1).alias("sign"))
        rows = rows.select("r", "lag", F.inline(F.array(own, other)))
    else:
        rows = rows.withColumn("sign", F.lit(1))
    angle = F.col("r") * F.col("lag") * (2 * math.pi / HOURS)
    return rows.groupBy("r", "m", "n").agg((F.sum(F.col("cov") * F.cos(angle)) / HOURS).alias("re"), (-F.sum(F.col("sign") * F.col("cov") * F.sin(angle)) / HOURS).alias("im"))


def power_spectra(lags: DataFrame, harmonics: int) -> DataFrame:
    """r, m and psd from the diagonal covariances."""
    return cross_spectra(lags.where("m = n"), harmonics, symmetric=False).select("r", "m", F.col("re").alias("psd"))


def shrunk(spectra: DataFrame, shrinkage: float) -> DataFrame:
    """Off-diagonal entries times 1 - shrinkage."""
    by = F.when(F.col("m") == F.col("n"), 1.0).otherwise(1.0 - shrinkage)
    return spectra.withColumns({"re": F.col("re") * by, "im": F.col("im") * by})


def shrunk_power(power: DataFrame, shrinkage: float, floor: float = 1e-6) -> DataFrame:
    """Each harmonic's powers moved towards their mean, and floored."""
    mean = F.avg("psd").over(Window.partitionBy("r"))
    return power.withColumn("psd", F.greatest((1 - shrinkage) * F.col("psd") + shrinkage * mean, F.lit(floor)))


def collected_spectra(spectra: DataFrame, harmonics: int, modes: int) -> np.ndarray:
    """As a complex array (harmonic, mode, mode): a few numbers at any size of the data."""
    out = np.zeros((harmonics, modes, modes), complex)
    for x in spectra.collect():
        out[x["r"] - 1, x["m"], x["n"]] = complex(x["re"], x["im"])
    return out


def fourier_table(scores: DataFrame, harmonics: int, period: float = 24.0) -> DataFrame:
    """scores with arrays ``c`` and ``s`` of the cosines and sines of its hour."""
    angles = [F.col("hour") * (2 * math.pi * r / period) for r in range(1, harmonics + 1)]
    return scores.withColumns({"c": F.array(*map(F.cos, angles)), "s": F.array(*map(F.sin, angles))})


def complete_day_harmonics(scores: DataFrame, harmonics: int, value: str = "xi") -> DataFrame:
    """subject_id, m, r, mesor, a and b of subjects with all 24 hours, where least squares has a closed form (r < 12)."""
    at = fourier_table(scores, harmonics)
    sums = [x for r in range(harmonics) for x in (F.sum(F.col(value) * F.col("c")[r]).alias(f"a{r}"), F.sum(F.col(value) * F.col("s")[r]).alias(f"b{r}"))]
    rows = at.groupBy("subject_id", "m").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mesor"), *sums).where(F.col("n") == HOURS)
    each = F.explode(F.array(*(F.struct(F.lit(r + 1).alias("r"), (F.col(f"a{r}") / 12).alias("a"), (F.col(f"b{r}") / 12).alias("b")) for r in range(harmonics))))
    return rows.select("subject_id", "m", "mesor", each.alias("h")).select("subject_id", "m", "h.r", "mesor", "h.a", "h.b")
