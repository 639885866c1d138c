"""Folds of subjects, and the choice of modes and shrinkage by reconstruction of subjects left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.dataset import CurveSet, numbered
from dayline.functions import dense
from dayline.operators import sums
from dayline.operators.estimators import SpectralModel, remembered
from dayline.operators.partial import days, summed
from dayline.schema import HOURS

# What is tried where modes or shrinkage are to be chosen.
MODES, SHRINKAGES, HARMONICS = (2, 3, 5), (0.0, 0.1, 0.25, 0.5), (1, 2, 3)


def contiguous_folds(ids: DataFrame, folds: int, equal: bool = False) -> DataFrame:
    """subject_id and fold by the order of ids. The first folds have a subject more where they do not come out even;
    equal: all have as many, at least one, and the subjects left over are in fold -1."""
    at = numbered(ids)
    n = at.count()
    size = n // folds
    if equal:
        size = max(1, size)
        return at.select("subject_id", F.when(F.col("place") < size * folds, F.floor(F.col("place") / size)).otherwise(-1).cast("int").alias("fold"))
    longer = n - size * folds  # folds of size + 1
    late = F.floor((F.col("place") - longer) / max(size, 1))
    return at.select("subject_id", F.when(F.col("place") < longer * (size + 1), F.floor(F.col("place") / (size + 1))).otherwise(late).cast("int").alias("fold"))


def stratified_folds(rows: DataFrame, label: str, folds: int) -> DataFrame:
    """subject_id, label and fold: in the order of ids, each class fills the folds one after another.

    Classes are laid end to end in the order of their first subject; a fold gets as many of a class as places of that row that leave
    the fold's number as the remainder.
    """
    at = rows.select("subject_id", label).join(numbered(rows.select("subject_id")), "subject_id").persist(StorageLevel.MEMORY_AND_DISK)
    classes = at.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).orderBy("first").collect()
    ends, start = [], 0
    for c in classes:
        span = np.arange(folds)
        counts = (start + c["n"] - 1 - span) // folds - (start - 1 - span) // folds
        ends.append((c[label], [int(x) for x in np.cumsum(counts)]))
        start += c["n"]
    limits = at.sparkSession.createDataFrame(ends, f"{label} {at.schema[label].dataType.simpleString()}, ends array<long>")  # a row for each class
    # rank in the class: places of the class before, counted in ranges of places
    width = 1 << 16
    cells = at.groupBy(label, F.floor(F.col("place") / width).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    before = cells.select(label, "cell", F.coalesce(F.sum("n").over(Window.partitionBy(label).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = at.withColumn("cell", F.floor(F.col("place") / width)).withColumn("inside", F.row_number().over(Window.partitionBy(label, "cell").orderBy("place")) - 1)
    ranked = inside.join(before, [label, "cell"]).join(F.broadcast(limits), label)
    rank = F.col("before") + F.col("inside")
    return ranked.select("subject_id", label, F.size(F.filter("ends", lambda e: e <= rank)).alias("fold"))


class Predictor:
    """Curves that a model expects of many days at once, from their rows at each hour."""

    def __init__(self, model: SpectralModel):
        self.model, self.precision = model, model.precision()
        self.prior = self.precision + model.ridge * np.eye(len(self.precision))
        self.design = dense.fourier(np.arange(HOURS), model.harmonics, model.period)
        self.known = remembered(lambda hours: dense.posterior_covariance(self.precision, self.design[hours], len(model.basis.modes), model.noise, model.ridge))

    def curves(self, x: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """(day, hour, scale) at all hours. x: the sum of a day's curves at each hour; seen: how many they are. A day without any gets the mean curve."""
        basis, f, modes, noise = self.model.basis, self.design, len(self.model.basis.modes), self.model.noise
        size, wide = seen.sum(axis=1), f.shape[1]
        z = ((x - seen[:, :, None] * basis.mean) * basis.weights) @ basis.modes.T
        offsets = z.sum(axis=1) / np.maximum(size, 1)[:, None]
        seen_with = (z - seen[:, :, None] * offsets[:, None]).transpose(0, 2, 1) @ f / noise
        b = np.zeros(seen_with.shape)
        many = size >= wide
        if many.any():
            gram = (seen[many] @ (f[:, :, None] * f[:, None, :]).reshape(HOURS, -1)).reshape(-1, wide, wide) / noise
            p = np.repeat(self.prior.reshape(1, modes, wide, modes, wide), len(gram), axis=0)
            for m in range(modes):
                p[:, m, :, m] += gram
            b[many] = np.linalg.solve(p.reshape(len(gram), modes * wide, -1), seen_with[many].reshape(len(gram), -1, 1)).reshape(len(gram), modes, wide)
        for k in np.flatnonzero(~many & (size > 0)):  # fewer hours than coefficients of a mode have a cheaper form
            b[k] = (self.known(np.repeat(np.arange(HOURS), seen[k].astype(int))) @ seen_with[k].ravel()).reshape(modes, wide)
        return (offsets[:, None] + f @ b.transpose(0, 2, 1)) @ basis.modes + basis.mean


def mean_of_days(rows: DataFrame, scales: int) -> np.ndarray:
    """The mean of all curves."""

    def part(batch: pd.DataFrame) -> np.ndarray:
        y = np.concatenate(batch["values"].to_list()).reshape(-1, scales)
        return np.append(y.sum(axis=0), len(y))

    total = summed(rows.select("values"), part, scales + 1)
    return total[:-1] / max(total[-1], 1)


def fold_sums(rows: DataFrame, layout: sums.Layout, folds: int, shift: np.ndarray) -> np.ndarray:
    """The sums of the subjects of each fold, and last of those in none: one pass. rows: hours, values and fold."""

    def part(batch: pd.DataFrame) -> np.ndarray:
        total = np.zeros((folds + 1, layout.size))
        for f, own in batch.groupby("fold"):
            for _, day, hour, y in sums.flattened(own["hours"].to_list(), own["values"].to_list(), layout.scales):
                total[f] += layout.of_rows(day, hour, y - shift, np.ones(day[-1] + 1))
        return total.ravel()

    return summed(rows.select("hours", "values", "fold"), part, (folds + 1) * layout.size).reshape(folds + 1, -1)


def errors(models: dict[int, list[SpectralModel]], rows: DataFrame, scales: int) -> np.ndarray:
    """Of each candidate, the sum over subjects of the mean squared error of their curves as reconstructed by their own fold's models: one pass.

    models: the candidates of a fold in one order; subjects of other folds are left out. rows: hours, values and fold.
    """
    many = len(next(iter(models.values())))

    def made() -> dict[int, list[Predictor]]:
        return {f: [Predictor(m) for m in some] for f, some in models.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, predictors = np.zeros(many), made()
        for batch in batches:
            for f, own in batch.groupby("fold"):
                for _, day, hour, y in sums.flattened(own["hours"].to_list(), own["values"].to_list(), scales) if f in predictors else ():
                    n = int(day[-1]) + 1
                    x, seen = sums.laid(day, hour, y, n), sums.times(day, hour, n)
                    for k, p in enumerate(predictors[f]):
                        total[k] += (((y - p.curves(x, seen)[day, hour]) ** 2).mean(axis=1) / seen.sum(axis=1)[day]).sum()
        yield pd.DataFrame({"k": np.arange(many), "e": total})

    found = rows.select("hours", "values", "fold").mapInPandas(run, "k int, e double").groupBy("k").agg(F.sum("e").alias("e")).collect()
    out = np.zeros(many)
    for k, e in found:
        out[k] = e
    return out


def selected(data: CurveSet, n_modes: int | str = "cv", shrinkage: float | str = "cv", folds: int = 5, harmonics: int = 2, period: float = 24.0, **options) -> tuple[SpectralModel, list[tuple[int, float, float]]]:
    """The model of all data with the modes and shrinkage of least error over folds, and (modes, shrinkage, error) of each pair tried.

    "cv" for either means its grid. Days are packed once; one pass sums them by fold, from which all folds are fitted with the most modes (fewer modes and
    other shrinkages come out of the same sums, and the model of all data of their total), and one more meets all candidates. The first of equal errors is taken.
    """
    modes = [m for m in MODES if m <= len(data.scales)] if n_modes == "cv" else [n_modes]
    tried = [(m, s) for m in modes for s in (SHRINKAGES if shrinkage == "cv" else (shrinkage,))]
    layout = sums.Layout(len(data.scales), harmonics, period)
    rows = days(data).persist(StorageLevel.MEMORY_AND_DISK)
    placed = rows.join(contiguous_folds(rows.select("subject_id"), folds, equal=True), "subject_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        shift = mean_of_days(placed, layout.scales)
        each = fold_sums(placed, layout, folds, shift)
        models = {}
        for k in range(folds):
            rest = np.delete(each, k, axis=0).sum(axis=0)
            if layout.parts(each[k])["n"] and layout.parts(rest)["n"]:
                parts = sums.fit_of(rest, layout, data.scales, max(modes) if n_modes == "cv" else n_modes, shift=shift)
                models[k] = [parts.model(m if n_modes == "cv" else len(parts.basis.modes), s, **options) for m, s in tried]
        if not models:
            raise ValueError("too few subjects for folds")
        total = errors(models, placed, layout.scales)
    finally:
        placed.unpersist()
        rows.unpersist()
    found = [(m, s, float(e / len(models))) for (m, s), e in zip(tried, total, strict=True)]
    m, s, _ = min(found, key=lambda x: x[2])
    whole = sums.fit_of(each.sum(axis=0), layout, data.scales, m, shift=shift)
    return whole.model(len(whole.basis.modes), s, **options), found


def hour_fold(folds: int, seed: int, hour: Column | str = "hour") -> Column:
    """0 to folds - 1, from subject_id and hour."""
    return F.pmod(F.xxhash64("subject_id", F.col(hour).cast("int") if isinstance(hour, str) else hour.cast("int"), F.lit(seed)), F.lit(folds)).cast("int")


def left_out_errors(models: list[list[SpectralModel]], rows: DataFrame, scales: int) -> np.ndarray:
    """Of each candidate, the mean squared error of curves at hours left out, each predicted by its fold's models from the subject's other hours.

    models: of each fold, the candidates in one order. Every day is read once for all folds and candidates. A subject without other hours is predicted
    by the mean curve. rows: hours, values and the folds of hours.
    """
    many = len(models[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(many), 0
        predictors = [[Predictor(m) for m in some] for some in models]
        for batch in batches:
            own_folds = batch["folds"].to_list()
            for some, day, hour, y in sums.flattened(batch["hours"].to_list(), batch["values"].to_list(), scales):
                own = np.concatenate(own_folds[some])
                n += len(own)
                for f in np.unique(own):
                    held = own == f
                    asked, place = np.unique(day[held], return_inverse=True)  # days with an hour in this fold
                    to = np.full(int(day[-1]) + 1, -1)
                    to[asked] = np.arange(len(asked))
                    rest = ~held & (to[day] >= 0)
                    x, seen = sums.laid(to[day[rest]], hour[rest], y[rest], len(asked)), sums.times(to[day[rest]], hour[rest], len(asked))
                    for k, p in enumerate(predictors[f]):
                        total[k] += ((y[held] - p.curves(x, seen)[place, hour[held]]) ** 2).mean(axis=1).sum()
        yield pd.DataFrame({"k": np.arange(many), "e": total, "n": n})

    found = rows.select("hours", "values", "folds").mapInPandas(run, "k int, e double, n long").groupBy("k").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).orderBy("k").collect()
    return np.array([r["e"] / r["n"] if r["n"] else np.nan for r in found])


def left_out_sums(rows: DataFrame, layout: sums.Layout, folds: int, shift: np.ndarray) -> np.ndarray:
    """The sums of days without the hours of each fold, and last of whole days: one pass. rows: hours, values and the folds of hours."""

    def part(batch: pd.DataFrame) -> np.ndarray:
        total, own_folds = np.zeros((folds + 1, layout.size)), batch["folds"].to_list()
        for some, day, hour, y in sums.flattened(batch["hours"].to_list(), batch["values"].to_list(), layout.scales):
            y, own, sign = y - shift, np.concatenate(own_folds[some]), np.ones(int(day[-1]) + 1)
            for f in range(folds + 1):
                rest = own != f
                total[f] += layout.of_rows(day[rest], hour[rest], y[rest], sign)
        return total.ravel()

    return summed(rows.select("hours", "values", "folds"), part, (folds + 1) * layout.size).reshape(folds + 1, -1)


def selected_by_hours(data: CurveSet, modes: tuple[int, ...] = MODES, harmonics: tuple[int, ...] = HARMONICS, shrinkage: float = 0.25, folds: int = 5, seed: int = 42, period: float = 24.0, **options) -> tuple[SpectralModel, list[tuple[int, int, float]]]:
    """The model of all data with the modes and harmonics, chosen together, that predict hours left out best, and (modes, harmonics, error) of each pair.

    A fold leaves out rows by a hash of subject and hour. Days are packed once; one pass sums them without each fold's hours, from which every fold is
    fitted with the most modes and harmonics: fewer come out of the same sums, but for the noise, whose sums are kept for every number of harmonics.
    One more pass meets all candidates. The first of equal errors is taken.
    """
    modes = tuple(m for m in modes if m <= len(data.scales))
    tried = [(m, r) for m in modes for r in harmonics]
    layout = sums.Layout(len(data.scales), max(harmonics), period, tuple(sorted({*harmonics} - {max(harmonics)})))
    rows = days(data).withColumn("folds", F.transform("hours", lambda h: hour_fold(folds, seed, h))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        shift = mean_of_days(rows, layout.scales)
        each = left_out_sums(rows, layout, folds, shift)

        def fitted(k: int, m: int, r: int) -> SpectralModel:
            return sums.fit_of(each[k], layout, data.scales, m, r, shift).model(m, shrinkage, **options)

        error = left_out_errors([[fitted(k, m, r) for m, r in tried] for k in range(folds)], rows, layout.scales)
    finally:
        rows.unpersist()
    found = [(m, r, float(e)) for (m, r), e in zip(tried, error, strict=True)]
    m, r, _ = min(found, key=lambda x: x[2])
    return fitted(folds, m, r), found
