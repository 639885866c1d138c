"""One pass over days gives sums from which the whole spectral estimator follows, for any number of modes and any shrinkage.

Everything that a fit needs is quadratic in curves, once a subject's hours are known: the sums of curves and of their products; for each lag,
a subject's mean product of centred curves; and what its least-squares harmonics leave over. So these are kept as matrices over scales, and the
modes, which are known last, are applied to the matrices. Sums of two sets of subjects add up, and a subject is taken out again by its sums
with the sign turned: they can be kept for a stream, where a day changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayline.dataset import CurveSet
from dayline.functions import dense
from dayline.functions.curves import quadrature_weights
from dayline.operators.estimators import Basis, Fit, SpectralModel, remembered
from dayline.operators.partial import summed
from dayline.operators.spectral import DAYS, HALF
from dayline.schema import HOURS

#: The least eigenvalue of the products of harmonics over a day's hours, as a share of the largest, from which they are told apart safely.
APART = 1e-4


def flattened(hours: list[np.ndarray], curves: list[np.ndarray], scales: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Some days at a time: which ones, and of each of their rows the day among these, the hour and the curve."""
    for first in range(0, len(hours), DAYS):
        some = slice(first, min(first + DAYS, len(hours)))
        day = np.repeat(np.arange(some.stop - first), [len(h) for h in hours[some]])
        yield some, day, np.concatenate(hours[some]).astype(int), np.concatenate(curves[some]).astype(float).reshape(-1, scales)


def times(day: np.ndarray, hour: np.ndarray, days: int) -> np.ndarray:
    """How many rows each day has at each hour."""
    return np.bincount(day * HOURS + hour, minlength=days * HOURS).reshape(days, HOURS).astype(float)


def laid(day: np.ndarray, hour: np.ndarray, y: np.ndarray, days: int) -> np.ndarray:
    """Rows at their places (day, hour, scale), zeros where there is none."""
    return np.stack([np.bincount(day * HOURS + hour, column, days * HOURS) for column in y.T], axis=1).reshape(days, HOURS, -1)


@dataclass(frozen=True)
class Layout:
    """Where the sums stand in one vector: observations, subjects with two hours, subjects with each lag, curves, products, products at
    each lag, what is left over by harmonics, and what is left over by each of ``fewer`` harmonics."""

    scales: int
    harmonics: int = 2
    period: float = 24.0
    fewer: tuple[int, ...] = ()

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        s = self.scales
        return {"n": (), "subjects": (), "seen": (HALF,), "curves": (s,), "products": (s, s), "lags": (HALF, s, s), "rest": (s, s), "fewer": (len(self.fewer), s, s)}

    @property
    def size(self) -> int:
        return sum(int(np.prod(x)) for x in self.shapes.values())

    def packed(self, parts: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([np.ravel(parts[n]) for n in self.shapes])

    def parts(self, v: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([int(np.prod(x)) for x in self.shapes.values()])[:-1]
        return {n: p.reshape(x) for (n, x), p in zip(self.shapes.items(), np.split(v, ends), strict=True)}

    def of_days(self, hours: list[np.ndarray], curves: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
        """Signed sums of days, each with its hours in order and its curves end to end."""
        total = np.zeros(self.size)
        for some, day, hour, y in flattened(hours, curves, self.scales):
            total += self.of_rows(day, hour, y, signs[some])
        return total

    def of_rows(self, day: np.ndarray, hour: np.ndarray, y: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """The same of rows of days: the day of each from 0 to len(sign) - 1 in order, its hour and its curve."""
        total = np.zeros(self.size)
        at = self.parts(total)  # views of total
        seen = times(day, hour, len(sign))
        size = seen.sum(axis=1)
        x = y - (laid(day, hour, y, len(sign)).sum(axis=1) / np.maximum(size, 1)[:, None])[day]
        at["n"][...], at["subjects"][...] = sign @ size, sign @ (size > 1)
        at["curves"][...] = sign[day] @ y
        at["products"][...] = (y * sign[day][:, None]).T @ y
        for fits, left in zip((at["rest"], *at["fewer"]), self._left(day, hour, x, seen), strict=True):
            fits[...] = (left * (sign / np.maximum(size - 1, 1))[day][:, None]).T @ left
        x, seen = laid(day, hour, x, len(sign)), (seen > 0).astype(float)
        for lag in range(HALF):
            pairs = (seen * np.roll(seen, -lag, axis=1)).sum(axis=1)
            at["lags"][lag] = np.tensordot(x * (sign / np.maximum(pairs, 1))[:, None, None], np.roll(x, -lag, axis=1), axes=([0, 1], [0, 1]))
            at["seen"][lag] = sign @ (pairs > 0)
        return total

    def _left(self, day: np.ndarray, hour: np.ndarray, x: np.ndarray, seen: np.ndarray) -> list[np.ndarray]:
        """What least squares of each number of harmonics leave of the centred rows x, centred again; of a day of one hour nothing.

        Harmonics made orthonormal over a day's hours in their order serve every smaller number of them too. Days whose hours hardly tell them
        apart are solved one by one.
        """
        size, most = seen.sum(axis=1), max(self.harmonics, *self.fewer, 0)
        f = dense.fourier(np.arange(HOURS), most, self.period)
        gram = (seen @ (f[:, :, None] * f[:, None, :]).reshape(HOURS, -1)).reshape(len(seen), 2 * most, 2 * most)
        spread = np.linalg.eigvalsh(gram)
        plain = (size > 1) & (spread[:, 0] > APART * spread[:, -1])
        q = np.zeros((len(seen), HOURS, 2 * most))
        q[plain] = np.linalg.solve(np.linalg.cholesky(gram[plain]), np.broadcast_to(f.T, (int(plain.sum()), *f.T.shape))).transpose(0, 2, 1)
        b = q.transpose(0, 2, 1) @ laid(day, hour, x, len(seen))
        first = np.searchsorted(day, np.arange(len(seen) + 1))
        found = []
        for h in (self.harmonics, *self.fewer):
            left = x - (q[:, :, : 2 * h] @ b[:, : 2 * h])[day, hour]
            left -= (laid(day, hour, left, len(seen)).sum(axis=1) / np.maximum(size, 1)[:, None])[day]
            leftover = remembered(lambda hours, h=h: self._leftover(hours, h))
            for k in np.flatnonzero(~plain):
                own = slice(first[k], first[k + 1])
                left[own] = leftover(hour[own]) @ x[own] if size[k] > 1 else 0
            found.append(left)
        return found

    def _leftover(self, hours: np.ndarray, harmonics: int) -> np.ndarray:
        """The matrix that takes curves of these hours to their residuals, centred."""
        n = len(hours)
        centre = np.eye(n) - 1 / n
        design = dense.fourier(hours, harmonics, self.period)
        return centre @ (np.eye(n) - design @ np.linalg.pinv(design, rcond=max(design.shape) * np.finfo(float).eps)) @ centre


def day_sums(data: CurveSet, layout: Layout) -> np.ndarray:
    """The sums of all subjects, in one job."""
    days = data.packed().select(F.transform("day", lambda x: x["hour"]).alias("hours"), F.flatten(F.transform("day", lambda x: x["curve"])).alias("values"))
    return summed(days, lambda b: layout.of_days(b["hours"].to_list(), b["values"].to_list(), np.ones(len(b))), layout.size)


def fit_of(sums: np.ndarray, layout: Layout, scales: list[float], n_modes: int | str = 3, harmonics: int | None = None, shift: np.ndarray | float = 0.0) -> Fit:
    """Modes, noise and spectra from sums; with more modes than are asked for nothing else changes, since modes are nested.

    harmonics: those of the layout, or one of its fewer. shift: what was taken from every curve before it was summed.
    """
    harmonics = layout.harmonics if harmonics is None else harmonics
    at = layout.parts(sums)
    n = float(at["n"])
    if n < 1:
        raise ValueError("no observations")
    mean, w = at["curves"] / n, np.array(quadrature_weights(scales))
    root = np.sqrt(w)
    values, vectors = dense.descending((at["products"] - n * np.outer(mean, mean)) * root[:, None] * root / max(n - 1, 1), floor=0.0)
    m = dense.n_modes(values, n_modes)
    modes = vectors[:m] / root
    modes = dense.signed_rows(modes / np.sqrt((modes**2 * w).sum(axis=1, keepdims=True)))
    a = modes * w
    lags = np.einsum("ms,lst,nt->lmn", a, at["lags"] / np.maximum(at["seen"], 1)[:, None, None], a)
    lag = np.arange(-11, 13)
    around = np.stack([lags[h] if h >= 0 else lags[-h].T for h in lag])
    spectra = np.stack([(around * np.exp(-2j * np.pi * r * lag / HOURS)[:, None, None]).sum(axis=0) / HOURS for r in range(1, harmonics + 1)])
    spectra = (spectra + spectra.conj().transpose(0, 2, 1)) / 2
    rest = at["rest"] if harmonics == layout.harmonics else at["fewer"][layout.fewer.index(harmonics)]
    noise = np.einsum("ms,st,mt->m", a, rest, a) / max(float(at["subjects"]), 1)
    return Fit(Basis(mean + shift, modes, values[:m], w, values), noise, spectra, harmonics, layout.period)


def fit_spectral_once(data: CurveSet, n_modes: int | str = 3, harmonics: int = 2, shrinkage: float = 0.25, period: float = 24.0, **options) -> SpectralModel:
    """What estimators.fit_spectral gives, from one job."""
    layout = Layout(len(data.scales), harmonics, period)
    found = fit_of(day_sums(data, layout), layout, data.scales, n_modes)
    return found.model(len(found.basis.modes), shrinkage, **options)


def lag_rows(sums: np.ndarray, layout: Layout) -> list[tuple[int, int, int, float]]:
    """lag, m, n and the two-level covariance of curves at scales m and n, for lags that any subject has."""
    at = layout.parts(sums)
    return [(lag, m, n, float(at["lags"][lag, m, n] / at["seen"][lag])) for lag in range(HALF) if at["seen"][lag] > 0.5 for m in range(layout.scales) for n in range(layout.scales)]


def signed_days(changes: DataFrame) -> DataFrame:
    """hours, values and sign: the day after with +1 and the day before with -1. changes: subject_id, hour, before and after, curves or null."""

    def day(column: str):
        at = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("hour", F.col(column).alias("curve")))))
        return at.alias(column)

    both = changes.groupBy("subject_id").agg(day("before"), day("after"))  # at most 24 in a row
    each = both.select(F.explode(F.array(F.struct(F.col("after").alias("day"), F.lit(1.0).alias("sign")), F.struct(F.col("before").alias("day"), F.lit(-1.0).alias("sign")))).alias("x"))
    return each.where(F.size("x.day") > 0).select(F.transform("x.day", lambda d: d["hour"]).alias("hours"), F.flatten(F.transform("x.day", lambda d: d["curve"])).alias("values"), "x.sign")


def sums_of_changes(changes: DataFrame, layout: Layout) -> np.ndarray:
    return summed(signed_days(changes), lambda b: layout.of_days(b["hours"].to_list(), b["values"].to_list(), b["sign"].to_numpy()), layout.size)


__all__ = ["Layout", "day_sums", "fit_of", "fit_spectral_once", "flattened", "laid", "lag_rows", "sums_of_changes", "times"]
