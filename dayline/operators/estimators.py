"""Estimators over a CurveSet: fit gathers small sums of all rows, transform and reconstruct are lazy DataFrames.

What reaches the driver has the size of the scale grid or of the modes, never of the subjects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayline.dataset import CurveSet
from dayline.functions import dense
from dayline.functions.curves import literal, total
from dayline.operators import spectral
from dayline.operators.partial import summed


def gram(curves: DataFrame, mean: np.ndarray) -> tuple[int, np.ndarray]:
    """Rows and the sum of outer products of centred curves: one pass, a partial sum of each partition."""
    size = len(mean)

    def part(batch: pd.DataFrame) -> np.ndarray:
        x = np.stack(batch["curve"].to_numpy()) - mean
        return np.append((x.T @ x).ravel(), len(x))

    out = summed(curves.select("curve"), part, size * size + 1)
    return int(out[-1]), out[:-1].reshape(size, size)


def by_subject(rows: DataFrame, value: Column, made: Callable[[np.ndarray, np.ndarray], dict[str, list]], schema: str) -> DataFrame:
    """made(hours, x) gives columns of a subject's rows, from its hours in order and its arrays ``value`` as rows of x.

    Days are packed into rows, so that Python is handed batches of subjects and returns batches.
    """
    day = rows.select("subject_id", "hour", value.alias("x")).groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("hour", "x"))).alias("day"))
    packed = day.select("subject_id", F.transform("day", lambda d: d["hour"]).alias("hours"), F.flatten(F.transform("day", lambda d: d["x"])).alias("values"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {}
            for subject, hours, values in zip(batch["subject_id"], batch["hours"], batch["values"], strict=True):
                found = made(np.asarray(hours, int), np.asarray(values, float).reshape(len(hours), -1))
                for name, column in found.items():
                    out.setdefault(name, []).extend(column)
                out.setdefault("subject_id", []).extend([subject] * len(column))
            if out:
                yield pd.DataFrame(out)

    return packed.mapInPandas(run, schema)


def remembered(of: Callable[[np.ndarray], object], most: int = 4096) -> Callable[[np.ndarray], object]:
    """of(hours), kept for sets of hours met before: subjects with the same hours share a design."""
    known: dict[bytes, object] = {}

    def get(hours: np.ndarray):
        key = hours.tobytes()
        if key not in known:
            if len(known) >= most:
                known.clear()
            known[key] = of(hours)
        return known[key]

    return get


@dataclass(frozen=True)
class Basis:
    """A mean curve, modes as rows, their variances, and the weights of the inner product of curves."""

    mean: np.ndarray
    modes: np.ndarray
    variances: np.ndarray
    weights: np.ndarray
    all_variances: np.ndarray

    def scores(self) -> Column:
        """The array of scores of a row's ``curve``."""
        w = self.modes * self.weights
        return F.array(*(total(F.zip_with("curve", literal(v), lambda a, b: a * b)) - float(v @ self.mean) for v in w))


    def curves(self, scores: str = "xi") -> Column:
        """The curve of an array of scores: mean and modes."""
        points = [literal(self.modes[:, j]) for j in range(len(self.mean))]
        return F.array(*(total(F.zip_with(scores, p, lambda a, b: a * b)) + float(m) for p, m in zip(points, self.mean, strict=True)))


def mean_fingerprint(data: CurveSet, basis: Basis) -> DataFrame:
    """subject_id and fingerprint: the subject's scores, each averaged over its hours."""
    rows = data.observations.select("subject_id", basis.scores().alias("xi"))
    return rows.groupBy("subject_id").agg(F.array(*(F.avg(F.col("xi")[m]) for m in range(len(basis.modes)))).alias("fingerprint"))


def mean_reconstruction(data: CurveSet, basis: Basis) -> DataFrame:
    """subject_id, hour and curve: each observed curve from its own scores."""
    return data.observations.select("subject_id", "hour", basis.scores().alias("xi")).select("subject_id", "hour", basis.curves().alias("curve"))


def fit_basis(data: CurveSet, n_modes: int | str = 3, weighted: bool = True) -> Basis:
    """Shape modes. Weighted: by quadrature, variances over n - 1; otherwise plain, over n.

    "ev95" for ``n_modes`` takes the fewest modes that explain 95 % of the variance.
    """
    mean = np.array([r["mean"] for r in data.mean_curve().orderBy("j").collect()])
    w = np.array(data.weights) if weighted else np.ones(len(mean))
    n, g = gram(data.observations, mean)
    root = np.sqrt(w)
    values, vectors = dense.descending(g * root[:, None] * root / max(n - 1 if weighted else n, 1), floor=0.0)
    m = dense.n_modes(values, n_modes)
    modes = vectors[:m] / root
    modes = dense.signed_rows(modes / np.sqrt((modes**2 * w).sum(axis=1, keepdims=True)))
    return Basis(mean, modes, values[:m], w, values)


@dataclass(frozen=True)
class SpectralModel:
    """Shape modes whose scores are a stationary process around the clock, with posteriors of each subject's harmonics.

    ``prior_layout`` "as_published" keeps the prior harmonic by harmonic although coefficients are mode by mode;
    "aligned" puts the prior in the order of the coefficients.
    """

    basis: Basis
    noise: float
    spectra: np.ndarray
    eigenvalues: np.ndarray
    vectors: np.ndarray
    harmonics: int = 2
    period: float = 24.0
    ridge: float = 1e-6
    prior_layout: str = "as_published"
    prior_scale: float = 0.5

    def precision(self) -> np.ndarray:
        p = dense.prior(self.spectra, self.prior_scale)
        if self.prior_layout == "aligned":
            order = dense.aligned_order(self.harmonics, len(self.basis.modes))
            p = p[np.ix_(order, order)]
        return np.linalg.solve(p + self.ridge * np.eye(len(p)), np.eye(len(p)))

    def _per_subject(self, data: CurveSet, made, schema: str) -> DataFrame:
        """made(hours, offsets, coefficients[mode, 2R], covariance) gives the columns of a subject's rows."""
        precision, noise, ridge, harmonics, period, modes = self.precision(), self.noise, self.ridge, self.harmonics, self.period, len(self.basis.modes)

        def prepared(hours: np.ndarray):
            design = dense.fourier(hours, harmonics, period)
            return design, dense.posterior_covariance(precision, design, modes, noise, ridge)

        known = remembered(prepared)

        def run(hours: np.ndarray, x: np.ndarray) -> dict[str, list]:
            design, covariance = known(hours)
            offsets = x.mean(axis=0)
            b = covariance @ (design.T @ (x - offsets)).T.reshape(-1) / noise
            return made(hours, offsets, b.reshape(modes, -1), covariance)

        return by_subject(data.observations, self.basis.scores(), run, schema)

    def posteriors(self, data: CurveSet) -> DataFrame:
        def made(hours, offsets, b, covariance):
            return {"offsets": [offsets], "mean": [b.ravel()], "covariance": [list(covariance)]}

        return self._per_subject(data, made, "subject_id string, offsets array<double>, mean array<double>, covariance array<array<double>>")

    def transform(self, data: CurveSet) -> DataFrame:
        """subject_id and fingerprint: offsets, then for each harmonic the amplitudes and the phases along its rotated modes."""
        vectors = self.vectors

        def made(hours, offsets, b, covariance):
            parts = [offsets]
            for r, u in enumerate(vectors):
                z = u.conj() @ (b[:, 2 * r] - 1j * b[:, 2 * r + 1])
                parts += [np.abs(z), np.angle(z)]
            return {"fingerprint": [np.concatenate(parts)]}

        return self._per_subject(data, made, "subject_id string, fingerprint array<double>")

    def reconstruct(self, data: CurveSet, all_hours: bool = False) -> DataFrame:
        """subject_id, hour and curve at the observed hours, or at all 24."""
        modes, mean, harmonics, period = self.basis.modes, self.basis.mean, self.harmonics, self.period

        def made(hours, offsets, b, covariance):
            at = np.arange(24) if all_hours else hours
            curves = (offsets + dense.fourier(at, harmonics, period) @ b.T) @ modes + mean
            return {"hour": at.tolist(), "curve": list(curves)}

        return self._per_subject(data, made, "subject_id string, hour int, curve array<double>")


def mode_noise(scores: DataFrame, harmonics: int, period: float) -> np.ndarray:
    """Residual variance of least squares of each mode: by subject, then the mean over subjects with two hours or more. scores: xi array."""

    def rest(hours: np.ndarray, x: np.ndarray) -> dict[str, list]:
        if len(x) < 2:
            return {"m": [], "v": []}
        x = x - x.mean(axis=0)
        design = dense.fourier(hours, harmonics, period)
        left = x - design @ np.linalg.lstsq(design, x, rcond=None)[0]
        return {"m": list(range(x.shape[1])), "v": left.var(axis=0, ddof=1).tolist()}

    each = by_subject(scores, F.col("xi"), rest, "subject_id string, m int, v double")
    return np.array([r["v"] for r in each.groupBy("m").agg(F.avg("v").alias("v")).orderBy("m").collect()])


def harmonic_noise(scores: DataFrame, harmonics: int, period: float) -> float:
    """The mean over modes of mode_noise, floored."""
    found = mode_noise(scores, harmonics, period)
    return max(float(found.mean()) if len(found) else 0.0, 1e-12)


@dataclass(frozen=True)
class Fit:
    """What one pass over the data gives for every smaller number of modes and any shrinkage: modes are nested."""

    basis: Basis
    noise: np.ndarray
    spectra: np.ndarray
    harmonics: int
    period: float

    def model(self, modes: int, shrinkage: float, **options) -> SpectralModel:
        basis = replace(self.basis, modes=self.basis.modes[:modes], variances=self.basis.variances[:modes])
        s = self.spectra[:, : len(basis.modes), : len(basis.modes)]
        s = (1 - shrinkage) * s + shrinkage * s * np.eye(s.shape[1])
        pairs = [dense.descending(x, floor=1e-10) for x in s]
        noise = max(float(self.noise[: len(basis.modes)].mean()) if len(self.noise) else 0.0, 1e-12)
        return SpectralModel(basis, noise, s, np.stack([v for v, _ in pairs]), np.stack([u for _, u in pairs]), self.harmonics, self.period, **options)


def fit_parts(data: CurveSet, n_modes: int | str, harmonics: int, period: float, basis: Basis | None = None) -> Fit:
    basis = basis or fit_basis(data, n_modes)
    scores = data.observations.select("subject_id", "hour", basis.scores().alias("xi"))
    noise = mode_noise(scores, harmonics, period)
    long = spectral.centred(scores.select("subject_id", "hour", F.posexplode("xi").alias("m", "xi")))
    spectra = spectral.cross_spectra(spectral.lag_covariance(long), harmonics)
    return Fit(basis, noise, spectral.collected_spectra(spectra, harmonics, len(basis.modes)), harmonics, period)


def fit_spectral(data: CurveSet, n_modes: int | str = 3, harmonics: int = 2, shrinkage: float = 0.25, period: float = 24.0, basis: Basis | None = None, **options) -> SpectralModel:
    """Fit shape modes (or take a basis), noise and shrunk cross-spectra; options are the last fields of SpectralModel.

    Modes and shrinkage are chosen by folds in operators.selection.
    """
    found = fit_parts(data, n_modes, harmonics, period, basis)
    return found.model(len(found.basis.modes), shrinkage, **options)


def cosinor(data: CurveSet, harmonics: int = 2, period: float = 24.0, reconstruct: bool = False) -> DataFrame:
    """Least squares of raw curves on a level and harmonics: each subject's fingerprint (levels, then amplitudes and phases of
    each harmonic, a value for each scale), or its fitted curves at the observed hours."""
    solved = remembered(lambda hours: least_squares(dense.fourier(hours, harmonics, period, intercept=True)))

    def run(hours: np.ndarray, x: np.ndarray) -> dict[str, list]:
        design, inverse = solved(hours)
        b = inverse @ x
        if reconstruct:
            return {"hour": hours.tolist(), "curve": list(design @ b)}
        parts = [b[0]]
        for a, s in zip(b[1::2], b[2::2], strict=True):
            parts += [np.hypot(a, s), np.arctan2(-s, a)]
        return {"fingerprint": [np.concatenate(parts)]}

    schema = "subject_id string, hour int, curve array<double>" if reconstruct else "subject_id string, fingerprint array<double>"
    return by_subject(data.observations, F.col("curve"), run, schema)


@dataclass(frozen=True)
class CosinorModel:
    """Least squares of raw curves: nothing is learned over subjects but the scale grid is that of the fit."""

    scales: int
    harmonics: int = 2
    period: float = 24.0

    def _checked(self, data: CurveSet) -> CurveSet:
        if len(data.scales) != self.scales:
            raise ValueError(f"curves have {len(data.scales)} scales, the model {self.scales}")
        return data

    def transform(self, data: CurveSet) -> DataFrame:
        return cosinor(self._checked(data), self.harmonics, self.period)

    def reconstruct(self, data: CurveSet) -> DataFrame:
        return cosinor(self._checked(data), self.harmonics, self.period, reconstruct=True)


def fit_cosinor(data: CurveSet, harmonics: int = 2, period: float = 24.0) -> CosinorModel:
    return CosinorModel(len(data.scales), harmonics, period)


def least_squares(design: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A design and the matrix that gives its solution of least norm."""
    return design, np.linalg.pinv(design, rcond=max(design.shape) * np.finfo(float).eps)


@dataclass(frozen=True)
class HarmonicModel:
    """Plain shape modes and least-squares harmonics of each subject's centred scores.

    With ``vectors`` coefficients are rotated along the modes of each harmonic's spectrum; with ``powers`` (harmonic, mode)
    amplitudes are scaled by their roots and laid out mode by mode; with neither they stay as they are.
    """

    basis: Basis
    vectors: np.ndarray | None = None
    powers: np.ndarray | None = None
    harmonics: int = 2
    period: float = 24.0

    def _per_subject(self, data: CurveSet, made, schema: str) -> DataFrame:
        harmonics, period = self.harmonics, self.period
        solved = remembered(lambda hours: least_squares(dense.fourier(hours, harmonics, period)))

        def run(hours: np.ndarray, x: np.ndarray) -> dict[str, list]:
            design, inverse = solved(hours)
            offsets = x.mean(axis=0)
            return made(hours, offsets, inverse @ (x - offsets), design)

        return by_subject(data.observations, self.basis.scores(), run, schema)

    def transform(self, data: CurveSet) -> DataFrame:
        vectors, powers = self.vectors, self.powers

        def made(hours, offsets, b, design):
            z = b[0::2] - 1j * b[1::2]  # harmonic, mode
            if powers is not None:
                each = np.stack([np.abs(z) * np.sqrt(powers), np.angle(z)], axis=2)
                return {"fingerprint": [np.concatenate([offsets, each.transpose(1, 0, 2).ravel()])]}
            if vectors is not None:
                z = np.stack([u.conj() @ row for u, row in zip(vectors, z, strict=True)])
            return {"fingerprint": [np.concatenate([offsets, *(p for row in z for p in (np.abs(row), np.angle(row)))])]}

        return self._per_subject(data, made, "subject_id string, fingerprint array<double>")

    def reconstruct(self, data: CurveSet) -> DataFrame:
        modes, mean = self.basis.modes, self.basis.mean

        def made(hours, offsets, b, design):
            return {"hour": hours.tolist(), "curve": list((offsets + design @ b) @ modes + mean)}

        return self._per_subject(data, made, "subject_id string, hour int, curve array<double>")


def fit_harmonic(data: CurveSet, kind: str = "least_squares", n_modes: int | str = 3, harmonics: int = 2, shrinkage: float = 0.25, rotate: bool = True, period: float = 24.0, basis: Basis | None = None) -> HarmonicModel:
    """kind "least_squares": spectra of all modes, for rotation; "diagonal": a power for each harmonic and mode. Pairs are pooled."""
    basis = basis or fit_basis(data, n_modes, weighted=False)
    if kind == "least_squares" and not rotate:
        return HarmonicModel(basis, harmonics=harmonics, period=period)
    scores = data.observations.select("subject_id", "hour", F.posexplode(basis.scores()).alias("m", "xi"))
    lags = spectral.lag_covariance(spectral.centred(scores), pooled=True, diagonal=kind == "diagonal")
    if kind == "diagonal":
        powers = np.zeros((harmonics, len(basis.modes)))
        for x in spectral.shrunk_power(spectral.power_spectra(lags, harmonics), shrinkage).collect():
            powers[x["r"] - 1, x["m"]] = x["psd"]
        return HarmonicModel(basis, powers=powers, harmonics=harmonics, period=period)
    s = spectral.collected_spectra(spectral.shrunk(spectral.cross_spectra(lags, harmonics, symmetric=False), shrinkage), harmonics, len(basis.modes))
    return HarmonicModel(basis, vectors=np.stack([dense.descending(x)[1] for x in s]), harmonics=harmonics, period=period)
