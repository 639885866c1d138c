"""Components of variation between subjects and within them, from curves centred by visit.

A visit is the place of an observation in its subject's hours. Fitting takes two passes: averages of each visit, then the sums
of both levels' outer products; what reaches the driver has the size of the scale grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from dayline import schema
from dayline.dataset import CurveSet
from dayline.functions import dense
from dayline.operators.partial import days, summed


@dataclass(frozen=True)
class TwoLevelModel:
    """The mean curve, the shift of each visit, and components (as rows) with variances of both levels."""

    mean: np.ndarray
    shifts: np.ndarray
    between: np.ndarray
    within: np.ndarray
    between_variances: np.ndarray
    within_variances: np.ndarray

    def _level(self) -> np.ndarray:
        """Of each visit that a day can have; one not seen in fitting has no shift."""
        return self.mean + np.pad(self.shifts, ((0, schema.HOURS - len(self.shifts)), (0, 0)))

    def transform(self, data: CurveSet) -> DataFrame:
        """subject_id and fingerprint: scores of the mean of the subject's curves less their visits' levels."""
        level, modes = self._level(), self.between

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                means = [_centred(v, level).mean(axis=0) for v in batch["values"]]
                yield pd.DataFrame({"subject_id": batch["subject_id"], "fingerprint": [modes @ m for m in means]})

        return days(data).select("subject_id", "values").mapInPandas(run, "subject_id string, fingerprint array<double>")

    def reconstruct(self, data: CurveSet) -> DataFrame:
        """subject_id, hour and curve: mean, shift and both levels' projections at the observed hours."""
        level, modes, inner = self._level(), self.between, self.within

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = {"subject_id": [], "hour": [], "curve": []}
                for subject, hours, values in zip(batch["subject_id"], batch["hours"], batch["values"], strict=True):
                    c = _centred(values, level)
                    m = c.mean(axis=0)
                    out["curve"].extend(level[: len(c)] + (modes @ m) @ modes + (c - m) @ inner.T @ inner)
                    out["hour"].extend(hours)
                    out["subject_id"].extend([subject] * len(c))
                yield pd.DataFrame(out)

        return days(data).mapInPandas(run, "subject_id string, hour int, curve array<double>")


def _centred(values: np.ndarray, level: np.ndarray) -> np.ndarray:
    x = np.asarray(values, float).reshape(-1, level.shape[1])
    return x - level[: len(x)]


def _covariance(n: float, sums: np.ndarray, products: np.ndarray) -> np.ndarray:
    return (products - np.outer(sums, sums) / max(n, 1)) / max(n - 1, 1)


def visit_levels(data: CurveSet) -> tuple[np.ndarray, np.ndarray]:
    """The mean curve, and the mean curve of each visit up to the last that any subject has: one pass."""
    size = len(data.scales)

    def by_visit(batch: pd.DataFrame) -> np.ndarray:
        out = np.zeros((schema.HOURS, size + 1))
        for values in batch["values"]:
            x = np.asarray(values, float).reshape(-1, size)
            out[: len(x), :size] += x
            out[: len(x), size] += 1
        return out.ravel()

    visits = summed(days(data).select("values"), by_visit, schema.HOURS * (size + 1)).reshape(schema.HOURS, size + 1)
    visits = visits[visits[:, size] > 0]
    if not len(visits):
        raise ValueError("no observations")
    return visits[:, :size].sum(axis=0) / visits[:, size].sum(), visits[:, :size] / visits[:, size:]


def level_covariances(data: CurveSet, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between subjects: the covariance of their means less the within one over the largest number of visits; and within them. One pass."""
    size = len(data.scales)

    def products(batch: pd.DataFrame) -> np.ndarray:
        out = np.zeros((2, size + 1, size + 1))  # the corner counts rows, the edge holds their sum
        for values in batch["values"]:
            c = _centred(values, level)
            m = c.mean(axis=0, keepdims=True)
            for k, rows in enumerate((m, c - m)):
                rows = np.hstack([rows, np.ones((len(rows), 1))])
                out[k] += rows.T @ rows
        return out.ravel()

    both = summed(days(data).select("values"), products, 2 * (size + 1) ** 2).reshape(2, size + 1, size + 1)
    subjects, inner = (_covariance(g[-1, -1], g[-1, :-1], g[:-1, :-1]) for g in both)
    return subjects - inner / len(level), inner


def fit_two_level(data: CurveSet, share: float = 0.95) -> TwoLevelModel:
    """Negative variances are set to zero; each level keeps the fewest components that explain the share."""
    mean, level = visit_levels(data)
    found = [dense.descending(k, floor=0.0) for k in level_covariances(data, level)]
    kept = [dense.n_modes(values, "share", share) for values, _ in found]
    (bv, b), (wv, w) = found
    return TwoLevelModel(mean, level - mean, b[: kept[0]], w[: kept[1]], bv[: kept[0]], wv[: kept[1]])
