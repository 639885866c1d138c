"""A masked autoencoder of a subject's day: each hour's curve to hidden units, all hours to a short code, and back.

Hours that were not observed count neither as input nor in the loss. Loss and exact gradient are sums over all subjects, one Spark
job each; the driver holds the weights, whose number depends on the scale grid only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from dayline import schema
from dayline.dataset import CurveSet
from dayline.functions import dense
from dayline.operators.partial import GROUPS, days

#: Subjects of a block that is laid out once.
ROWS = 512


def shapes(scales: int, hidden: int, code: int) -> list[tuple[int, ...]]:
    """Of the weights and biases of four layers, in order."""
    flat = schema.HOURS * hidden
    return [(scales, hidden), (hidden,), (flat, code), (code,), (code, flat), (flat,), (hidden, scales), (scales,)]


def parted(w: np.ndarray, form: list[tuple[int, ...]]) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in form])
    return [x.reshape(s) for x, s in zip(np.split(w, ends[:-1]), form, strict=True)]


def first_weights(form: list[tuple[int, ...]], seed: int = 42) -> np.ndarray:
    """Normal, with variance 2 over the number of inputs; biases zero."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.standard_normal(s).ravel() * np.sqrt(2 / s[0]) if len(s) == 2 else np.zeros(s) for s in form])


def laid_out(batch: pd.DataFrame, scales: int) -> tuple[np.ndarray, np.ndarray]:
    """Curves (subject, hour, scale), zero where missing, and the mask."""
    x, mask = np.zeros((len(batch), schema.HOURS, scales)), np.zeros((len(batch), schema.HOURS))
    for i, (hours, values) in enumerate(zip(batch["hours"], batch["values"], strict=True)):
        at = np.asarray(hours, int)
        x[i, at] = np.asarray(values, float).reshape(-1, scales)
        mask[i, at] = 1
    return x, mask


def codes(p: list[np.ndarray], x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ p[0] + p[1]) * mask[:, :, None]
    return np.tanh(hidden.reshape(len(x), -1) @ p[2] + p[3]), hidden


def decoded(p: list[np.ndarray], z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    back = np.tanh(z @ p[4] + p[5]).reshape(len(z), schema.HOURS, -1)
    return back @ p[6] + p[7], back


def loss_and_gradient(p: list[np.ndarray], x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Sums over subjects: the loss (mean square over observed values), then the gradient, then the number of subjects."""
    z, hidden = codes(p, x, mask)
    y, back = decoded(p, z)
    per = 1 / (mask.sum(axis=1) * x.shape[2] + 1e-8)
    error = (y - x) * mask[:, :, None]
    dy = 2 * error * per[:, None, None]
    db = (dy @ p[6].T * (1 - back**2)).reshape(len(x), -1)
    dz = db @ p[4].T * (1 - z**2)
    dh = (dz @ p[2].T).reshape(hidden.shape) * mask[:, :, None] * (1 - hidden**2)
    grads = [
        x.reshape(-1, x.shape[2]).T @ dh.reshape(-1, dh.shape[2]), dh.sum(axis=(0, 1)), hidden.reshape(len(x), -1).T @ dz, dz.sum(axis=0),
        z.T @ db, db.sum(axis=0), back.reshape(-1, back.shape[2]).T @ dy.reshape(-1, dy.shape[2]), dy.sum(axis=(0, 1)),
    ]
    return np.concatenate([[((error**2).sum(axis=(1, 2)) * per).sum()], *(g.ravel() for g in grads), [len(x)]])


@dataclass(frozen=True)
class Autoencoder:
    weights: np.ndarray
    scales: int
    hidden: int
    code: int
    losses: tuple[float, ...] = ()

    def _parts(self) -> list[np.ndarray]:
        return parted(self.weights, shapes(self.scales, self.hidden, self.code))

    def transform(self, data: CurveSet) -> DataFrame:
        """subject_id and fingerprint, the code."""
        p, scales = self._parts(), self.scales

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"subject_id": batch["subject_id"], "fingerprint": list(codes(p, *laid_out(batch, scales))[0])})

        return days(data).mapInPandas(run, "subject_id string, fingerprint array<double>")

    def reconstruct(self, data: CurveSet) -> DataFrame:
        """subject_id, hour and curve at the observed hours."""
        p, scales = self._parts(), self.scales

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x, mask = laid_out(batch, scales)
                y = decoded(p, codes(p, x, mask)[0])[0]
                i, hour = np.nonzero(mask)
                yield pd.DataFrame({"subject_id": batch["subject_id"].to_numpy()[i], "hour": hour.astype("int32"), "curve": list(y[i, hour])})

        return days(data).mapInPandas(run, "subject_id string, hour int, curve array<double>")


def fit_autoencoder(data: CurveSet, code: int = 16, hidden: int = 32, steps: int = 200, penalty: float = 1e-4, seed: int = 42) -> Autoencoder:
    """Quasi-Newton descent; the penalty is half the squared weights."""
    form = shapes(len(data.scales), hidden, code)
    scales, start = len(data.scales), first_weights(form, seed)

    def blocked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                x, mask = laid_out(batch.iloc[a : a + ROWS], scales)
                yield pd.DataFrame({"x": [x.tobytes()], "mask": [mask.tobytes()]})

    # curves and masks are laid out once; a loss is one stage over blocks that are kept, whose sums are few
    packed = days(data).persist(StorageLevel.MEMORY_AND_DISK)
    parts = min(GROUPS, max(1, -(-packed.count() // ROWS)))
    whole, packed = packed, packed.repartition(parts, "subject_id").select("hours", "values")
    packed = packed.mapInPandas(blocked, "x binary, mask binary").persist(StorageLevel.MEMORY_AND_DISK)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        p = parted(w, form)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(w) + 2)
            for batch in batches:
                for x, mask in zip(batch["x"], batch["mask"], strict=True):
                    seen = np.frombuffer(mask).reshape(-1, schema.HOURS)
                    total += loss_and_gradient(p, np.frombuffer(x).reshape(len(seen), schema.HOURS, scales), seen)
            yield pd.DataFrame({"v": [total.tobytes()]})

        total = sum(np.frombuffer(r["v"]) for r in packed.mapInPandas(sums, "v binary").collect())  # GROUPS rows at most
        n = max(total[-1], 1)
        return total[0] / n + 0.5 * penalty * w @ w, total[1:-1] / n + penalty * w

    try:
        w, path = dense.minimised(loss, start, steps)
    finally:
        packed.unpersist()
        whole.unpersist()
    return Autoencoder(w, scales, hidden, code, tuple(path))
