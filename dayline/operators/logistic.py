"""Logistic regression by Newton steps, the models of all folds from the same jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayline.operators.partial import summed


def free_classes(counts: np.ndarray) -> list[int]:
    """Classes that have coefficients: of two, the second against the first; of more, all that occur; none if only one occurs."""
    seen = np.nonzero(counts)[0]
    if len(seen) < 2:
        return []
    return [1] if len(counts) == 2 else [int(c) for c in seen]


def probabilities(x: np.ndarray, w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each row (a one before its features) and class; a class that the training rows lack has none. w: class, 1 + features."""
    z = np.where(counts > 0, x @ w.T, -np.inf)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Summed loss, its gradient and its second derivatives over the free classes, end to end."""
    free = free_classes(counts)
    p = probabilities(x, w, counts)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    left = p[:, free] - (y[:, None] == np.array(free))
    h = np.zeros((len(free), x.shape[1], len(free), x.shape[1]))
    for i, a in enumerate(free):
        for j, b in enumerate(free):
            h[i, :, j] = x.T @ (x * (p[:, a] * ((a == b) - p[:, b]))[:, None])
    return np.concatenate([[loss], (left.T @ x).ravel(), h.ravel()])


def fold_models(rows: DataFrame, folds: int, strength: float = 1.0, steps: int = 50, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (fold, class, 1 + features) of the model of each fold's training rows, which are those of all other folds, and their class counts.

    rows: fingerprint, target (0 to C - 1), fold; they are read once a step, whatever the number of folds. Half the squared coefficients (levels are
    free) stand against ``strength`` times the summed loss. A step that does not lessen the loss is halved. The sums have
    folds x (classes x features)^2 numbers.
    """
    cells = rows.groupBy("fold", F.col("target").cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("fingerprint")).alias("width")).collect()  # a row for each fold and class
    if not cells:
        raise ValueError("no subject has a label")
    own = np.zeros((folds, max(r["c"] for r in cells) + 1), int)
    for r in cells:
        own[r["fold"], r["c"]] = r["n"]
    counts, size = own.sum(axis=0) - own, max(r["width"] for r in cells) + 1
    free = [free_classes(c) for c in counts]
    lengths = [1 + len(f) * size + (len(f) * size) ** 2 for f in free]
    ends = np.cumsum(lengths)
    w = np.zeros((folds, own.shape[1], size))

    def measured(at: np.ndarray) -> list[np.ndarray]:
        def part(batch: pd.DataFrame) -> np.ndarray:
            x = np.column_stack([np.ones(len(batch)), np.stack(batch["fingerprint"].to_numpy())])
            y, k = batch["target"].to_numpy(int), batch["fold"].to_numpy(int)
            return np.concatenate([slopes(x[k != f], y[k != f], at[f], counts[f]) if free[f] else np.zeros(1) for f in range(folds)])

        return np.split(summed(rows.select("fingerprint", "target", "fold"), part, int(ends[-1])), ends[:-1])

    def whole(f: int, at: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and second derivatives with the penalty."""
        n = len(free[f]) * size
        held = np.ones((len(free[f]), size))
        held[:, 0] = 0
        v = at[f, free[f]]
        return strength * sums[0] + (held * v * v).sum() / 2, strength * sums[1 : 1 + n] + (held * v).ravel(), strength * sums[1 + n :].reshape(n, n) + np.diag(held.ravel())

    open_folds = [f for f in range(folds) if free[f]]
    now = {f: whole(f, w, s) for f, s in enumerate(measured(w)) if free[f]} if open_folds else {}
    share = dict.fromkeys(open_folds, 1.0)
    for _ in range(steps):
        open_folds = [f for f in open_folds if np.abs(now[f][1]).max() > tolerance * max(1.0, counts[f].sum() * strength) and share[f] > 1e-8]
        if not open_folds:
            break
        tried = w.copy()
        for f in open_folds:
            _, g, h = now[f]
            tried[f, free[f]] -= share[f] * np.linalg.lstsq(h, g, rcond=1e-13)[0].reshape(len(free[f]), size)
        found = measured(tried)
        for f in open_folds:
            after = whole(f, tried, found[f])
            if after[0] <= now[f][0] + 1e-12 * abs(now[f][0]):
                w[f], now[f], share[f] = tried[f], after, min(1.0, 2 * share[f])
            else:
                share[f] /= 2
    return w, counts


def fold_scores(rows: DataFrame, folds: int, strength: float = 1.0) -> DataFrame:
    """subject_id, target, probability (array by class), prediction and fold: each row scored by the model of the other folds."""
    w, counts = fold_models(rows, folds, strength)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, k = np.column_stack([np.ones(len(batch)), np.stack(batch["fingerprint"].to_numpy())]) if len(batch) else np.zeros((0, w.shape[2])), batch["fold"].to_numpy(int)
            p = np.zeros((len(batch), w.shape[1]))
            for f in np.unique(k):
                p[k == f] = probabilities(x[k == f], w[f], counts[f])
            yield pd.DataFrame({"subject_id": batch["subject_id"], "target": batch["target"], "probability": list(p), "prediction": p.argmax(axis=1).astype(float), "fold": k})

    return rows.select("subject_id", "target", "fingerprint", "fold").mapInPandas(run, f"subject_id {rows.schema['subject_id'].dataType.simpleString()}, target double, probability array<double>, prediction double, fold int")
