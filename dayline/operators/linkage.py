"""Outcomes from fingerprints: partial least squares, elastic net and ridge, chosen by nested folds.

Fingerprints are made without the outcome; only here do both meet. Every fit of every fold comes out of sums of products by (outer, inner) fold,
which one job gathers: no model reads the rows again. The sums have folds x (width of a fingerprint)^2 numbers, whatever the number of subjects.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayline.functions.curves import literal, total
from dayline.operators.evaluation import fold
from dayline.operators.partial import summed

# What each method tries. Strengths of elastic net are shares of the least one that leaves no coefficient.
SHARES = (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.001)
MIXES = (0.1, 0.5, 0.9, 1.0)
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
COMPONENTS = 10


@dataclass(frozen=True)
class Moments:
    """Count, means, covariance of the standardised fingerprint, its covariance with the target, and the scales it was divided by."""

    n: float
    mean: np.ndarray
    target: float
    scale: np.ndarray
    c: np.ndarray
    s: np.ndarray

    @staticmethod
    def of(sums: np.ndarray) -> Moments:
        """sums: products of the rows (1, fingerprint, target). A column without variance keeps coefficient 0."""
        n = sums[0, 0]
        mean = sums[0] / n
        c = sums / n - np.outer(mean, mean)
        v = np.diag(c)[1:-1]
        flat = v <= 1e-14 * np.maximum(np.diag(sums)[1:-1] / n, 1e-300)
        scale = np.where(flat, np.inf, np.sqrt(np.maximum(v, 1e-300)))
        return Moments(n, mean[1:-1], float(mean[-1]), scale, c[1:-1, 1:-1] / np.outer(scale, scale), c[1:-1, -1] / scale)

    def line(self, b: np.ndarray) -> np.ndarray:
        """Level and coefficients of the fingerprint as it is, from those of the standardised one."""
        plain = b / self.scale
        return np.concatenate([[self.target - self.mean @ plain], plain])


def partial_least_squares(m: Moments, components: int = COMPONENTS) -> list[tuple[str, np.ndarray]]:
    """Coefficients with 1, 2, ... components: each is the direction of most covariance with what is left of the target."""
    b, s, loadings, out = np.zeros(len(m.s)), m.s.copy(), [], []
    for a in range(min(components, len(m.s))):
        spread = s @ m.c @ s
        if np.linalg.norm(s) <= 1e-10 * max(np.linalg.norm(m.s), 1e-300) or spread <= 0:
            break
        r = s / np.sqrt(spread)
        p = m.c @ r
        for v in loadings:
            p = p - v * (v @ p)
        b = b + r * (r @ m.s)
        norm = np.linalg.norm(p)
        out.append((f"components={a + 1}", b))
        if norm <= 1e-12:
            break
        loadings.append(p / norm)
        s = s - loadings[-1] * (loadings[-1] @ s)
    return out or [("components=0", b)]


def elastic_net(m: Moments, mix: float, shares: tuple[float, ...] = SHARES, rounds: int = 10000, tolerance: float = 1e-10) -> list[tuple[str, np.ndarray]]:
    """Coefficients that minimise half the mean squared error plus strength x (mix x sum of sizes + (1 - mix) / 2 x sum of squares), by coordinate
    descent from strong to weak, each from where the last ended. A strength is a share of max |covariance| / mix."""
    top = np.abs(m.s).max(initial=0.0) / mix
    b, out, diagonal = np.zeros(len(m.s)), [], np.diag(m.c)
    for share in shares:
        strength = share * top
        for _ in range(rounds):
            most = 0.0
            for j in np.nonzero(diagonal > 0)[0]:
                pull = m.s[j] - m.c[j] @ b + diagonal[j] * b[j]
                after = np.sign(pull) * max(abs(pull) - strength * mix, 0.0) / (diagonal[j] + strength * (1 - mix))
                most, b[j] = max(most, abs(after - b[j])), after
            if most <= tolerance * max(1.0, np.abs(b).max()):
                break
        out.append((f"mix={mix:g} share={share:g}", b.copy()))
    return out


def ridge(m: Moments, alphas: tuple[float, ...] = ALPHAS) -> list[tuple[str, np.ndarray]]:
    return [(f"alpha={a:g}", np.linalg.solve(m.c + a / m.n * np.eye(len(m.s)), m.s)) for a in alphas]


#: Of each method, all candidates of one training set. The mean of the target is what the others have to beat.
METHODS: dict[str, Callable[[Moments], list[tuple[str, np.ndarray]]]] = {
    "mean": lambda m: [("", np.zeros(len(m.s)))],
    "ridge": ridge,
    "elastic_net": lambda m: [x for mix in MIXES for x in elastic_net(m, mix)],
    "partial_least_squares": partial_least_squares,
}


def squares(sums: np.ndarray, line: np.ndarray) -> float:
    """The summed squared error of a line over the rows that sums are of."""
    left = np.concatenate([-line, [1.0]])
    return float(left @ sums @ left)


def best(trains: list[np.ndarray], tests: list[np.ndarray], method: Callable) -> str | None:
    """The candidate of least summed error over pairs of training and test sums; the first of equal ones. One that not every training set has is out."""
    error: dict[str, float] = {}
    seen: dict[str, int] = {}
    for train, test in zip(trains, tests, strict=True):
        m = Moments.of(train)
        for name, b in method(m):
            error[name] = error.get(name, 0.0) + squares(test, m.line(b))
            seen[name] = seen.get(name, 0) + 1
    whole = {name: e for name, e in error.items() if seen[name] == len(trains)}
    return min(whole, key=whole.get) if whole else None


def taken(m: Moments, method: Callable, name: str | None) -> tuple[str, np.ndarray]:
    """The named candidate, or the last that there is (components may run out)."""
    found = method(m)
    return next((x for x in found if x[0] == name), found[-1])


@dataclass(frozen=True)
class Products:
    """Sums of products by (outer, inner) fold, about ``origin``, which is near the means so that no figure is lost."""

    cells: np.ndarray
    origin: np.ndarray


def products(rows: DataFrame, outer: int = 5, inner: int = 5, seed: int = 42, placed: DataFrame | None = None) -> Products:
    """rows: subject_id, fingerprint, target; rows with a null or non-finite number take no part. placed: subject_id, outer and inner, where folds are
    not hashed. One job for the width and means, one for all sums."""
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.select("subject_id", F.col("fingerprint").cast("array<double>").alias("fingerprint"), F.col("target").cast("double").alias("target"))
    rows = rows.where(number(F.col("target")) & F.coalesce(F.forall("fingerprint", number), F.lit(False)))
    long = rows.select("target", F.posexplode("fingerprint").alias("j", "v"))
    means = long.groupBy("j").agg(F.avg("v").alias("v"), F.avg("target").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("j").collect()  # a row for each place
    if not means or any(r["n"] != means[0]["n"] for r in means):
        raise ValueError("fingerprints with a target have to be there and of one length")
    origin = np.array([*(r["v"] for r in means), means[0]["y"]])
    size = len(origin) + 1
    if placed is None:
        at = rows.withColumns({"outer": fold(outer, seed), "inner": fold(inner, seed, 1)})
    else:
        at = rows.join(placed.select("subject_id", "outer", "inner"), "subject_id")

    def part(batch: pd.DataFrame) -> np.ndarray:
        x = np.column_stack([np.stack(batch["fingerprint"].to_numpy()), batch["target"].to_numpy(float)]) - origin
        x = np.column_stack([np.ones(len(x)), x])
        cell = batch["outer"].to_numpy(int) * inner + batch["inner"].to_numpy(int)
        out = np.zeros((outer * inner, size, size))
        for k in np.unique(cell):
            z = x[cell == k]
            out[k] = z.T @ z
        return out.ravel()

    cells = summed(at.select("fingerprint", "target", "outer", "inner"), part, outer * inner * size * size)
    return Products(cells.reshape(outer, inner, size, size), origin)


def nested(found: Products, methods: dict[str, Callable] | None = None) -> list[tuple[str, int, str, int, float, float]]:
    """method, fold, choice, n, mse and r2 on each outer fold: the choice is made by the inner folds of the other outer folds, the model
    fitted on all of them. r2 is against the mean of the fold itself; null where the fold's target does not vary. An outer fold without rows is left out."""
    every, out = found.cells.sum(axis=(0, 1)), []
    for name, method in (methods or METHODS).items():
        for o, cells in enumerate(found.cells):
            test, rest = cells.sum(axis=0), (found.cells.sum(axis=0) - cells)
            train = every - test
            if round(test[0, 0]) < 1 or round(train[0, 0]) < 2:
                continue
            kept = [i for i in range(len(rest)) if rest[i][0, 0] >= 1 and (train - rest[i])[0, 0] >= 2]
            choice, b = taken(m := Moments.of(train), method, best([train - rest[i] for i in kept], [rest[i] for i in kept], method))
            error = squares(test, m.line(b))
            around = test[-1, -1] - test[0, -1] ** 2 / test[0, 0]
            r2 = float(1 - error / around) if around > 1e-12 * max(test[-1, -1], 1e-300) else None
            out.append((name, o, choice, round(test[0, 0]), float(error / test[0, 0]), r2))
    return out


@dataclass(frozen=True)
class Linkage:
    """A level and a coefficient for each place of a fingerprint."""

    choice: str
    level: float
    coefficients: np.ndarray

    def prediction(self) -> Column:
        return total(F.zip_with("fingerprint", literal(self.coefficients), lambda a, b: a * b)) + self.level

    def predict(self, fingerprints: DataFrame) -> DataFrame:
        return fingerprints.select("subject_id", self.prediction().alias("prediction"))


def linked(found: Products, method: str = "elastic_net") -> Linkage:
    """The model of all rows, its candidate chosen by the inner folds over all rows."""
    each, every = found.cells.sum(axis=0), found.cells.sum(axis=(0, 1))
    kept = [x for x in each if x[0, 0] >= 1 and (every - x)[0, 0] >= 2]
    choice, b = taken(m := Moments.of(every), METHODS[method], best([every - x for x in kept], kept, METHODS[method]))
    line = m.line(b)
    return Linkage(choice, float(line[0] + found.origin[-1] - found.origin[:-1] @ line[1:]), line[1:])
