"""Checks of the stationary model: the covariance of whole days against its harmonics, bootstrap of subjects, and components of offsets.

Matrices have 24 hours times the modes on a side, whatever the number of subjects.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayline.dataset import CurveSet
from dayline.functions import dense
from dayline.operators.estimators import Basis
from dayline.operators.partial import summed
from dayline.operators.spectral import DAYS
from dayline.schema import HOURS

#: Replicates of a bootstrap.
REPLICATES = 50


def all_spectra(lags: DataFrame) -> DataFrame:
    """r (0 to 12), m, n, re and im: the cyclic transform of lags 0 to 23 over all harmonics, not divided by 24. lags: lag, m, n, cov.

    Harmonics 0 and 12 are real; 13 to 23 are the conjugates of 11 to 1.
    """
    rows = lags.select("lag", "m", "n", "cov", F.explode(F.sequence(F.lit(0), F.lit(HOURS // 2))).alias("r"))
    angle = F.col("r") * F.col("lag") * (2 * math.pi / HOURS)
    return rows.groupBy("r", "m", "n").agg(F.sum(F.col("cov") * F.cos(angle)).alias("re"), (-F.sum(F.col("cov") * F.sin(angle))).alias("im"))


def block_figures(spectra: DataFrame) -> DataFrame:
    """r, trace and norm of each harmonic's block, the norm by Frobenius."""
    trace = F.sum(F.when(F.col("m") == F.col("n"), F.col("re")).otherwise(0.0)).alias("trace")
    return spectra.groupBy("r").agg(trace, F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).alias("norm"))


def circulant(lags: DataFrame, modes: int) -> np.ndarray:
    """The covariance of a day under stationarity, hour by hour: block (h, g) is the covariance at lag g - h."""
    at = np.zeros((HOURS, modes, modes))
    for x in lags.collect():  # 24 x modes x modes
        at[x["lag"], x["m"], x["n"]] = x["cov"]
    h = np.arange(HOURS)
    return at[(h[None, :] - h[:, None]) % HOURS].transpose(0, 2, 1, 3).reshape(HOURS * modes, HOURS * modes)


def eigenvalues_both_ways(lags: DataFrame, modes: int) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues of the covariance of a day, from large to small: of the whole matrix, and as the union over harmonics."""
    whole = circulant(lags, modes)
    s = np.zeros((HOURS // 2 + 1, modes, modes), complex)
    for x in all_spectra(lags).collect():
        s[x["r"], x["m"], x["n"]] = complex(x["re"], x["im"])
    union = [v for r, block in enumerate(s) for v in np.linalg.eigvalsh((block + block.conj().T) / 2) for _ in range(1 if r in (0, HOURS // 2) else 2)]
    return np.linalg.eigvalsh((whole + whole.T) / 2)[::-1], np.sort(union)[::-1]


def surface(scores: DataFrame) -> DataFrame:
    """h, g, m, n, cov and k: the mean product of centred scores at two hours over the k subjects that have both, without stationarity.

    A subject's day is one bounded row; a task returns a row for each entry.
    """
    days = scores.groupBy("subject_id").agg(F.collect_list(F.struct("hour", "m", "centred")).alias("day"))
    days = days.select(*(F.col("day")[n].alias(n) for n in ("hour", "m", "centred")))  # an array of each field

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = counts = np.zeros((HOURS, 0, HOURS, 0))
        for batch in batches:
            for first in range(0, len(batch), DAYS):
                some = batch.iloc[first : first + DAYS]
                row = np.repeat(np.arange(len(some)), some["hour"].map(len))
                hour, m = np.concatenate(some["hour"].to_list()), np.concatenate(some["m"].to_list())
                size = max(int(m.max()) + 1, sums.shape[1])
                x, seen = np.zeros((len(some), HOURS, size)), np.zeros((len(some), HOURS, size))
                x[row, hour, m], seen[row, hour, m] = np.concatenate(some["centred"].to_list()), 1
                wider = [(0, 0), (0, size - sums.shape[1])] * 2
                sums = np.pad(sums, wider) + np.tensordot(x, x, axes=(0, 0))
                counts = np.pad(counts, wider) + np.tensordot(seen, seen, axes=(0, 0))
        at = np.nonzero(counts)
        yield pd.DataFrame({"h": at[0], "m": at[1], "g": at[2], "n": at[3], "s": sums[at], "k": counts[at]})

    found = days.mapInPandas(run, "h int, m int, g int, n int, s double, k double").groupBy("h", "g", "m", "n")
    return found.agg((F.sum("s") / F.sum("k")).alias("cov"), F.sum("k").cast("long").alias("k"))


def predicted_surface(spectra: np.ndarray) -> np.ndarray:
    """The covariance of a day that harmonics 1 to R predict; spectra (harmonic, mode, mode), over 24 as in the estimators."""
    h = np.arange(HOURS)
    turn = np.exp(2j * np.pi / HOURS * np.arange(1, len(spectra) + 1)[:, None, None] * (h[None, :] - h[:, None]))
    both = 2 * np.einsum("rhg,rmn->hmgn", turn, spectra).real
    return both.reshape(HOURS * spectra.shape[1], -1)


def agreement(found: DataFrame, spectra: np.ndarray) -> list[tuple[int, float, float, float]]:
    """k, the k-th eigenvalue of the surface and of its harmonic prediction, and the k-th principal angle between their leading subspaces.

    As many as the prediction has: two for each harmonic and mode.
    """
    modes = spectra.shape[1]
    whole = np.zeros((HOURS, modes, HOURS, modes))
    for x in found.collect():
        whole[x["h"], x["m"], x["g"], x["n"]] = x["cov"]
    whole = whole.reshape(HOURS * modes, -1)
    rank = 2 * spectra.shape[0] * modes
    a, u = dense.descending((whole + whole.T) / 2)
    b, v = dense.descending(predicted_surface(spectra))
    cosines = np.linalg.svd(u[:rank] @ v[:rank].T, compute_uv=False)
    return [(k, float(a[k]), float(b[k]), float(np.arccos(np.clip(cosines[k], -1, 1)))) for k in range(rank)]


def poisson_weights(keys: np.ndarray, replicates: int, seed: int = 0) -> np.ndarray:
    """Times that each subject is drawn in each replicate (subject, replicate): Poisson with mean 1, from a hash of both."""
    steps = np.array([math.exp(-1) / math.factorial(k) for k in range(20)]).cumsum()
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(steps, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(float)


def bootstrap(data: CurveSet, basis: Basis, replicates: int = REPLICATES, seed: int = 0) -> pd.DataFrame:
    """replicate, k, eigenvalue and angle (radians, to the k-th mode of ``basis``), of weighted shape modes over subjects drawn anew.

    All replicates come from one pass: a subject's sums count as often as it is drawn. The sums have replicates x scales^2 numbers.
    """
    s = len(data.scales)
    rows = data.packed().select(F.xxhash64("subject_id").alias("key"), F.flatten(F.transform("day", lambda x: x["curve"])).alias("values"))

    def part(batch: pd.DataFrame) -> np.ndarray:
        total = np.zeros((replicates, 1 + s + s * s))
        for first in range(0, len(batch), DAYS):
            some = batch.iloc[first : first + DAYS]
            own = np.empty((len(some), total.shape[1]))
            for i, values in enumerate(some["values"]):
                x = np.asarray(values, float).reshape(-1, s) - basis.mean
                own[i] = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
            total += poisson_weights(some["key"].to_numpy(), replicates, seed).T @ own
        return total.ravel()

    found = summed(rows, part, replicates * (1 + s + s * s)).reshape(replicates, -1)
    root, out = np.sqrt(basis.weights), []
    for b, v in enumerate(found):
        n, mean, products = v[0], v[1 : 1 + s], v[1 + s :].reshape(s, s)
        if n < 2:
            continue
        values, vectors = dense.descending((products - np.outer(mean, mean) / n) * root[:, None] * root / (n - 1), floor=0.0)
        for k, mode in enumerate(basis.modes):
            out.append((b, k, values[k], float(np.arccos(min(1.0, abs(vectors[k] @ (mode * root)))))))
    return pd.DataFrame(out, columns=["replicate", "k", "eigenvalue", "angle"])


def intervals(basis: Basis, drawn: pd.DataFrame, share: float = 0.95) -> list[tuple[int, float, float, float, float]]:
    """k, the eigenvalue, the ends of its interval, and the angle that the same share of replicates stays under."""
    low, high = (1 - share) / 2, (1 + share) / 2
    return [(int(k), float(basis.variances[k]), *map(float, g["eigenvalue"].quantile([low, high])), float(g["angle"].quantile(share))) for k, g in drawn.groupby("k")]


def offset_components(scores: DataFrame) -> DataFrame:
    """m, within, between and mean: variance components of subjects' mean scores by the method of moments.

    ``within`` is the pooled variance about subjects' means; ``between`` the variance of the means less what hours add to it, at least 0.
    """
    each = scores.groupBy("subject_id", "m").agg(F.count(F.lit(1)).alias("n"), F.avg("xi").alias("mean"), F.sum(F.col("xi") * F.col("xi")).alias("q"))
    rest = F.greatest(F.col("q") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
    sums = each.groupBy("m").agg((F.sum(rest) / (F.sum("n") - F.count(F.lit(1)))).alias("within"), F.var_samp("mean").alias("v"), F.avg(1 / F.col("n")).alias("per"), F.avg("mean").alias("mean"))
    return sums.select("m", "within", F.greatest(F.col("v") - F.col("within") * F.col("per"), F.lit(0.0)).alias("between"), "mean")


def shrunk_offsets(scores: DataFrame) -> DataFrame:
    """subject_id, m, offset and shrunk: each mean score moved towards the mean of all by between / (between + within / hours)."""
    each = scores.groupBy("subject_id", "m").agg(F.count(F.lit(1)).alias("n"), F.avg("xi").alias("offset"))
    at = each.join(F.broadcast(offset_components(scores)), "m")  # a row for each mode
    share = F.col("between") / (F.col("between") + F.col("within") / F.col("n"))
    return at.select("subject_id", "m", "offset", (F.col("mean") + F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * (F.col("offset") - F.col("mean"))).alias("shrunk"))


def circadian_mean(scores: DataFrame, harmonics: int = 2, period: float = 24.0) -> DataFrame:
    """m, r, a and b: harmonics of the population's scores by least squares on a level and harmonics, over all rows; r 0 is the level.

    The normal equations of the hours are one small matrix a mode.
    """
    names = ["one", *(f"{f}{r}" for r in range(1, harmonics + 1) for f in "cs")]
    angle = lambda r: F.col("hour") * (2 * math.pi * r / period)
    at = scores.withColumn("one", F.lit(1.0))
    for r in range(1, harmonics + 1):
        at = at.withColumns({f"c{r}": F.cos(angle(r)), f"s{r}": F.sin(angle(r))})
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names for b in [*names, "xi"]]
    out = []
    for row in at.groupBy("m").agg(*cells).collect():  # a row for each mode
        g = np.array([[row[f"{a}_{b}"] for b in names] for a in names])
        x = np.linalg.lstsq(g, np.array([row[f"{a}_xi"] for a in names]), rcond=None)[0]
        out += [(row["m"], 0, float(x[0]), 0.0)] + [(row["m"], r, float(x[2 * r - 1]), float(x[2 * r])) for r in range(1, harmonics + 1)]
    return scores.sparkSession.createDataFrame(out, "m int, r int, a double, b double")


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row, nmi: mutual information of two labels over the mean of their entropies; 1 if both are constant."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    entropy = lambda n: -F.sum(F.col(n) / F.col("t") * F.log(F.col(n) / F.col("t")))
    total = both.agg(F.sum("n").alias("t"))
    h = [both.groupBy(c).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).agg(entropy("n").alias(f"h{i}")) for i, c in enumerate((a, b))]
    joint = both.crossJoin(F.broadcast(total)).agg(entropy("n").alias("h2"))
    every = joint.crossJoin(h[0]).crossJoin(h[1])  # one row each
    mean = (F.col("h0") + F.col("h1")) / 2
    return every.select(F.when(mean <= 0, F.when(F.col("h2").isNotNull(), 1.0)).otherwise((F.col("h0") + F.col("h1") - F.col("h2")) / mean).alias("nmi"))


def class_scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """label, precision, recall and f1 of each class that occurs; a figure without cases is 0."""
    counts = rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    each = counts.select(F.inline(F.array(F.struct(F.col(truth).alias("label"), "n", F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), "n", F.lit(0).alias("t"), F.lit(1).alias("p")))), (F.col(truth) == F.col(predicted)).alias("hit"))
    sums = each.groupBy("label").agg(F.sum(F.col("n") * F.col("t")).alias("t"), F.sum(F.col("n") * F.col("p")).alias("p"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("t")).otherwise(0)).alias("h"))
    part = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    h, t, p = F.col("h"), F.col("t"), F.col("p")
    return sums.select("label", part(h, p).alias("precision"), part(h, t).alias("recall"), part(2 * h, t + p).alias("f1"))


def twin_matches(first: DataFrame, second: DataFrame, block: int = 2048) -> DataFrame:
    """subject_id, twin, cosine and matched: for each fingerprint of ``first`` the nearest of ``second`` by cosine (ties: the smaller id), and whether
    it is the subject's own. The stability of fingerprints is the share of matches when the two are made from halves of the hours.

    Both sides are dealt to blocks, and blocks meet as products of matrices, each of which returns one candidate a row: the best of them wins.
    Every row meets every other in blocks; its shuffle grows with rows times blocks of the other side.
    """
    n = second.count()
    blocks = max(1, -(-n // block))

    def dealt(df: DataFrame, side: int) -> DataFrame:
        at = df.select("subject_id", "fingerprint", F.lit(side).alias("side"), F.pmod(F.xxhash64("subject_id"), F.lit(blocks)).cast("int").alias("own"))
        return at.select("subject_id", "fingerprint", "side", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"), "own")

    a = dealt(first, 0).select("subject_id", "fingerprint", "side", F.col("own").alias("i"), F.col("other").alias("j"))
    b = dealt(second, 1).select("subject_id", "fingerprint", "side", F.col("other").alias("i"), F.col("own").alias("j"))

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("subject_id", kind="stable")
        x, y = (group[group["side"] == s] for s in (0, 1))
        if not len(x) or not len(y):
            return pd.DataFrame({"subject_id": np.zeros(0, object), "twin": np.zeros(0, object), "cosine": np.zeros(0)})
        unit = lambda t: (m := np.stack(t["fingerprint"].to_numpy())) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        c = unit(x) @ unit(y).T
        at = c.argmax(axis=1)
        return pd.DataFrame({"subject_id": x["subject_id"].to_numpy(), "twin": y["subject_id"].to_numpy()[at], "cosine": c[np.arange(len(x)), at]})

    found = a.unionByName(b).groupBy("i", "j").applyInPandas(nearest, "subject_id string, twin string, cosine double")
    best = found.groupBy("subject_id").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "twin")).alias("x"))
    return best.select("subject_id", "x.twin", (-F.col("x.less")).alias("cosine"), (F.col("subject_id") == F.col("x.twin")).alias("matched"))


def by_hour_rank(data: CurveSet) -> tuple[CurveSet, CurveSet]:
    """The hours of each subject in two halves: its first, third, fifth, and the others."""
    place = F.row_number().over(Window.partitionBy("subject_id").orderBy("hour"))
    rows = data.observations.withColumn("place", place)
    return tuple(CurveSet(rows.where(F.col("place") % 2 == k).drop("place"), data.scales) for k in (1, 0))
