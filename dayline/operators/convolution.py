"""Convolutional networks over two-channel curves, in numpy: an autoencoder, a regressor with attention over scales, and what it looks at.

Training is in small shuffled batches, by operators.training. Rows have subject_id, hour, the channels ``a`` and ``b`` (arrays of equal length), and
a target for the regressor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayline.functions import draws
from dayline.operators import evaluation, training
from dayline.operators.training import Schedule, Weights

#: Rows that a fitted network is applied to at once.
ROWS = 256
# Channels of the layers, width of a kernel, slope below zero.
WIDTHS, KERNEL, SLOPE = (16, 32, 64), 5, 0.01
HIDDEN, ATTENTION, DROPPED = 32, 16, 0.2
# Fixed values of augmentation: range of the factor, noise, places of a shift, share of scales set to zero.
FACTOR, NOISE, SHIFT, MASKED = (0.95, 1.05), 0.01, 3, 0.1
CHANNELS = ("a", "b")
# Schedules of the experiment's two stages, and of the pipeline's.
PRETRAINING, TUNING = Schedule(20, 64, 1e-3, 1e-5), Schedule(25, 16, 5e-4, 1e-4)
PIPELINE = (Schedule(25, 32, 1e-3), Schedule(30, 16, 5e-4, augment=False))


def augmented(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A channel's factor, noise, a common shift around the end, and a run of scales set to zero. x: (channel, scale)."""
    x = x * rng.uniform(*FACTOR, (len(x), 1)) + rng.standard_normal(x.shape) * NOISE
    x = np.roll(x, rng.integers(-SHIFT, SHIFT + 1), axis=1)
    run = int(x.shape[1] * MASKED)
    if run:
        start = rng.integers(0, max(1, x.shape[1] - run))
        x[:, start : start + run] = 0
    return x


def augmented_rows(x: np.ndarray, seeds: list[int]) -> np.ndarray:
    """augmented() of each row with a generator of its own seed: draws row by row, changes of all rows at once. x: (row, channel, scale)."""
    n, channels, length = x.shape
    factor, noise = np.empty((n, channels, 1)), np.empty(x.shape)
    shift, start = np.empty(n, int), np.zeros(n, int)
    run = int(length * MASKED)
    for i, rng in enumerate(draws.generators(seeds)):
        factor[i], noise[i] = rng.uniform(*FACTOR, (channels, 1)), rng.standard_normal((channels, length))
        shift[i] = rng.integers(-SHIFT, SHIFT + 1)
        if run:
            start[i] = rng.integers(0, max(1, length - run))
    places = np.arange(length)
    x = np.take_along_axis(x * factor + noise * NOISE, ((places - shift[:, None]) % length)[:, None, :], axis=2)
    hidden = (places >= start[:, None]) & (places < start[:, None] + run)
    return np.where(hidden[:, None, :], 0.0, x)


def inner(x: np.ndarray) -> np.ndarray:
    """(channel, place, row) of (row, channel, place): blocks lie in memory so, and a layer works on (channel, place * row)."""
    return x.transpose(1, 2, 0)


def outer(x: np.ndarray) -> np.ndarray:
    return x.transpose(2, 0, 1)


def laid_out(x: np.ndarray) -> np.ndarray:
    return outer(np.ascontiguousarray(inner(x)))


def under(tap: int, kernel: int, stride: int, n: int, places: int) -> tuple[slice, slice]:
    """Places of the output whose tap falls on one of n inputs, and those inputs."""
    off = tap - kernel // 2
    low, high = max(0, -(off // stride)), min(places, -((off - n) // stride))
    return slice(low, high), slice(low * stride + off, max(high - 1, low) * stride + off + 1, stride)


def windows(x: np.ndarray, kernel: int, stride: int, places: int) -> np.ndarray:
    """What the kernel sees at each place, zero beyond the ends: (channel * kernel, place * row). x: (channel, place, row)."""
    channels, n, rows = x.shape
    seen = np.empty((channels, kernel, places, rows))
    for i in range(kernel):
        there, own = under(i, kernel, stride, n, places)
        seen[:, i, : there.start] = 0
        seen[:, i, there.stop :] = 0
        seen[:, i, there] = x[:, own]
    return seen.reshape(channels * kernel, places * rows)


def overlaid(parts: np.ndarray, stride: int, n: int) -> np.ndarray:
    """The adjoint of windows: (channel, place, row) with n places. parts: (channel, kernel, place, row)."""
    channels, kernel, places, rows = parts.shape
    x = np.zeros((channels, n, rows))
    for i in range(kernel):
        there, own = under(i, kernel, stride, n, places)
        x[:, own] += parts[:, i, there]
    return x


def turned(k: np.ndarray) -> np.ndarray:
    """The kernel of the adjoint at stride 1, and back: (in, out, kernel) of (out, in, kernel), from its end."""
    return k.transpose(1, 0, 2)[:, :, ::-1]


class Tape:
    """Layers as they run forward, each with what it needs to send a gradient back. Blocks are (row, channel, place)."""

    def __init__(self, w: Weights, training: bool, rng: np.random.Generator | None = None):
        self.w, self.training, self.rng = w, training, rng
        self.grads: Weights = {}
        self.moments: Weights = {}
        self.backs: list[Callable[[np.ndarray], np.ndarray]] = []

    def conv(self, x: np.ndarray, name: str, stride: int = 1, first: bool = False) -> np.ndarray:
        """``first``: nothing before this layer asks for a gradient."""
        k, b = self.w[f"{name}.k"], self.w[f"{name}.b"]
        if stride == 1 and len(k) < k.shape[1] and not first:  # the adjoint's form holds the kernel's width times the fewer channels that come out
            return self.adjoint(x, name, turned(k), 1, turned)
        rows, n, flat = len(x), x.shape[2], k.reshape(len(k), -1)
        places = (n - 1) // stride + 1
        seen = windows(inner(x), k.shape[2], stride, places)  # one product for all rows and places
        y = flat @ seen
        y += b[:, None]

        def back(dy: np.ndarray) -> np.ndarray:
            out = inner(dy).reshape(len(k), places * rows)
            self.grads[f"{name}.k"] = (out @ seen.T).reshape(k.shape)
            self.grads[f"{name}.b"] = out.sum(axis=1)
            if first:
                return dy
            return outer(overlaid((flat.T @ out).reshape(k.shape[1], k.shape[2], places, rows), stride, n))

        self.backs.append(back)
        return outer(y.reshape(len(k), places, rows))

    def spread(self, x: np.ndarray, name: str, stride: int = 2) -> np.ndarray:
        """The adjoint of a strided convolution: twice as many places."""
        return self.adjoint(x, name, self.w[f"{name}.k"], stride)

    def adjoint(self, x: np.ndarray, name: str, k: np.ndarray, stride: int, kept: Callable[[np.ndarray], np.ndarray] = lambda k: k) -> np.ndarray:
        """k: (in, out, kernel); the layer's own kernel is ``kept`` of it."""
        b = self.w[f"{name}.b"]
        rows, n, flat = len(x), x.shape[2], k.reshape(len(k), -1)
        seen = inner(x).reshape(len(k), n * rows)
        y = overlaid((flat.T @ seen).reshape(k.shape[1], k.shape[2], n, rows), stride, stride * n)
        y += b[:, None, None]

        def back(dy: np.ndarray) -> np.ndarray:
            d = inner(dy)
            out = windows(d, k.shape[2], stride, n)
            self.grads[f"{name}.k"], self.grads[f"{name}.b"] = kept((seen @ out.T).reshape(k.shape)), d.reshape(len(d), -1).sum(axis=1)
            return outer((flat @ out).reshape(len(k), n, rows))

        self.backs.append(back)
        return outer(y)

    def settled(self, x: np.ndarray, name: str) -> np.ndarray:
        """Each channel less its mean, over its deviation, scaled and shifted; then leaky: few passes, most of them in place."""
        scale, shift = self.w[f"{name}.scale"], self.w[f"{name}.shift"]
        form = inner(x).shape
        flat = inner(x).reshape(form[0], -1)
        if self.training:
            mean = flat.mean(axis=1)
            away = flat - mean[:, None]
            var = np.vecdot(away, away) / flat.shape[1]
            self.moments[f"{name}.mean"], self.moments[f"{name}.var"] = mean, var
        else:
            mean, var = self.w[f"{name}.mean"], self.w[f"{name}.var"]
            away = flat - mean[:, None]
        root = 1 / np.sqrt(var + 1e-5)
        z = away * (root * scale)[:, None]
        z += shift[:, None]
        y = z * SLOPE
        np.maximum(z, y, out=y)

        def back(dy: np.ndarray) -> np.ndarray:
            d = np.maximum(y > 0, SLOPE)
            d *= inner(dy).reshape(flat.shape)
            along, total = np.vecdot(d, away) * root, d.sum(axis=1)
            self.grads[f"{name}.scale"], self.grads[f"{name}.shift"] = along, total
            if self.training:
                d -= away * (along * root / flat.shape[1])[:, None]
                d -= (total / flat.shape[1])[:, None]
            d *= (root * scale)[:, None]
            return outer(d.reshape(form))

        self.backs.append(back)
        return outer(y.reshape(form))

    def positive(self, x: np.ndarray) -> np.ndarray:
        there = x > 0
        self.backs.append(lambda dy: dy * there)
        return x * there

    def dropout(self, x: np.ndarray, share: float) -> np.ndarray:
        if not self.training or self.rng is None:
            return x
        kept = (self.rng.random(x.shape) >= share) / (1 - share)
        self.backs.append(lambda dy: dy * kept)
        return x * kept

    def linear(self, x: np.ndarray, name: str) -> np.ndarray:
        k, b = self.w[f"{name}.k"], self.w[f"{name}.b"]

        def back(dy: np.ndarray) -> np.ndarray:
            self.grads[f"{name}.k"], self.grads[f"{name}.b"] = x.T @ dy, dy.sum(axis=0)
            return dy @ k.T

        self.backs.append(back)
        return x @ k + b

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean over places under weights that sum to one, and the weights (row, place)."""
        k0, b0, k1, b1 = (self.w[f"att{n}"] for n in ("0.k", "0.b", "1.k", "1.b"))  # (in, units), (units, 1)
        v = inner(x)
        flat = v.reshape(len(v), -1)
        h = np.tanh(k0.T @ flat + b0[:, None])
        e = (k1[:, 0] @ h + b1[0]).reshape(v.shape[1:])
        p = np.exp(e - e.max(axis=0))
        p /= p.sum(axis=0)

        def back(dy: np.ndarray) -> np.ndarray:
            d = dy.T[:, None, :]
            dp = (v * d).sum(axis=0)
            de = (p * (dp - (dp * p).sum(axis=0))).ravel()
            self.grads["att1.k"], self.grads["att1.b"] = (h @ de)[:, None], np.array([de.sum()])
            dh = k1 * de * (1 - h * h)
            self.grads["att0.k"], self.grads["att0.b"] = flat @ dh.T, dh.sum(axis=1)
            dx = (k0 @ dh).reshape(v.shape)
            dx += d * p
            return outer(dx)

        self.backs.append(back)
        return (v * p).sum(axis=1).T, p.T

    def back(self, dy: np.ndarray, first: int = 0) -> np.ndarray:
        """The gradient before layer number ``first``."""
        for step in reversed(self.backs[first:]):
            dy = step(dy)
        return dy


def encoded(t: Tape, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The feature map, the last convolution's output, and the number of layers up to it."""
    for i in range(3):
        x = t.conv(x, f"conv{i}", 1 if i == 0 else 2, first=i == 0)
        if i == 2:
            last, at = x, len(t.backs)
        x = t.settled(x, f"norm{i}")
    return x, last, at


def decoded(t: Tape, x: np.ndarray, length: int) -> np.ndarray:
    for i in range(2):
        x = t.settled(t.spread(x, f"spread{i}"), f"back{i}")
    y = t.conv(x, "out")
    if more := y.shape[2] - length:
        t.backs.append(lambda dy: np.pad(dy, ((0, 0), (0, 0), (0, more))))
    return y[:, :, :length]


def regressed(t: Tape, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Predictions, attention, the last convolution's output, and the number of layers up to it."""
    features, last, at = encoded(t, x)
    context, attention = t.attend(features)
    y = t.linear(t.dropout(t.positive(t.linear(context, "head0")), DROPPED), "head1")
    return y[:, 0], attention, last, at


def first_weights(kind: str, channels: int = 2, seed: int = 42) -> Weights:
    """Uniform within one over the root of the inputs; moments 0 and 1."""
    rng, w = np.random.default_rng(seed), {}

    def layer(name: str, shape: tuple[int, ...], inputs: int, out: int) -> None:
        bound = inputs**-0.5
        w[f"{name}.k"], w[f"{name}.b"] = rng.uniform(-bound, bound, shape), rng.uniform(-bound, bound, out)

    def norm(name: str, n: int) -> None:
        w.update({f"{name}.scale": np.ones(n), f"{name}.shift": np.zeros(n), f"{name}.mean": np.zeros(n), f"{name}.var": np.ones(n)})

    before = channels
    for i, n in enumerate(WIDTHS):
        layer(f"conv{i}", (n, before, KERNEL), before * KERNEL, n)
        norm(f"norm{i}", n)
        before = n
    if kind == "autoencoder":
        for i, n in enumerate(WIDTHS[1::-1]):
            layer(f"spread{i}", (before, n, KERNEL), n * KERNEL, n)
            norm(f"back{i}", n)
            before = n
        layer("out", (channels, before, KERNEL), before * KERNEL, channels)
    else:
        layer("att0", (before, ATTENTION), before, ATTENTION)
        layer("att1", (ATTENTION, 1), ATTENTION, 1)
        layer("head0", (before, HIDDEN), before, HIDDEN)
        layer("head1", (HIDDEN, 1), HIDDEN, 1)
    return w


def channels_of(batch: pd.DataFrame) -> np.ndarray:
    return np.stack([np.stack(batch[c].to_numpy()) for c in CHANNELS], axis=1).astype(float)


def block_sums(kind: str, w: Weights, x: np.ndarray, y: np.ndarray | None, keys: np.ndarray | None, rng: np.random.Generator | None = None) -> tuple[float, Weights, Weights]:
    """Of a batch of rows: the summed loss, its gradients, and the moments of its norms. With keys inputs are augmented, with a generator units are dropped."""
    t = Tape(w, True, rng)
    seen = laid_out(x if keys is None else augmented_rows(x, [int(k) & (2**63 - 1) for k in keys]))
    x = laid_out(x)
    if kind == "autoencoder":
        features, _, _ = encoded(t, seen)
        error = decoded(t, features, x.shape[2]) - x
        per = x.shape[1] * x.shape[2]
        t.back(2 * error / per)
        return float((error**2).sum() / per), t.grads, t.moments
    error = regressed(t, seen)[0] - y
    t.back(2 * error[:, None])
    return float((error**2).sum()), t.grads, t.moments


def mapped(rows: DataFrame, of: Callable[[np.ndarray], dict[str, list]], schema: str) -> DataFrame:
    """subject_id, hour and the columns that of(channels) gives, block by block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                some = batch.iloc[a : a + ROWS]
                yield pd.DataFrame({"subject_id": some["subject_id"].to_numpy(), "hour": some["hour"].to_numpy()} | of(channels_of(some)))

    return rows.select("subject_id", "hour", *CHANNELS).mapInPandas(run, f"subject_id string, hour int, {schema}")


@dataclass(frozen=True)
class ConvAutoencoder:
    weights: Weights
    losses: tuple[float, ...] = ()

    def transform(self, rows: DataFrame) -> DataFrame:
        """subject_id, hour and fingerprint: the feature map averaged over its places."""
        w = self.weights
        return mapped(rows, lambda x: {"fingerprint": list(encoded(Tape(w, False), x)[0].mean(axis=2))}, "fingerprint array<double>")

    def reconstruct(self, rows: DataFrame) -> DataFrame:
        """subject_id, hour, a and b."""
        w = self.weights

        def of(x: np.ndarray) -> dict[str, list]:
            t = Tape(w, False)
            y = decoded(t, encoded(t, x)[0], x.shape[2])
            return {c: list(y[:, k]) for k, c in enumerate(CHANNELS)}

        return mapped(rows, of, "a array<double>, b array<double>")


@dataclass(frozen=True)
class ConvRegressor:
    weights: Weights
    losses: tuple[float, ...] = ()

    def predict(self, rows: DataFrame) -> DataFrame:
        """subject_id, hour, prediction and attention (weights over the places of the feature map)."""
        w = self.weights

        def of(x: np.ndarray) -> dict[str, list]:
            y, attention, _, _ = regressed(Tape(w, False), x)
            return {"prediction": y.tolist(), "attention": list(attention)}

        return mapped(rows, of, "prediction double, attention array<double>")

    def importance(self, rows: DataFrame) -> DataFrame:
        """subject_id, hour and importance of each scale, 0 to 1: the last convolution's channels, weighted by the mean gradient of the
        prediction, where positive, drawn out to the scales by straight lines."""
        w = self.weights
        return mapped(rows, lambda x: {"importance": list(looked_at(w, x))}, "importance array<double>")


def looked_at(w: Weights, x: np.ndarray) -> np.ndarray:
    t = Tape(w, False)
    y, _, last, at = regressed(t, x)
    grads = t.back(np.ones((len(y), 1)), first=at)
    cam = np.maximum((grads.mean(axis=2, keepdims=True) * last).sum(axis=1), 0)
    cam -= cam.min(axis=1, keepdims=True)
    cam /= cam.max(axis=1, keepdims=True) + 1e-8
    return drawn_out(cam, x.shape[2])


def drawn_out(values: np.ndarray, length: int) -> np.ndarray:
    """Rows of values at the middles of equal cells, read at the middles of ``length`` cells by straight lines."""
    n = values.shape[1]
    at = np.clip((np.arange(length) + 0.5) * n / length - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), max(n - 2, 0))
    part = at - low
    return values[:, low] * (1 - part) + values[:, np.minimum(low + 1, n - 1)] * part


def fit_conv_autoencoder(rows: DataFrame, schedule: Schedule = PRETRAINING) -> ConvAutoencoder:
    """Inputs are augmented, outputs are held against the inputs as they came."""
    w = first_weights("autoencoder", len(CHANNELS), schedule.seed)
    return ConvAutoencoder(*training.fitted(rows, CHANNELS, w, partial(block_sums, "autoencoder"), schedule).get(0, (w, ())))


def regressor_start(encoder: ConvAutoencoder | None, seed: int) -> Weights:
    """The encoder's layers, if given, start from its weights and are trained on."""
    w = first_weights("regressor", len(CHANNELS), seed)
    if encoder is not None:
        w |= {n: v for n, v in encoder.weights.items() if n in w and n.startswith(("conv", "norm"))}
    return w


def fit_conv_regressor(rows: DataFrame, encoder: ConvAutoencoder | None = None, schedule: Schedule = TUNING) -> ConvRegressor:
    w = regressor_start(encoder, schedule.seed)
    return ConvRegressor(*training.fitted(rows, CHANNELS, w, partial(block_sums, "regressor"), schedule, "target").get(0, (w, ())))


def fit_pipeline(curves: DataFrame, targets: DataFrame) -> tuple[ConvAutoencoder, ConvRegressor]:
    """Both stages one after the other: an encoder from all curves, and a regressor on it from those with a target, whose inputs are not augmented."""
    auto = fit_conv_autoencoder(curves, PIPELINE[0])
    return auto, fit_conv_regressor(targets, auto, PIPELINE[1])


def left_out(rows: DataFrame, folds: int, repeats: int) -> tuple[Column, Column]:
    """Of each row, the models that learn from it and those that leave it out. Model r * folds + f leaves out fold f of repeat r.

    Folds are hashed from subject_id, so that all hours of a subject are left out together.
    """
    own = [evaluation.fold(folds, repeat=r) + r * folds for r in range(repeats)]
    held = F.array(*own)
    return F.filter(F.sequence(F.lit(0), F.lit(folds * repeats - 1)), lambda k: ~F.array_contains(held, k)), held


def cross_validated(rows: DataFrame, encoder: ConvAutoencoder | None = None, folds: int = 5, repeats: int = 10, schedule: Schedule = TUNING) -> tuple[DataFrame, DataFrame]:
    """Figures of each fold of each repeat (rep_fold, mse, r2, pearson_r, spearman_rho), and rows left out with what their
    models say: rep_fold, subject_id, hour, target, prediction and importance of the scales. All models learn in the same jobs."""
    learns, held = left_out(rows, folds, repeats)
    w = regressor_start(encoder, schedule.seed)
    found = training.fitted(rows, CHANNELS, w, partial(block_sums, "regressor"), schedule, "target", learns, folds * repeats)
    weights = {k: v for k, (v, _) in found.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, group in batch.groupby("rep_fold"):
                for a in range(0, len(group) if k in weights else 0, ROWS):
                    some = group.iloc[a : a + ROWS]
                    x = channels_of(some)
                    yield some[["rep_fold", "subject_id", "hour", "target"]].assign(prediction=regressed(Tape(weights[k], False), x)[0], importance=list(looked_at(weights[k], x)))

    left = rows.select(F.explode(held).alias("rep_fold"), "subject_id", "hour", *CHANNELS, "target")
    left = left.repartition(folds * repeats, "rep_fold", "subject_id")  # rows come in few partitions, and each is asked of as many models as there are repeats
    said = left.mapInPandas(run, "rep_fold int, subject_id string, hour int, target double, prediction double, importance array<double>")
    figures = evaluation.grouped_regression(said.select("rep_fold", "target", "prediction"), "rep_fold")
    return figures.select("rep_fold", "mse", "r2", F.col("pearson").alias("pearson_r"), F.col("spearman").alias("spearman_rho")), said


def importance_panel(rows: DataFrame, looked: DataFrame, scales: list[float], channel: str = "a") -> DataFrame:
    """scale, the mean importance and the mean curve of a channel."""
    each = looked.select(F.posexplode("importance").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("importance"))
    curves = rows.select(F.posexplode(channel).alias("j", "v")).groupBy("j").agg(F.avg("v").alias("mean"))
    axis = F.array(*(F.lit(float(s)) for s in scales))
    return each.join(curves, "j").select(axis[F.col("j")].alias("scale"), "importance", "mean")
