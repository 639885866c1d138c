"""Mini-batch training by local steps, of one network or of many at once.

Rows are dealt to shards by the hash of their key. A shard is one group of bounded size: its rows are put in the order of their keys, shuffled
anew in each epoch by a generator of (seed, epoch, shard), and taken in small batches, each with an Adam step on the shard's own copy of
the weights. After an epoch the weights and moments of all shards are averaged by their rows and sent out again. While all rows fit into one
shard there is nothing to average, and all epochs run in one job: plain stochastic descent.

Shards, orders and seeds hang on keys only, and averages are added up in the order of shards, so that a fit does not depend on how rows lie in
partitions. (subject_id, hour) is the key; it is unique in a set of curves. Several models, as in cross-validation, train in the same
jobs: a row names the models that learn from it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Weights = dict[str, np.ndarray]
#: Rows of a shard about, and sums of a model that reach the driver at most.
SHARD, SUMS = 32768, 32
#: Partitions that groups are dealt to at most, and rows of a block of a shard.
MOST, ROWS = 2000, 2048
#: What a shard gives after its epochs: states and losses, times its rows.
STEPPED = "model int, part int, shard int, n long, v array<double>"
# Rates of the moments, and the momentum of running means and variances.
FIRST, SECOND, EPS, MOMENTUM = 0.9, 0.999, 1e-8, 0.1


@dataclass(frozen=True)
class Schedule:
    """``batch`` None takes a whole shard in each step."""

    epochs: int
    batch: int | None
    rate: float
    decay: float = 0.0
    augment: bool = True
    seed: int = 42


def is_moment(name: str) -> bool:
    return name.endswith((".mean", ".var"))


def packed(w: Weights) -> np.ndarray:
    return np.concatenate([v.ravel() for v in w.values()])


def unpacked(v: np.ndarray, like: Weights) -> Weights:
    ends = np.cumsum([x.size for x in like.values()])[:-1]
    return {n: part.reshape(x.shape) for (n, x), part in zip(like.items(), np.split(v, ends), strict=True)}


def local_steps(state: tuple[np.ndarray, ...], like: Weights, gradients: Callable, data: tuple, epochs: range, s: Schedule, shard: int = 0) -> tuple[tuple[np.ndarray, ...], list[float]]:
    """State (weights, first and second moments) after the epochs over one shard, and the mean loss of each.

    gradients(w, x, y, keys, rng) gives a batch's summed loss, gradients and norm moments; data is (x, y or None, keys) in the order of keys.
    """
    w, first, second = (v.copy() for v in state)
    x, y, keys = data
    g = np.empty_like(w)
    own, parts = unpacked(w, like), unpacked(g, like)
    running = np.flatnonzero(np.concatenate([np.full(v.size, is_moment(n)) for n, v in like.items()]))
    size = s.batch or len(x)
    step = epochs.start * -(-len(x) // size)
    losses = []
    for epoch in epochs:
        rng = np.random.default_rng([s.seed, epoch, shard])
        order, total = rng.permutation(len(x)), 0.0
        for i in range(0, len(x), size):
            at = order[i : i + size]
            loss, grads, moments = gradients(own, x[at], None if y is None else y[at], keys[at] + np.int64(epoch) if s.augment else None, rng)
            total += loss
            step += 1
            for n, part in parts.items():
                if n in grads:
                    np.divide(grads[n], len(at), out=part)
                else:
                    part[...] = moments[n]
            means = w[running] + MOMENTUM * (g[running] - w[running])
            if s.decay:
                g += s.decay * w
            g[running] = 0.0
            first *= FIRST
            first += (1 - FIRST) * g
            second *= SECOND
            g *= g
            g *= 1 - SECOND
            second += g
            root = np.sqrt(second / (1 - SECOND**step))
            root += EPS
            np.divide(first, root, out=root)
            root *= s.rate / (1 - FIRST**step)
            w -= root
            w[running] = means
        losses.append(total / len(x))
    return (w, first, second), losses


def fitted(
    rows: DataFrame, columns: tuple[str, ...], like: Weights, gradients: Callable, s: Schedule, target: str | None = None, models: Column | None = None, many: int = 1, shard_rows: int = SHARD
) -> dict[int, tuple[Weights, tuple[float, ...]]]:
    """Weights and the mean loss of each epoch, by model. rows: subject_id, hour, arrays ``columns`` and the target; ``models``: an array of
    numbers under ``many`` of the models that learn from a row (model 0 from every row if not given). A model without rows is not in the result.
    """
    shards = max(1, math.ceil(rows.count() / shard_rows))
    parts = min(shards, max(1, SUMS // many))
    places = min(MOST, shards * many)
    dealt = rows.select(
        "subject_id", "hour", *columns, *([target] if target else []), F.xxhash64("subject_id", "hour").alias("key"), F.explode(F.array(F.lit(0)) if models is None else models).alias("model")
    ).withColumn("shard", F.pmod(F.xxhash64("subject_id", "hour", F.lit(s.seed)), F.lit(shards)).cast("int"))
    # a partition for each shard of each model: hashes of so few keys would put several into one task
    dealt = dealt.withColumn("place", F.pmod(F.col("model") * shards + F.col("shard"), F.lit(places)).cast("int")).repartitionById(places, F.col("place"))
    grouped = dealt.groupBy("place", "model", "shard")
    start = packed(like)
    states: dict[int, tuple[np.ndarray, ...]] = {}
    losses: dict[int, list[float]] = {}

    def in_order(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        group = group.sort_values(["key", "subject_id", "hour"], kind="stable")
        x = np.stack([np.stack(group[c].to_numpy()) for c in columns], axis=1).astype(float)
        return x, group[target].to_numpy(float) if target else None, group["key"].to_numpy()

    def stepped(model: int, shard: int, data: tuple, epochs: range) -> pd.DataFrame:
        state, found = local_steps(states.get(model, (start, 0 * start, 0 * start)), like, gradients, data, epochs, s, shard)
        n = len(data[0])
        return pd.DataFrame({"model": [model], "part": [shard % parts], "shard": [shard], "n": [n], "v": [np.concatenate([*state, found]) * n]})

    def blocks(group: pd.DataFrame) -> pd.DataFrame:
        x, y, keys = in_order(group)
        each = [slice(a, a + ROWS) for a in range(0, len(x), ROWS)]
        return group[["model", "shard"]].iloc[: len(each)].assign(x=[x[i].tobytes() for i in each], y=[None if y is None else y[i].tobytes() for i in each], keys=[keys[i].tobytes() for i in each])

    def of_blocks(rows: list) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        x, keys = (np.frombuffer(b"".join(getattr(r, c) for r in rows), t) for c, t in (("x", float), ("keys", np.int64)))
        return x.reshape(len(keys), len(columns), -1), np.frombuffer(b"".join(r.y for r in rows)) if target else None, keys

    def added(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("shard")
        return pd.DataFrame({"model": group["model"].iloc[:1], "part": group["part"].iloc[:1], "n": [group["n"].sum()], "v": [np.sum(group["v"].to_list(), axis=0)]})

    def job(epochs: range) -> None:
        def local(group: pd.DataFrame) -> pd.DataFrame:
            return stepped(int(group["model"].iloc[0]), int(group["shard"].iloc[0]), in_order(group), epochs)

        def local_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for (model, shard), own in groupby((r for b in batches for r in b.itertuples()), key=lambda r: (int(r.model), int(r.shard))):
                yield stepped(model, shard, of_blocks(list(own)), epochs)

        each = grouped.applyInPandas(local, STEPPED) if kept is None else kept.mapInPandas(local_blocks, STEPPED)
        if shards > parts:
            each = each.groupBy("model", "part").applyInPandas(added, "model int, part int, n long, v array<double>")
        sums: dict[int, list] = {}
        for r in sorted(each.collect(), key=lambda r: (r["model"], r["part"])):  # at most SUMS rows, or one for each model
            n, v = sums.get(r["model"], (0, 0.0))
            sums[r["model"]] = (n + r["n"], v + np.array(r["v"]))
        for model, (n, v) in sums.items():
            *state, found = np.split(v / n, [len(start), 2 * len(start), 3 * len(start)])
            states[model] = tuple(state)
            losses.setdefault(model, []).extend(found.tolist())

    # what all epochs read is laid out once, in their order, and stays in its partitions; grouping kept rows would deal them anew in each epoch
    kept = None if shards == 1 else grouped.applyInPandas(blocks, "model int, shard int, x binary, y binary, keys binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for epochs in [range(s.epochs)] if shards == 1 else [range(e, e + 1) for e in range(s.epochs)]:
            job(epochs)
    finally:
        if kept is not None:
            kept.unpersist()
    return {m: (unpacked(states[m][0], like), tuple(losses[m])) for m in sorted(states)}
