"""Geometry among fingerprints: exact nearest neighbours, their kernel, and the diffusion map of its random walk.

Subjects with the same fingerprint, but for rounding, are one node whose weight is their number, so a large group of copies is merged before anything meets.
The kernel has k entries a node, and every further step is a product of it with columns: one join and one aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayline.operators.partial import summed
from dayline.streaming.fits import shared_folder

#: Neighbours of a node in the kernel.
NEIGHBOURS = 16
#: Nodes that a cell has on average, cells at most, and nodes of a cell that meet at once.
PER_CELL, CELLS, BLOCK = 256, 4096, 2048
#: Columns that the search for eigenvectors keeps before it starts anew from the best of them, and its steps at most.
COLUMNS, STEPS = 48, 60
#: Digits to which fingerprints are compared, of about 16 that a number has.
DIGITS = 13


def kept(df: DataFrame) -> DataFrame:
    """A table in the shared folder: lineage ends here, and so do estimates of sizes, which joins of a checkpoint would multiply step by step.

    It does not remember how rows were dealt, so a join of it shuffles.
    """
    path = f"{df.sparkSession.sparkContext.getCheckpointDir() or shared_folder(df.sparkSession, 'geometry')}/geometry-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alike(prints: DataFrame) -> DataFrame:
    """subject_id, fingerprint and key of the fingerprints that take part, written once; one that is null, empty or not finite takes no part.

    Fingerprints that differ by less than rounding have one key: sums come out a little different whenever rows come in another order. A key has
    DIGITS digits of the largest value of each component.
    """
    at = prints.select("subject_id", F.transform(F.col("fingerprint").cast("array<double>"), lambda x: x + 0.0).alias("fingerprint"))
    finite = F.forall("fingerprint", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    found = kept(at.where(F.col("subject_id").isNotNull() & (F.size("fingerprint") > 0) & finite))
    largest = found.select(F.posexplode("fingerprint").alias("j", "x")).groupBy("j").agg(F.max(F.abs("x")).alias("x")).orderBy("j").collect()  # a row for each component
    digits = [DIGITS - 1 - math.floor(math.log10(r["x"])) if r["x"] else 0 for r in largest]
    return found.withColumn("key", F.array(*(F.round(F.col("fingerprint")[j], d) for j, d in enumerate(digits))) if digits else F.col("fingerprint"))


def merged(found: DataFrame) -> DataFrame:
    """key, node (the smallest subject_id), its fingerprint and w, the subjects that have the key."""
    least = F.min(F.struct("subject_id", "fingerprint")).alias("least")
    return found.groupBy("key").agg(least, F.count(F.lit(1)).cast("double").alias("w")).select("key", F.col("least.subject_id").alias("node"), "least.fingerprint", "w")


def nodes(prints: DataFrame) -> DataFrame:
    """node (the smallest subject_id), fingerprint and w, the subjects that have it but for rounding."""
    return merged(alike(prints)).drop("key")


def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed dimension by dimension, so that both ways give the same number."""
    out = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T, strict=True):
        out += (a[:, None] - b[None, :]) ** 2
    return out


def met(asked: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """node, other and distance: the k nearest members of each cell that a node asks (ties: the smaller id).

    asked and members: node, fingerprint and cell. Both sides of a cell are dealt in parts, and parts meet as blocks.
    """
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    sizes = F.broadcast(parts(asked, "p").join(parts(members, "q"), "cell"))  # a row for each cell, CELLS at most

    def dealt(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        at = df.join(sizes, "cell").withColumn(f"{own}_at", F.pmod(F.xxhash64("node"), F.col(own)).cast("int"))
        at = at.withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return at.select("cell", "p_at", "q_at", "node", "fingerprint", F.lit(side).alias("side"))

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        x, y = (group[group["side"] == s] for s in (0, 1))
        empty = pd.DataFrame({"node": np.zeros(0, object), "other": np.zeros(0, object), "distance": np.zeros(0)})
        if not len(x) or not len(y):
            return empty
        d = between(*(np.stack(t["fingerprint"].to_numpy()) for t in (x, y)))
        own, other = x["node"].to_numpy(), y["node"].to_numpy()
        place = np.minimum(np.searchsorted(other, own), len(other) - 1)
        same = other[place] == own
        d[np.nonzero(same)[0], place[same]] = np.inf
        last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        row, column = np.nonzero((d <= last[:, None]) & np.isfinite(d))
        if not len(row):
            return empty
        order = np.lexsort((column, d[row, column], row))
        row, column = row[order], column[order]
        first = np.searchsorted(row, row)  # where each row's own begin
        few = np.arange(len(row)) - first < k
        row, column = row[few], column[few]
        return pd.DataFrame({"node": own[row], "other": other[column], "distance": np.sqrt(d[row, column])})

    both = dealt(asked, "p", "q", 0).unionByName(dealt(members, "q", "p", 1))
    return both.groupBy("cell", "p_at", "q_at").applyInPandas(nearest, "node string, other string, distance double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("node").orderBy("distance", "other"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def neighbours(points: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """node, other, distance and rank: the k nearest other nodes of each by Euclidean distance, exactly (ties: the smaller id); all if there are fewer.

    Nodes belong to the cell of their nearest pivot. A node first asks its own cell, and then those that can hold one nearer than its k-th so far:
    a cell is out of reach by its radius, or by the plane half-way to its pivot. points: node and fingerprint, all of one width.
    """
    points = kept(points.select("node", "fingerprint"))
    cells = min(CELLS, math.ceil(points.count() / PER_CELL))
    if cells <= 1:
        whole = points.withColumn("cell", F.lit(0))
        return ranked(met(whole, whole, k), k)
    pivots = np.array([x["fingerprint"] for x in points.orderBy(F.xxhash64("node"), "node").limit(cells).collect()])  # CELLS rows at most

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 512):
                some = batch.iloc[first : first + 512].copy()
                d = between(np.stack(some["fingerprint"].to_numpy()), pivots)
                some["cell"] = d.argmin(axis=1).astype(np.int32)
                some["off"] = np.sqrt(d.min(axis=1))
                yield some

    at = kept(points.mapInPandas(own, "node string, fingerprint array<double>, cell int, off double"))
    radius, size = np.full(cells, -np.inf), np.zeros(cells, int)
    for x in at.groupBy("cell").agg(F.max("off").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radius[x["cell"]], size[x["cell"]] = x["radius"], x["n"]
    home = kept(ranked(met(at, at, k), k))
    reach = home.groupBy("node").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("reach"))
    apart = np.sqrt(between(pivots, pivots))

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 512):
                some = batch.iloc[first : first + 512]
                d = np.sqrt(between(np.stack(some["fingerprint"].to_numpy()), pivots))
                mine = some["cell"].to_numpy()
                reach = some["reach"].to_numpy(float, na_value=np.inf)
                # k others are no farther than the farthest ends of the cells that hold them
                far = np.where(size > 0, d + np.maximum(radius, 0), np.inf)
                order = far.argsort(axis=1)
                enough = (size[order].cumsum(axis=1) > k).argmax(axis=1)
                rows = np.arange(len(some))
                certain = np.where(size.sum() > k, far[rows, order[rows, enough]], np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.nan_to_num((d**2 - d[rows, mine][:, None] ** 2) / (2 * apart[mine]), nan=0.0, posinf=0.0, neginf=0.0)
                least = np.maximum(d - radius, plane) * (1 - 1e-9) - 1e-12 * d
                go = (least <= np.minimum(reach, certain)[:, None]) & (size > 0)
                go[rows, mine] = False
                row, cell = np.nonzero(go)
                yield pd.DataFrame({"node": some["node"].to_numpy()[row], "fingerprint": some["fingerprint"].to_numpy()[row], "cell": cell.astype(np.int32)})

    asks = at.join(reach, "node", "left").select("node", "fingerprint", "cell", "reach")
    asked = kept(asks.mapInPandas(further, "node string, fingerprint array<double>, cell int"))
    return ranked(home.drop("rank").unionByName(met(asked, at, k)), k)


def kernel(near: DataFrame) -> DataFrame:
    """i, j and value: exp(-distance^2 / (s_i s_j)) of each pair of which one is among the other's nearest, both ways; s is the distance to the last neighbour.

    The value of a node with itself is 1 and has no row. near: node, other and distance.
    """
    near = kept(near.select("node", "other", "distance"))  # read three times
    scale = near.groupBy("node").agg(F.max("distance").alias("s"))
    at = near.join(scale, "node").join(scale.select(F.col("node").alias("other"), F.col("s").alias("t")), "other")
    value = F.exp(-F.col("distance") * F.col("distance") / (F.col("s") * F.col("t")))
    pair = F.array(F.struct(F.col("node").alias("i"), F.col("other").alias("j"), value.alias("value")), F.struct(F.col("other").alias("i"), F.col("node").alias("j"), value.alias("value")))
    return at.select(F.inline(pair)).groupBy("i", "j").agg(F.max("value").alias("value"))


def applied(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """The kernel times each column: node, and for every other column its sum over neighbours and the node itself."""
    names = [c for c in columns.columns if c != "node"]
    across = edges.join(columns, edges["j"] == columns["node"]).select(F.col("i").alias("node"), *((F.col("value") * F.col(c)).alias(c) for c in names))
    return across.unionByName(columns).groupBy("node").agg(*(F.sum(c).alias(c) for c in names))


def degrees(points: DataFrame, edges: DataFrame, alpha: float = 1.0) -> DataFrame:
    """node, w, q and d: the density q of each node under the kernel, and its degree d once values are divided by the densities of both ends to the power alpha."""
    q = applied(edges, points.select("node", "w")).withColumnRenamed("w", "q")
    at = points.select("node", "w").join(q, "node")
    d = applied(edges, at.select("node", (F.col("w") * F.col("q") ** -alpha).alias("d")))
    return at.join(d, "node").select("node", "w", "q", (F.col("q") ** -alpha * F.col("d")).alias("d"))


@dataclass
class Spectrum:
    """Eigenvalues of the walk from large to small without the constant one, their residuals, and the steps that were taken."""

    values: np.ndarray
    residuals: np.ndarray
    steps: int


def combined(columns: Column, weights: np.ndarray) -> Column:
    """A sum of the array's entries with these weights."""
    return F.aggregate(F.zip_with(columns, F.array(*map(F.lit, weights.tolist())), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def mixed(state: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """node, u and arrays of combinations of a node's columns q and images s, one for each column of the weights, which have a row for each of q, or of both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                q, s = (np.stack(batch[c].to_numpy()) for c in ("q", "s"))
                of = {"q": q, "s": s, "z": np.hstack([q, s])}
                yield pd.DataFrame({"node": batch["node"], "u": batch["u"], **{c: list(of[c] @ w) for c, w in weights.items()}})

    schema = f"node {state.schema['node'].dataType.simpleString()}, u double, " + ", ".join(f"{c} array<double>" for c in weights)
    return state.select("node", "u", "q", "s").mapInPandas(run, schema)


def ritz(gram: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, residual norms and weights (m, values) of the best vectors in the span of m columns without the first, which is the known eigenvector.

    gram holds all products of the m columns and their m images.
    """
    g, h = gram[:m, :m], gram[:m, m:]
    known = g[1:, 0]
    own, images = g[1:, 1:] - np.outer(known, known), h[1:, 1:] - np.outer(known, known)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    use = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    base = vectors[:, use] / np.sqrt(values[use])
    theta, turn = np.linalg.eigh(base.T @ ((images + images.T) / 2) @ base)
    a = (base @ turn)[:, ::-1]
    theta, a = theta[::-1], np.vstack([-known @ a, a])
    c = np.vstack([-a * theta, a])
    return theta, np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", c, gram, c), 0.0)), a


def diffusion_map(prints: DataFrame, components: int = 4, k: int = NEIGHBOURS, alpha: float = 1.0, time: float = 1.0, tolerance: float = 1e-6) -> tuple[DataFrame, Spectrum]:
    """subject_id and coordinates of each subject whose fingerprint takes part, and the spectrum.

    Coordinates are the leading right eigenvectors of the random walk on the kernel (without the constant), of mean square 1 under its stationary
    distribution, times their eigenvalue to the power ``time``; the largest absolute one of each is positive. Eigenvectors come from a block Lanczos
    search that starts anew from its best vectors: a step is one product with the kernel, which shuffles its k entries a node and the columns, and
    only products of columns reach the driver. It ends once
    the residuals of all components are under the tolerance, or after STEPS. With fewer than components + 1 nodes there are fewer coordinates.
    prints: subject_id and fingerprint, all of one width.
    """
    subjects = alike(prints)
    points = kept(merged(subjects))
    edges = kept(kernel(neighbours(points, k)))
    at = degrees(points, edges, alpha)
    total = at.agg(F.sum(F.col("w") * F.col("d"))).first()[0] or 1.0
    width = components + 2  # of a block
    start = F.array(*(F.xxhash64("node", F.lit(b)) / 2.0**63 for b in range(width)))
    known = F.array(F.sqrt(F.col("w") * F.col("d") / total))
    state = at.select("node", known.alias("q"), known.alias("s"), (F.sqrt("w") * F.col("q") ** -alpha / F.sqrt("d")).alias("u"), start.alias("z"))
    state = kept(state)
    block = state.select("node", "u", "z")
    theta, rest, a, m, step = np.zeros(0), np.zeros(0), np.zeros((1, 0)), 1, 0
    while True:
        step += 1
        columns = block.select("node", *((F.col("u") * F.col("z")[b]).alias(f"v{b}") for b in range(width)))
        joined = state.select("node", "u", "q", "s").join(block.select("node", "z"), "node").join(applied(edges, columns), "node")
        state = kept(joined.select("node", F.concat("q", "z").alias("q"), F.concat("s", F.array(*(F.col("u") * F.col(f"v{b}") for b in range(width)))).alias("s"), "u"))
        m += width

        def products(batch: pd.DataFrame) -> np.ndarray:
            x = np.hstack([np.stack(batch[c].to_numpy()) for c in ("q", "s")])
            return (x.T @ x).ravel()

        gram = summed(state.select("q", "s"), products, 4 * m * m).reshape(2 * m, 2 * m)
        theta, rest, a = ritz(gram, m)
        lead = slice(0, components)
        open_ = [b for b in range(min(components + 2, len(theta))) if rest[b] > tolerance / 10]
        if not len(theta) or (rest[lead] <= tolerance).all() or step >= STEPS:
            break
        # the next block: residuals of the best vectors, which the columns so far do not span
        nxt = np.vstack([-a[:, open_] * theta[open_], a[:, open_]]) / rest[open_]
        block, width = kept(mixed(state, {"z": nxt})), len(open_)
        if m + width > COLUMNS:
            best = np.hstack([np.eye(m, 1), a[:, : 2 * (components + 2)]])
            state, m = mixed(state, {"q": best, "s": best}), best.shape[1]
    a, theta, rest = a[:, :components], theta[:components], rest[:components]
    found = state.select("node", *(combined(F.col("q"), w).alias(f"x{b}") for b, w in enumerate(a.T)), F.col("q")[0].alias("known"))
    if len(theta):
        ends = found.agg(*(f(f"x{b}").alias(f"{n}{b}") for b in range(len(theta)) for n, f in (("low", F.min), ("high", F.max)))).first()
        sign = [1.0 if (ends[f"high{b}"] or 0.0) >= -(ends[f"low{b}"] or 0.0) else -1.0 for b in range(len(theta))]
    else:
        sign = []
    # an eigenvalue under 0 has no power that is not whole
    scale = [s * math.copysign(abs(t) ** time, t) for s, t in zip(sign, theta, strict=True)]
    spots = [F.col(f"x{b}") / F.col("known") * c for b, c in enumerate(scale)]
    placed = found.select("node", (F.array(*spots) if spots else F.array().cast("array<double>")).alias("coordinates"))
    spread = subjects.join(points.join(placed, "node"), "key")
    return spread.select("subject_id", "coordinates"), Spectrum(theta, rest, step)
