"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Training runs by backpropagation through time on the driver, over a bounded sample of labelled rows: at most
``PER_LANGUAGE`` rows of each language, fewer where more than ``TRAINING`` in all would come together, and some of every language
however many there are. Prediction covers every byte of every text: each direction reads a text from one end to the other, and its state is
carried along all of it. Many texts are read side by side; long ones wait for others as long. Every position gets class probabilities from both
states, and a document's probabilities are the mean over its positions.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no labelled row everything is
``und``; equal probabilities go to the language first in order. Repeated rows are predicted each; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayline.llm import common

PER_LANGUAGE, TRAINING, LEAST_ROWS = 600, 60_000, 20
WINDOW = 96
#: Units in each direction; as many as there are languages, where these are more, up to the second number.
HIDDEN, MOST_HIDDEN = 10, 64
STEPS = 260
BATCH = 64
#: Positions whose class scores become probabilities at once, and texts that are read side by side, about.
STRETCH, LANES = 64, 4096
#: Bytes of texts that wait for each other, about, for 14 units and classes; and lengths that part short texts from long ones, which wait apart.
TOGETHER, LONG = 8 << 20, (4096, 16384)
LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class GatedNetwork:
    """One gated recurrent layer in each direction and a linear layer over both states at each position."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)

        def start(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = start(256, 3 * hidden, scale=0.3)
            self.p["u" + d] = start(hidden, 3 * hidden, scale=hidden**-0.5)
            self.p["o" + d] = start(hidden, classes, scale=hidden**-0.5)
        self.p["bias"] = np.zeros(classes, np.float32)

    def states(self, at: np.ndarray, d: str, keep: bool = False):
        """at: (steps, lanes) bytes. Hidden states (steps, lanes, hidden) in the order of steps, and what training needs."""
        h = self.hidden
        table, u = self.p["x" + d], self.p["u" + d]
        u_gates, u_new = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        steps, lanes = at.shape
        s = np.zeros((lanes, h), np.float32)
        out = np.empty((steps, lanes, h), np.float32)
        kept = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = table[at[t]]
            g = s @ u_gates
            g += x[:, : 2 * h]
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            z, r = g[:, :h], g[:, h:]
            rs = r * s
            n = rs @ u_new
            n += x[:, 2 * h :]
            np.tanh(n, out=n)
            if keep:
                kept.append((t, s, z, r, rs, n))
            s = n + z * (s - n)
            out[t] = s
        return out, kept

    def logits(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        return forward @ self.p["of"] + backward @ self.p["ob"] + self.p["bias"]

    def gradients(self, at: np.ndarray, label: np.ndarray, classes: int) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        h = self.hidden
        steps, lanes = at.shape
        runs = {d: self.states(at, d, keep=True) for d in "fb"}
        y = self.logits(runs["f"][0], runs["b"][0])
        y -= y.max(axis=2, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=2, keepdims=True)
        loss = -np.log(p[:, np.arange(lanes), label] + 1e-9).mean()
        p[:, np.arange(lanes), label] -= 1
        dy = p / (steps * lanes)
        flat = dy.reshape(-1, classes)
        g = {"bias": flat.sum(axis=0)}
        for d in "fb":
            out, kept = runs[d]
            g["o" + d] = out.reshape(-1, h).T @ flat
            back = dy @ self.p["o" + d].T
            u = self.p["u" + d]
            gu, gx = np.zeros_like(u), np.zeros_like(self.p["x" + d])
            ds = np.zeros((lanes, h), np.float32)
            for t, s, z, r, rs, n in reversed(kept):
                ds = ds + back[t]
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (s - n) * z * (1 - z)
                drs = dn @ u[:, 2 * h :].T
                dr = drs * s * r * (1 - r)
                gates = np.concatenate([dz, dr], axis=1)
                gu[:, 2 * h :] += rs.T @ dn
                gu[:, : 2 * h] += s.T @ gates
                np.add.at(gx, at[t], np.concatenate([gates, dn], axis=1))
                ds = ds * z + drs * r + gates @ u[:, : 2 * h].T
            g["u" + d], g["x" + d] = gu, gx
        return loss, g

    def train(self, windows: np.ndarray, label: np.ndarray, classes: int, steps: int = STEPS, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over random batches of windows (rows of bytes); the losses."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for i in range(1, steps + 1):
            rows = rng.integers(0, len(windows), BATCH)
            loss, g = self.gradients(np.ascontiguousarray(windows[rows].T), label[rows], classes)
            losses.append(float(loss))
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (size + 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                self.p[k] -= rate * (1 - i / (steps + 1)) * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.999**i)) + 1e-8)
        return losses

    @np.errstate(over="ignore")  # an exponential beyond the largest number is infinite, and its gate 0
    def pooled(self, raws: list[bytes]) -> np.ndarray:
        """Class probabilities of each byte string: the mean over all its positions.

        Strings of about one length run side by side, ``LANES`` at a time.
        """
        sizes = np.array([len(r) for r in raws], np.int64)
        order = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
        data = np.frombuffer(b"".join(raws), np.uint8)
        starts = np.cumsum(sizes) - sizes
        total = np.zeros((len(raws), len(self.p["bias"])))
        for some in np.array_split(order, -(-len(order) // LANES)) if len(order) else []:
            total[some] = self._summed(data, starts[some], sizes[some]).T
        return total / np.maximum(sizes, 1)[:, None]

    def _steps(self, d: str, lanes: int) -> Callable[[np.ndarray], np.ndarray]:
        """A function of inputs (bytes of the first n lanes) that moves the states of these lanes by one position and returns them.

        Lanes are rows, so that a byte's inputs are one run of memory and the first n lanes are too.
        New states are 2 / (1 + exp(-2 v)) - 1, which is tanh v, so that gates and they need one kind of function; signs and twos are in the weights.
        """
        h = self.hidden
        x, u = self.p["x" + d], self.p["u" + d]
        gate_inputs, gate_weights = (np.stack([-w[:, :h], -w[:, h : 2 * h]]) for w in (x, u))
        new_inputs, new_weights = (np.ascontiguousarray(-2 * w[:, 2 * h :]) for w in (x, u))
        states, held = np.zeros((lanes, h), np.float32), np.empty((6, lanes * h), np.float32)

        s = g = gx = c = cx = states[:0]

        def step(i: np.ndarray) -> np.ndarray:
            nonlocal s, g, gx, c, cx
            n = len(i)
            if n != len(s):
                s = states[:n]
                g, gx = (held[k : k + 2].reshape(-1)[: 2 * n * h].reshape(2, n, h) for k in (0, 2))
                c, cx = held[4, : n * h].reshape(n, h), held[5, : n * h].reshape(n, h)
            np.matmul(s, gate_weights, out=g)
            gate_inputs.take(i, axis=1, out=gx, mode="clip")
            g += gx
            np.exp(g, out=g)
            g += 1
            np.divide(s, g[1], out=cx)
            np.matmul(cx, new_weights, out=c)
            new_inputs.take(i, axis=0, out=cx, mode="clip")
            c += cx
            np.exp(c, out=c)
            c += 1
            np.divide(2, c, out=c)
            c -= 1
            s -= c
            s /= g[0]
            s += c
            return s

        return step

    def _summed(self, data: np.ndarray, low: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of class probabilities over all positions of strings, which begin at low and are given by falling length.

        Both directions go over the same positions of all strings, forth and then back, so a position's class scores lie at one place:
        going forth a string leaves after its end, going back it joins there, with a state of zero.
        """
        classes, longest = len(self.p["bias"]), int(lengths[0])
        reading = np.searchsorted(-lengths, -np.arange(longest), side="left").tolist()  # strings longer than a position
        place = np.concatenate([[0], np.cumsum(reading)]).tolist()
        y = np.empty((classes, place[-1]), np.float32)

        def read(first: int) -> np.ndarray:
            """Bytes of a stretch: a row for each position, a column for each string longer than the first."""
            at = low[: reading[first]] + np.arange(first, min(first + STRETCH, longest))[:, None]
            return data.take(at, mode="clip").astype(np.intp)

        step, out = self._steps("f", len(low)), np.ascontiguousarray(self.p["of"].T)
        for first in range(0, longest, STRETCH):
            for k, i in enumerate(read(first), first):
                np.matmul(out, step(i[: reading[k]]).T, out=y[:, place[k] : place[k + 1]])
        step, out = self._steps("b", len(low)), np.ascontiguousarray(self.p["ob"].T)
        total = np.zeros((classes, len(low)))
        for first in range((longest - 1) // STRETCH * STRETCH, -1, -STRETCH):
            last = min(first + STRETCH, longest)
            a = place[first]
            p = np.empty((classes, place[last] - a), np.float32)
            at = read(first)
            for k in range(last - 1, first - 1, -1):
                np.matmul(out, step(at[k - first, : reading[k]]).T, out=p[:, place[k] - a : place[k + 1] - a])
            p += y[:, a : place[last]]
            p += self.p["bias"][:, None]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            part = np.zeros((classes, reading[first]), np.float32)
            for k in range(first, last):
                part[:, : reading[k]] += p[:, place[k] - a : place[k + 1] - a]
            total[:, : reading[first]] += part
        return total


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def sampled(docs: DataFrame) -> DataFrame:
    """lang and a window of text of a bounded number of learnable rows of each language, those of the smallest row hashes.

    The rows of each language are counted first, and only rows under a hash bound that lets through a few times
    the sample are ranked, so the number of ranked rows does not depend on the size of the table.
    """
    text = F.col("text")
    width = 4 * WINDOW
    rows = docs.where(F.col("lang").isNotNull() & (F.length(text) > 0) & F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))
    counts = common.saved(rows.groupBy("lang").count(), "languages")  # one row a language: classes of the network, so few enough to broadcast
    each = max(min(PER_LANGUAGE, TRAINING // max(counts.count(), 1)), LEAST_ROWS)
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length(text) - width, F.lit(0)) + 1) + 1
    few = (
        rows.withColumn("at", at)
        .join(F.broadcast(counts), "lang")
        .where(F.col("at") * F.col("count") <= F.lit(float(1 << 40)) * 4 * each)
        .select("lang", F.substring(text, start.cast("int"), F.lit(width)).alias("part"), "at")
    )
    by = Window.partitionBy("lang").orderBy("at", "part")
    return few.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= each).drop("rank")


def learned(docs: DataFrame) -> tuple[list[str], GatedNetwork | None]:
    rows = sampled(docs).orderBy("lang", "at", "part").collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return [], None
    windows, label, weight = [], [], {}
    for r in rows:
        raw = r["part"].encode("utf-8", "replace")
        raw = raw if len(raw) >= WINDOW else (raw + b" ") * (WINDOW // len(raw) + 1)
        for a in range(0, min(len(raw) - WINDOW + 1, 3 * WINDOW), WINDOW):
            windows.append(np.frombuffer(raw[a : a + WINDOW], np.uint8))
            label.append(languages.index(r["lang"]))
    label = np.array(label)
    rng = np.random.default_rng(3)
    most = max(np.bincount(label))
    even = np.concatenate([rng.choice(np.flatnonzero(label == k), most) for k in range(len(languages))])  # every language as often
    net = GatedNetwork(len(languages), hidden=max(HIDDEN, min(len(languages), MOST_HIDDEN)))
    net.train(np.stack(windows)[even], label[even], len(languages))
    return languages, net


def identified(docs: DataFrame, languages: list[str], net: GatedNetwork | None) -> DataFrame:
    """doc_id, lang_pred and score of each row. Rows come back in another order than they went in."""

    def predicted(rows: list[tuple]) -> pd.DataFrame:
        p = net.pooled([raw for _, raw in rows])
        best = p.argmax(axis=1)
        return pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "lang_pred": [languages[k] for k in best], "score": np.clip(p[np.arange(len(best)), best], 0, 1)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = TOGETHER * 14 // (net.hidden + len(languages)) if net else 0
        waiting: list[list[tuple]] = [[] for _ in range(len(LONG) + 1)]
        size = [0] * len(waiting)
        for batch in batches:
            ids = batch["doc_id"].astype("Int64").array
            legible = np.array([net is not None and t is not None and LETTER.search(t) is not None for t in batch["text"]], bool)
            if not legible.all():
                yield pd.DataFrame({"doc_id": ids[~legible], "lang_pred": "und", "score": 0.0})
            for i in np.flatnonzero(legible):
                raw = batch["text"].iloc[i].encode("utf-8", "replace")
                at = bisect_right(LONG, len(raw))
                waiting[at].append((ids[i], raw))
                size[at] += len(raw)
                if size[at] >= most:
                    yield predicted(waiting[at])
                    waiting[at], size[at] = [], 0
        for rows in waiting:
            if rows:
                yield predicted(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def op3_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = identified(docs, *learned(docs))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
