"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One pass turns each whole text into a short vector of statistics, transformed to be roughly normal (logs of
counts, log-odds of shares). The vectors are written once; class sums and products over all labelled rows are
grouped aggregates of them, so what reaches the driver is a few hundred numbers at any size. Each class
covariance is shrunk towards the pooled one and towards its diagonal, its Cholesky factor is kept, and a score is the
difference of the two Mahalanobis log-densities, tempered and squashed to 0..1.

Defined results: a null text is scored as the empty text; a document with several labels counts once with their
mean, ties as good; labels of other documents and null labels are left out; without both classes every
score is the share of good labels (0.5 without labels). Repeated rows are scored each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.llm import common

NAMES = (
    "log_chars", "log_words", "log_mean_word", "upper", "digit", "mark", "odd_mark", "space", "high_byte",
    "line_words", "repeat_words", "repeat_lines", "no_letter_words", "byte_entropy", "bar",
)
#: Share of the pooled covariance, share of its diagonal, and the factor on log-density differences.
POOL, DIAGONAL, TEMPER = 0.2, 0.1, 0.35
THRESHOLD = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = ~(_LETTER | _DIGIT | _SPACE)
_COMMON_MARK = np.zeros(256, bool)
_COMMON_MARK[[ord(c) for c in ".,;:'\"-?()"]] = True
_ODD = _MARK & ~_COMMON_MARK
_NOT_LETTERS = bytes(b for b in range(256) if not _LETTER[b])


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text; see NAMES."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    k, m = len(words), len(lines)
    letters = counts[_LETTER].sum()
    p = counts[counts > 0] / max(n, 1)

    def odds(part: float, whole: float) -> float:
        return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))

    spelled = sum(1 for w in words if not w.translate(None, _NOT_LETTERS) == b"")
    return np.array(
        [
            np.log1p(n), np.log1p(k), np.log1p(n / max(k, 1)),
            odds(counts[_UPPER].sum(), letters), odds(counts[_DIGIT].sum(), n), odds(counts[_MARK].sum(), n), odds(counts[_ODD].sum(), n),
            odds(counts[_SPACE].sum(), n), odds(counts[128:].sum(), n), np.log1p(k / max(m, 1)), odds(k - len(set(words)), k), odds(m - len(set(lines)), m),
            odds(k - spelled, k), float(-(p * np.log(p)).sum()) if n else 0.0, odds(counts[124], k),
        ]
    )


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of the two classes; share of good labels."""

    mean: np.ndarray
    factor: np.ndarray
    logdet: np.ndarray
    prior: float
    fitted: bool

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        density = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.factor[c].T
            density.append(-0.5 * (z * z).sum(axis=1) - 0.5 * self.logdet[c])
        at = TEMPER * (density[1] - density[0]) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(at, -30, 30)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], width: int) -> Discriminant:
    """sums: of each class its count, sum of vectors and sum of their outer products."""
    n = {c: sums[c][0] if c in sums else 0.0 for c in (0, 1)}
    if min(n.values()) < 2:
        total = n[0] + n[1]
        none = np.zeros((2, width))
        return Discriminant(none, np.zeros((2, width, width)), np.zeros(2), n[1] / total if total else 0.5, False)
    mean = np.array([sums[c][1] / n[c] for c in (0, 1)])
    own = np.array([sums[c][2] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    factors, logdets = [], []
    for c in (0, 1):
        s = (1 - POOL) * own[c] + POOL * pooled
        s = (1 - DIAGONAL) * s + DIAGONAL * np.diag(np.diag(s)) + 1e-4 * np.eye(width)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(mean, np.array(factors), np.array(logdets), n[1] / (n[0] + n[1]), True)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the array ``x`` of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "x": [statistics(t) for t in batch["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def learned(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """The discriminant of the labelled rows that are not held out."""
    width = len(NAMES)
    marked = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("class"))
    ).where(~held_out(F.col("doc_id")))
    rows = stats.join(marked, "doc_id")
    x = [F.col("x")[i] for i in range(width)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(width) for j in range(i, width)]
    sums = {}
    for row in rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(width)), *products).collect():
        outer = np.zeros((width, width))
        for i in range(width):
            for j in range(i, width):
                outer[i, j] = outer[j, i] = row[f"p{i}_{j}"]
        sums[row["class"]] = (float(row["n"]), np.array([row[f"s{i}"] for i in range(width)]), outer)
    return fit(sums, width)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and predicted of each row of docs."""
    stats = common.saved(with_statistics(docs), "quality-statistics")
    model = learned(stats, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = model.scores(np.stack(batch["x"].to_numpy())) if len(batch) else np.zeros(0)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": s, "predicted": (s >= THRESHOLD).astype("int32")})

    return stats.mapInPandas(run, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts. Each text is read twice, so that no text is shuffled."""
    model = learned(common.saved(with_statistics(docs), "quality-statistics"), labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    return docs.where(score(F.col("text").cast("string")) >= THRESHOLD)


def op9_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
