"""Centroid clustering by partial-distance search.

Vectors become integers, so every distance, sum and mean is exact. A round is one pass over the table: each task compares its
vectors with all centroids, dimension by dimension from the one of highest variance to the lowest, and gives up a centroid for
the vectors whose partial sum of squares is strictly above their best so far. What is never given up finishes all dimensions, so
the nearest centroid, and the smaller number among equals, is that of a full comparison. A task returns the sums of its clusters:
one row for each cluster and task, added up before the driver sees a row for each cluster. Centroids are k x 64 numbers
whatever the size of the table, so they go to the tasks with the code.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; repeated rows count
each; equal vectors may be several centroids, of which the smaller number takes all; with fewer than k vectors there are as many
centroids; a null vec_id is clustered but never a first centroid; without vectors the result is empty; further columns are ignored.
Components beyond 2^27 after scaling raise an error, since squared distances would not fit into a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.llm import common

SIZE, SCALE, LARGEST = 64, 256, 1 << 27
#: Dimensions added between two looks at who is left, and vectors compared at once.
STEP, ROWS = 8, 4096


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id and its integer components ``x``."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    scaled = F.transform("embedding", lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")))
    fits = F.forall("x", lambda c: F.abs(c) <= LARGEST)
    rows = vectors.where((F.size("embedding") == SIZE) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))
    return rows.select("vec_id", F.when(fits, F.col("x")).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).alias("x"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of the k smallest hashes of their ids, in that order; of equal ids the smaller vectors come first."""
    hashed = rows.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    return np.array([r["x"] for r in hashed.orderBy("h", "x").limit(k).collect()], np.int64).reshape(-1, SIZE)


def by_variance(rows: DataFrame) -> np.ndarray:
    """Dimensions from high to low variance over all vectors. The order saves work and never changes a result, so doubles do."""
    found = rows.agg(*(F.var_pop(F.col("x")[j]).alias(f"v{j}") for j in range(SIZE))).first()
    return np.argsort([-(v or 0.0) for v in found], kind="stable")


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, guess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of the nearest centroid of each row, its squared distance, and how many squares were added up.

    ``guess`` names a centroid to measure first, which makes for a low best from the start.
    """
    y, c = x[:, order], centroids[:, order]
    number = np.zeros(len(x), np.int64) if guess is None else guess.astype(np.int64)
    best = ((y - c[number]) ** 2).sum(axis=1)
    squares = y.size
    for at in range(len(c)):
        left = np.nonzero(number != at)[0]
        partial = np.zeros(len(left), np.int64)
        for first in range(0, SIZE, STEP):
            partial += ((y[left, first : first + STEP] - c[at, first : first + STEP]) ** 2).sum(axis=1)
            squares += len(left) * STEP
            going = partial <= best[left]
            left, partial = left[going], partial[going]
            if not len(left):
                break
        better = (partial < best[left]) | (at < number[left])
        best[left[better]], number[left[better]] = partial[better], at
    return number, best, squares


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
    for batch in batches:
        for first in range(0, len(batch), ROWS):
            some = batch.iloc[first : first + ROWS]
            yield some["vec_id"], np.stack(some["x"].to_list()).astype(np.int64)


def moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Centroids after a round: the floored means of their vectors. Empty ones stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts, guess = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64), 0
        for _, x in blocks(batches):
            number, _, _ = nearest(x, centroids, order, np.full(len(x), guess))
            np.add.at(sums, number, x)
            here = np.bincount(number, minlength=len(centroids))
            counts, guess = counts + here, int(here.argmax())
        seen = np.nonzero(counts)[0]
        yield pd.DataFrame({"cluster": seen, "n": counts[seen], "s": list(sums[seen])})

    found = rows.mapInPandas(run, "cluster int, n long, s array<long>")
    exact = [F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(SIZE)]
    after = centroids.copy()
    for r in found.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect():  # at most k rows
        after[r["cluster"]] = [int(r[f"s{j}"]) // r["n"] for j in range(SIZE)]
    return after


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2:") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of each vector after so many rounds, written as a table, and the final centroids."""
    rows = common.saved(kept(vectors), "centroid-vectors")
    centroids = first_centroids(rows, k, seed)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema), centroids
    order = by_variance(rows)
    for _ in range(rounds):
        centroids = moved(rows, centroids, order)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guess = 0
        for ids, x in blocks(batches):
            number, distance, _ = nearest(x, centroids, order, np.full(len(x), guess))
            guess = int(np.bincount(number).argmax())
            yield pd.DataFrame({"vec_id": ids.astype("Int64").array, "cluster": number, "distance": distance})

    out = common.saved(rows.mapInPandas(assigned, schema), "centroid-clusters")
    common.dropped(rows)
    return out, centroids


def centroid_hash(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's cluster, with the sums of squared distances of its cluster and of all, and a digest of its centroid."""
    found, centroids = clustered(common.table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    of = [(i, s, sum(sums.values()), centroid_hash(centroids[i])) for i, s in sorted(sums.items())]
    facts = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5) -> str:
    """The same by full comparison: a round is an assignment and a mean."""
    near = "{a} AS MATERIALIZED (SELECT vec_id, x, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT r, vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, {c}) GROUP BY r, vec_id, x)"
    mean = """{m} AS MATERIALIZED (SELECT cluster, coalesce(new.c, {c}.c) AS c FROM {c} LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c
FROM (SELECT cluster, j, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(range(64)) AS j, unnest(x) AS v FROM {a}) GROUP BY ALL) GROUP BY cluster) new USING (cluster))"""
    parts = [
        "WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x AS c FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM kept WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k}))",
    ]
    for i in range(rounds):
        parts += [near.format(a=f"a{i}", c=f"c{i}"), mean.format(m=f"c{i + 1}", a=f"a{i}", c=f"c{i}")]
    parts.append(near.format(a="last", c=f"c{rounds}"))
    parts.append("facts AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM last GROUP BY 1)")
    return (
        ",\n".join(parts)
        + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM facts) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM last JOIN facts USING (cluster) JOIN c{rounds} USING (cluster)"""
    )


SQL = _sql()
