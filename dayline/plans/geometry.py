"""Queries over the geometry among fingerprints, which here are users' mean curves of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.operators import geometry
from dayline.plans.sql import LONG, events_set, longs
from dayline.sources import tables

#: Neighbours of a node in these queries.
NEAR = 8


def mean_curves(spark: SparkSession, d: str) -> DataFrame:
    return events_set(spark, d).observations.groupBy("subject_id").agg(F.array(*(F.avg(F.col("curve")[j]) for j in range(len(tables.EVENT_SCALES)))).alias("fingerprint"))


def q_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return geometry.neighbours(geometry.nodes(mean_curves(spark, d)), NEAR).select("node", "other", F.round("distance", 6).alias("distance"), *longs("rank"))


def q_degrees(spark: SparkSession, d: str) -> DataFrame:
    points = geometry.kept(geometry.nodes(mean_curves(spark, d)))
    edges = geometry.kept(geometry.kernel(geometry.neighbours(points, NEAR)))
    return geometry.degrees(points, edges).select("node", "w", F.round("q", 8).alias("q"), F.round("d", 8).alias("d"))


def q_map(spark: SparkSession, d: str) -> DataFrame:
    return geometry.diffusion_map(mean_curves(spark, d), k=NEAR)[0]


NEAREST = LONG + f""", fp AS (SELECT subject_id AS node, list(v ORDER BY m) AS x FROM (SELECT subject_id, m, avg(xi) AS v FROM obs GROUP BY ALL) GROUP BY ALL),
di AS (SELECT a.node, b.node AS other, list_distance(a.x, b.x) AS d FROM fp a JOIN fp b ON a.node <> b.node),
nn AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, other) AS rank FROM di QUALIFY rank <= {NEAR})
"""

REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "fingerprint_neighbours": (q_neighbours, NEAREST + "SELECT node, other, round(d, 6) AS distance, rank FROM nn"),
    "kernel_degrees": (
        q_degrees,
        NEAREST + """, sc AS (SELECT node, max(d) AS s FROM nn GROUP BY node), va AS (SELECT nn.node, other, exp(-d * d / (a.s * b.s)) AS v FROM nn JOIN sc a ON a.node = nn.node JOIN sc b ON b.node = nn.other),
ke AS (SELECT node AS i, other AS j, v FROM va UNION SELECT other, node, v FROM va), ku AS (SELECT i, j, max(v) AS v FROM ke GROUP BY ALL UNION ALL SELECT node, node, 1.0 FROM fp),
de AS (SELECT i, sum(v) AS q FROM ku GROUP BY i)
SELECT i AS node, 1.0::DOUBLE AS w, round(any_value(a.q), 8) AS q, round(sum(v / (a.q * b.q)), 8) AS d FROM ku JOIN de a USING (i) JOIN de b ON b.i = ku.j GROUP BY i""",
    ),
}

#: Eigenvectors, which SQL does not give; the tests hold them against dense algebra.
UNSTATED: dict[str, Callable[[SparkSession, str], DataFrame]] = {"diffusion_map": q_map}
