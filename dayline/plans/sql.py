"""SQL that several queries begin with, and the sets of curves that they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.dataset import CurveSet
from dayline.operators import spectral
from dayline.sources import tables


def events_set(spark: SparkSession, sf_dir: str) -> CurveSet:
    return CurveSet(tables.event_curves(spark, sf_dir), tables.EVENT_SCALES)


def complete_set(spark: SparkSession, sf_dir: str) -> CurveSet:
    """Users with events in all 24 hours."""
    return CurveSet(tables.complete_days(tables.event_curves(spark, sf_dir)), tables.EVENT_SCALES)


def event_scores(data: CurveSet) -> DataFrame:
    """Event curves in the canonical basis: a mode for each event type."""
    return spectral.centred(data.observations.select("subject_id", "hour", F.posexplode("curve").alias("m", "xi")))


def r6(c) -> Column:
    return F.round(c, 6)


def longs(*names: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in names]


LONG = """
WITH types AS (SELECT * FROM (VALUES ('click', 0), ('error', 1), ('purchase', 2), ('signup', 3), ('view', 4)) t(event_type, m)),
seen AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS subject_id, CAST(hour(ts) AS BIGINT) AS hour FROM events),
sums AS (SELECT CAST(user_id AS VARCHAR) AS subject_id, CAST(hour(ts) AS BIGINT) AS hour, event_type, sum(value) AS v FROM events GROUP BY ALL),
obs AS (SELECT s.subject_id, s.hour, t.m, coalesce(v.v, 0) AS xi FROM seen s CROSS JOIN types t
        LEFT JOIN sums v ON v.subject_id = s.subject_id AND v.hour = s.hour AND v.event_type = t.event_type),
cen AS (SELECT *, avg(xi) OVER (PARTITION BY subject_id, m) AS offs, xi - avg(xi) OVER (PARTITION BY subject_id, m) AS c FROM obs)
"""
PAIRS = LONG + """, prods AS (SELECT a.subject_id, (b.hour - a.hour + 24) % 24 AS lag, a.m, b.m AS n, a.c * b.c AS prod
        FROM cen a JOIN cen b ON a.subject_id = b.subject_id),
pooled AS (SELECT lag, m, n, avg(prod) AS cov FROM prods GROUP BY ALL),
two AS (SELECT lag, m, n, avg(p) AS cov FROM (SELECT subject_id, lag, m, n, avg(prod) AS p FROM prods GROUP BY ALL) GROUP BY ALL),
raw AS (SELECT r, m, n, sum(cov * cos(2 * pi() * r * lag / 24)) / 24 AS re, -sum(cov * sin(2 * pi() * r * lag / 24)) / 24 AS im
        FROM two CROSS JOIN (VALUES (1), (2)) h(r) GROUP BY ALL),
spec AS (SELECT s.r, s.m, s.n, (s.re + t.re) / 2 AS re, (s.im - t.im) / 2 AS im FROM raw s JOIN raw t ON s.r = t.r AND s.m = t.n AND s.n = t.m)
"""
EMB = """
WITH e AS (SELECT CAST(vec_id // 24 AS VARCHAR) AS subject_id, CAST(vec_id % 24 AS BIGINT) AS hour, embedding FROM embeddings),
p AS (SELECT subject_id, hour, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM e),
g AS (SELECT *, log10(5) + j * (log10(200) - log10(5)) / 63 AS s FROM p)
"""
#: The same over users with events in all 24 hours.
LONG_FULL = LONG.replace("obs AS (", "every AS (").replace("cen AS (", "obs AS (SELECT every.* FROM every JOIN (SELECT subject_id FROM seen GROUP BY 1 HAVING count(*) = 24) USING (subject_id)),\ncen AS (")
PAIRS_FULL = PAIRS.replace(LONG, LONG_FULL)
#: Least squares of complete days: a and b of each harmonic and type.
HARMONICS_FULL = """, co AS (SELECT subject_id, m, r, avg(xi) AS mesor, sum(xi * cos(2 * pi() * r * hour / 24)) / 12 AS a, sum(xi * sin(2 * pi() * r * hour / 24)) / 12 AS b FROM obs CROSS JOIN (VALUES (1), (2)) h(r) GROUP BY ALL)
"""
