"""Registered queries over streams of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.operators import sums
from dayline.plans.sql import EMB, longs
from dayline.streaming import fits

#: Lags and scales of the stated result: all lags, and each eighth scale.
EVERY = 8


def streamed(spark: SparkSession, d: str) -> fits.StreamedFit:
    """Vectors as a file stream of observations: a vector is an hour of a subject of 24 vectors, and its id the version."""
    # As a pattern, since a stream takes a plain path for a folder and the table may be one file.
    source = spark.readStream.schema(spark.read.parquet(f"{d}/embeddings.parquet").schema).parquet(f"{d}/embedding[s].parquet")
    rows = source.select(
        F.expr("CAST(vec_id DIV 24 AS STRING)").alias("subject_id"), F.expr("CAST(vec_id % 24 AS INT)").alias("hour"), F.col("vec_id").alias("version"),
        F.transform("embedding", lambda x: x.cast("double")).alias("curve"),
    )
    fit = fits.StreamedFit(fits.shared_folder(spark, "streamed-fit"), [float(j) for j in range(64)])
    fit.start(rows, availableNow=True).awaitTermination()
    return fit


def q_streamed_lags(spark: SparkSession, d: str) -> DataFrame:
    fit = streamed(spark, d)
    rows = [r for r in sums.lag_rows(fit.sums(spark), fit.layout) if r[1] % EVERY == 0 and r[2] % EVERY == 0]
    found = spark.createDataFrame(rows, "lag int, m int, n int, cov double")
    return found.select(*longs("lag", "m", "n"), (F.round("cov", 6) + 0).alias("cov"))


REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "streamed_lag_covariance": (
        q_streamed_lags,
        EMB + f""", obs AS (SELECT subject_id, hour, j, v - avg(v) OVER (PARTITION BY subject_id, j) AS c FROM p WHERE j % {EVERY} = 0),
each AS (SELECT a.subject_id, (b.hour - a.hour + 24) % 24 AS lag, a.j AS m, b.j AS n, avg(a.c * b.c) AS x FROM obs a JOIN obs b ON a.subject_id = b.subject_id GROUP BY ALL)
SELECT CAST(lag AS BIGINT) AS lag, CAST(m AS BIGINT) AS m, CAST(n AS BIGINT) AS n, round(avg(x), 6) + 0 AS cov FROM each WHERE lag <= 12 GROUP BY ALL""",
    ),
}
