"""Registered queries over the stand-in curves, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayline import schema
from dayline.functions.curves import mean_curvature, morphology, quadrature_weights
from dayline.operators import autoencoder, estimators, evaluation, spectral, two_level
from dayline.plans import containers, diagnostics, fixed_basis, geometry, outcomes, streams
from dayline.plans.sql import EMB, LONG, PAIRS, event_scores, events_set, r6
from dayline.sources import tables

HARMONICS, SHRINKAGE = 2, 0.25


def embedding_grid() -> list[float]:
    import math

    return [math.log10(5) + j * (math.log10(200) - math.log10(5)) / 63 for j in range(64)]


def q_summary(spark, d):
    return events_set(spark, d).summary().select("subjects", F.col("scales").cast("long").alias("scales"), "observations", r6("mean_hours").alias("mean_hours"))


def q_mean_curve(spark, d):
    return events_set(spark, d).mean_curve().select(F.col("j").cast("long").alias("j"), r6("mean").alias("mean"))


def q_subject_hours(spark, d):
    return events_set(spark, d).subject_sizes().select("subject_id", "n_hours")


def q_hour_membership(spark, d):
    return events_set(spark, d).has_hour(3).select("subject_id", F.col("has_hour").cast("int").alias("has_hour"))


def q_pairs(lag: int):
    def run(spark, d):
        return events_set(spark, d).observed_pairs(lag).select("subject_id", F.col("hour").cast("long").alias("hour"), r6(F.col("curve")[0]).alias("a"), r6(F.col("later")[0]).alias("b"))

    return run


def q_weights(spark, d):
    return spark.createDataFrame([(j, float(w)) for j, w in enumerate(quadrature_weights(tables.EVENT_SCALES))], "j long, w double")


def q_dense(spark, d):
    return events_set(spark, d).dense().groupBy("subject_id").agg(F.sum("mask").alias("seen"), F.count(F.lit(1)).alias("hours"))


def q_violations(spark, d):
    rows = tables.event_curves(spark, d).withColumn("hour", F.col("hour") + F.when(F.col("hour") == 23, 1).otherwise(0))
    return schema.violations(rows, 5).select("subject_id", F.col("hour").cast("long").alias("hour"), "rule")


def q_min_hours(spark, d):
    return tables.enough_hours(tables.event_curves(spark, d), 22).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))


def q_complete(spark, d):
    return tables.complete_days(tables.event_curves(spark, d)).select("subject_id").distinct()


def q_adults(spark, d):
    return tables.adults(tables.subjects(spark, d)).select("subject_id", r6("bnp").alias("bnp"))


def q_morphology(spark, d):
    rows = tables.embedding_curves(spark, d)
    found = morphology(F.col("curve"), embedding_grid())
    return rows.select("subject_id", F.col("hour").cast("long").alias("hour"), *(r6(c).alias(n) for n, c in found.items()), r6(mean_curvature(F.col("curve"), embedding_grid())).alias("curvature"))


def q_centred(spark, d):
    return event_scores(events_set(spark, d)).select("subject_id", F.col("hour").cast("long").alias("hour"), F.col("m").cast("long").alias("m"), r6("offset").alias("offs"), r6("centred").alias("c"))


def lag_rows(lags):
    return lags.select(*(F.col(c).cast("long").alias(c) for c in ("lag", "m", "n")), r6("cov").alias("cov"))


def q_lag_two(spark, d):
    return lag_rows(spectral.lag_covariance(event_scores(events_set(spark, d))))


def q_lag_pooled(spark, d):
    return lag_rows(spectral.lag_covariance(event_scores(events_set(spark, d)), pooled=True))


def q_lag_diagonal(spark, d):
    return lag_rows(spectral.lag_covariance(event_scores(events_set(spark, d)), pooled=True, diagonal=True))


def q_cross(spark, d):
    s = spectral.cross_spectra(spectral.lag_covariance(event_scores(events_set(spark, d))), HARMONICS)
    return s.select(*(F.col(c).cast("long").alias(c) for c in ("r", "m", "n")), r6("re").alias("re"), r6("im").alias("im"))


def q_shrunk(spark, d):
    s = spectral.shrunk(spectral.cross_spectra(spectral.lag_covariance(event_scores(events_set(spark, d))), HARMONICS), SHRINKAGE)
    return s.select(*(F.col(c).cast("long").alias(c) for c in ("r", "m", "n")), r6("re").alias("re"), r6("im").alias("im"))


def q_power(spark, d):
    lags = spectral.lag_covariance(event_scores(events_set(spark, d)), pooled=True, diagonal=True)
    s = spectral.shrunk_power(spectral.power_spectra(lags, HARMONICS), SHRINKAGE)
    return s.select(F.col("r").cast("long").alias("r"), F.col("m").cast("long").alias("m"), r6("psd").alias("psd"))


def q_cosinor(spark, d):
    rows = spectral.complete_day_harmonics(event_scores(events_set(spark, d)), HARMONICS)
    return rows.select("subject_id", F.col("m").cast("long").alias("m"), F.col("r").cast("long").alias("r"), r6("mesor").alias("mesor"), r6(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))).alias("amp"))


def q_visits(spark, d):
    rows = tables.event_curves(spark, d).withColumn("visit", F.row_number().over(Window.partitionBy("subject_id").orderBy("hour")))
    long = rows.select("visit", F.posexplode("curve").alias("m", "x"))
    return long.groupBy("visit", "m").agg(F.round(F.avg("x"), 8).alias("mean")).select(F.col("visit").cast("long").alias("visit"), F.col("m").cast("long").alias("m"), "mean")


S_DIAG = "SELECT lag, m, n, round(cov, 6) AS cov FROM "
REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "dataset_summary": (q_summary, LONG + "SELECT count(DISTINCT subject_id) AS subjects, 5 AS scales, count(*) AS observations, round(count(*) / count(DISTINCT subject_id), 6) AS mean_hours FROM seen"),
    "mean_curve": (q_mean_curve, LONG + "SELECT m AS j, round(avg(xi), 6) AS mean FROM obs GROUP BY m"),
    "subject_hours": (q_subject_hours, LONG + "SELECT subject_id, count(*) AS n_hours FROM seen GROUP BY 1"),
    "hour_membership": (q_hour_membership, LONG + "SELECT subject_id, CAST(max(CASE WHEN hour = 3 THEN 1 ELSE 0 END) AS INTEGER) AS has_hour FROM seen GROUP BY 1"),
    **{f"observed_pairs_lag{lag}": (q_pairs(lag), LONG + f"SELECT a.subject_id, a.hour, round(a.xi, 6) AS a, round(b.xi, 6) AS b FROM obs a JOIN obs b ON a.subject_id = b.subject_id AND b.hour = (a.hour + {lag}) % 24 AND a.m = 0 AND b.m = 0") for lag in (1, 6, 12, 23)},
    "quadrature_weights": (q_weights, "SELECT * FROM (VALUES (0, 0.5), (1, 1.0), (2, 1.5), (3, 3.0), (4, 2.0)) t(j, w)"),
    "dense_tensor_mask": (q_dense, LONG + "SELECT subject_id, count(*) AS seen, 24 AS hours FROM seen GROUP BY 1"),
    "obs_validate": (q_violations, LONG + "SELECT subject_id, 24 AS hour, 'hour_range' AS rule FROM seen WHERE hour = 23"),
    "min_hours_filter": (q_min_hours, LONG + "SELECT subject_id, count(*) AS n FROM seen GROUP BY 1 HAVING count(*) >= 22"),
    "complete_24h_semi": (q_complete, LONG + "SELECT subject_id FROM seen GROUP BY 1 HAVING count(*) = 24"),
    "adult_filter": (q_adults, "SELECT CAST(c_custkey AS VARCHAR) AS subject_id, round(c_acctbal, 6) AS bnp FROM customer WHERE c_nationkey >= 18"),
    "morph_bundle": (
        q_morphology,
        EMB + """, f AS (SELECT *, v - lag(v) OVER w AS d, lead(v) OVER w AS v1, lead(s) OVER w AS s1, min(v) OVER (PARTITION BY subject_id, hour) AS lo FROM g WHERE s <= log10(100) WINDOW w AS (PARTITION BY subject_id, hour ORDER BY j)),
h AS (SELECT subject_id, hour, 1 - sum(greatest(d, 0)) / sum(abs(d)) AS monotonicity, max(v) - min(v) AS dynamic_range, sum((v + v1) / 2 * (s1 - s)) AS auc, sum((v - lo) * s) / sum(v - lo) AS centroid, sum(v - lo) AS mass FROM f GROUP BY ALL),
en AS (SELECT f.subject_id, f.hour, -sum((v - lo) / mass * ln((v - lo) / mass + 1e-12)) AS entropy FROM f JOIN h USING (subject_id, hour) GROUP BY ALL),
k AS (SELECT *, v - lag(v) OVER (PARTITION BY subject_id, hour ORDER BY j) AS d, avg(v) OVER (PARTITION BY subject_id, hour) AS mu FROM g WHERE s BETWEEN log10(10) AND log10(30)),
co AS (SELECT subject_id, hour, -log10(sum(d * d) / sum((v - mu) * (v - mu))) AS coherence FROM k GROUP BY ALL),
cu AS (SELECT subject_id, hour, avg(abs(b)) AS curvature FROM (SELECT subject_id, hour, v - 2 * lag(v) OVER w + lag(v, 2) OVER w AS b FROM g WHERE s <= log10(100) WINDOW w AS (PARTITION BY subject_id, hour ORDER BY j)) GROUP BY ALL)
SELECT subject_id, hour, round(coherence, 6) AS coherence, round(monotonicity, 6) AS monotonicity, round(dynamic_range, 6) AS dynamic_range, round(auc, 6) AS auc, round(centroid, 6) AS centroid, round(entropy, 6) AS entropy, round(curvature, 6) AS curvature
FROM h JOIN en USING (subject_id, hour) JOIN co USING (subject_id, hour) JOIN cu USING (subject_id, hour)""",
    ),
    "score_centred": (q_centred, LONG + "SELECT subject_id, hour, m, round(offs, 6) AS offs, round(c, 6) AS c FROM cen"),
    "lagcov_two_level": (q_lag_two, PAIRS + S_DIAG + "two"),
    "lagcov_pooled": (q_lag_pooled, PAIRS + S_DIAG + "pooled"),
    "lagcov_diag": (q_lag_diagonal, PAIRS + S_DIAG + "pooled WHERE m = n"),
    "cross_spectra": (q_cross, PAIRS + "SELECT r, m, n, round(re, 6) AS re, round(im, 6) AS im FROM spec"),
    "shrink_diag": (q_shrunk, PAIRS + "SELECT r, m, n, round(CASE WHEN m = n THEN re ELSE 0.75 * re END, 6) AS re, round(CASE WHEN m = n THEN im ELSE 0.75 * im END, 6) AS im FROM spec"),
    "shrink_mean_floor": (q_power, PAIRS + ", pw AS (SELECT r, m, sum(cov * cos(2 * pi() * r * lag / 24)) / 24 AS psd FROM pooled CROSS JOIN (VALUES (1), (2)) h(r) WHERE m = n GROUP BY ALL) SELECT r, m, round(greatest(0.75 * psd + 0.25 * avg(psd) OVER (PARTITION BY r), 1e-6), 6) AS psd FROM pw"),
    "cosinor_24h": (
        q_cosinor,
        LONG + """, full24 AS (SELECT subject_id FROM seen GROUP BY 1 HAVING count(*) = 24)
SELECT subject_id, m, r, round(mesor, 6) AS mesor, round(sqrt(a * a + b * b), 6) AS amp FROM (SELECT subject_id, m, r, avg(xi) AS mesor, sum(xi * cos(2 * pi() * r * hour / 24)) / 12 AS a, sum(xi * sin(2 * pi() * r * hour / 24)) / 12 AS b FROM obs JOIN full24 USING (subject_id) CROSS JOIN (VALUES (1), (2)) h(r) GROUP BY ALL)""",
    ),
    "visit_means": (q_visits, LONG + ", v AS (SELECT *, row_number() OVER (PARTITION BY subject_id, m ORDER BY hour) AS visit FROM obs) SELECT visit, m, round(avg(xi), 8) AS mean FROM v GROUP BY ALL"),
}


def q_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variances of all weighted modes add up to the weighted variance of the curves."""
    found = estimators.fit_basis(events_set(spark, sf_dir), 3)
    return spark.createDataFrame([(float(found.all_variances.sum()),)], "total double").select(F.round("total", 4).alias("total"))


def q_spectral(what: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = events_set(spark, sf_dir)
        return getattr(estimators.fit_spectral(data, 3, HARMONICS, SHRINKAGE), what)(data)

    return run


def q_cosinor_fit(reconstruct: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: estimators.cosinor(events_set(spark, sf_dir), HARMONICS, reconstruct=reconstruct)


REGISTERED["shape_total_variance"] = (
    q_variance,
    LONG + ", w AS (SELECT * FROM (VALUES (0, 0.5), (1, 1.0), (2, 1.5), (3, 3.0), (4, 2.0)) t(m, w)) SELECT round(sum(w * v), 4) AS total FROM (SELECT m, var_samp(xi) AS v FROM obs GROUP BY 1) JOIN w USING (m)",
)


def q_harmonic(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = events_set(spark, sf_dir)
        return estimators.fit_harmonic(data, kind, 3, HARMONICS, SHRINKAGE).transform(data)

    return run


def q_two_level(what: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = events_set(spark, sf_dir)
        return getattr(two_level.fit_two_level(data), what)(data)

    return run


def q_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variances of all components within subjects add up to the variance of the residuals."""
    found = two_level.fit_two_level(events_set(spark, sf_dir), 1.0)
    return spark.createDataFrame([(float(found.within_variances.sum()),)], "total double").select(F.round("total", 4).alias("total"))


@lru_cache(maxsize=4)
def autoencoder_of(spark: SparkSession, sf_dir: str) -> autoencoder.Autoencoder:
    return autoencoder.fit_autoencoder(events_set(spark, sf_dir))


def q_autoencoder(what: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = events_set(spark, sf_dir)
        return getattr(autoencoder_of(spark, sf_dir), what)(data)

    return run


def q_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("cluster"))
    return evaluation.adjusted_rand(rows).select(F.round("adjusted_rand", 8).alias("adjusted_rand"))


def q_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("target"), F.col("l_linenumber").cast("double").alias("prediction"))
    found = evaluation.regression(rows)
    return spark.createDataFrame([(k, round(found[k], 6)) for k in ("mse", "mae", "r2", "pearson", "spearman")], "metric string, value double")


def q_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of the embeddings, clustered by their hour's third of the day."""
    rows = tables.embedding_curves(spark, sf_dir).select(F.concat_ws("/", "subject_id", "hour").alias("subject_id"), F.col("curve").alias("fingerprint"), F.floor(F.col("hour") / 8).cast("int").alias("cluster"))
    return evaluation.silhouette(rows).select(r6("silhouette").alias("silhouette"))


def q_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event hours beside the first positive order total of the customer with that key."""
    prints = events_set(spark, sf_dir).subject_sizes().select("subject_id", F.array(F.col("n_hours").cast("double")).alias("fingerprint"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("subject_id"), "o_totalprice", "o_orderkey")
    return evaluation.matched(prints, orders, "o_totalprice", "o_orderkey").select("subject_id", r6(F.col("fingerprint")[0]).alias("n_hours"), r6("target").alias("target"))


REGISTERED |= {
    "two_level_within_variance": (
        q_within,
        LONG + """, v AS (SELECT *, row_number() OVER (PARTITION BY subject_id, m ORDER BY hour) AS visit FROM obs),
cv AS (SELECT subject_id, m, xi - avg(xi) OVER (PARTITION BY visit, m) AS c FROM v), re AS (SELECT m, c - avg(c) OVER (PARTITION BY subject_id, m) AS e FROM cv)
SELECT round(sum(s), 4) AS total FROM (SELECT m, var_samp(e) AS s FROM re GROUP BY m)""",
    ),
    "adjusted_rand": (
        q_rand,
        """WITH t AS (SELECT c_mktsegment AS l, c_nationkey AS c, count(*) AS n FROM customer GROUP BY ALL),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS b, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY l)) AS p,
(SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY c)) AS q, (SELECT sum(n) * (sum(n) - 1) / 2 FROM t) AS w)
SELECT round((b - p * q / w) / ((p + q) / 2 - p * q / w), 8) AS adjusted_rand FROM s""",
    ),
    "regression_metrics": (
        q_regression,
        """WITH x AS (SELECT CAST(l_quantity AS DOUBLE) AS t, CAST(l_linenumber AS DOUBLE) AS p FROM lineitem),
k AS (SELECT t, p, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2 AS a, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS b FROM x),
f AS (SELECT avg((t - p) * (t - p)) AS mse, avg(abs(t - p)) AS mae, 1 - avg((t - p) * (t - p)) / var_pop(t) AS r2, corr(t, p) AS pearson, corr(a, b) AS spearman FROM k)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT f ON mse, mae, r2, pearson, spearman INTO NAME metric VALUE value)""",
    ),
    "silhouette": (
        q_silhouette,
        """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, (vec_id % 24) // 8 AS c FROM embeddings),
d AS (SELECT a.vec_id, a.c, b.c AS o, sum(list_distance(a.x, b.x)) AS d, count(*) AS n FROM e a, e b GROUP BY ALL),
s AS (SELECT vec_id, max(CASE WHEN o = c THEN d / (n - 1) END) AS i, min(CASE WHEN o <> c THEN d / n END) AS x FROM d GROUP BY 1)
SELECT round(avg((x - i) / greatest(x, i)), 6) AS silhouette FROM s""",
    ),
    "target_match": (
        q_matched,
        LONG + """, f AS (SELECT CAST(o_custkey AS VARCHAR) AS subject_id, arg_min(o_totalprice, o_orderkey) AS target FROM orders GROUP BY 1),
h AS (SELECT subject_id, count(*) AS n_hours FROM seen GROUP BY 1)
SELECT subject_id, CAST(n_hours AS DOUBLE) AS n_hours, round(target, 6) AS target FROM h JOIN f USING (subject_id)""",
    ),
}

#: Iterated or matrix results, which SQL does not give; the tests hold them against dense algebra.
UNSTATED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "spectral_posteriors": q_spectral("posteriors"),
    "spectral_fingerprint": q_spectral("transform"),
    "spectral_reconstruct": q_spectral("reconstruct"),
    "least_squares_fingerprint": q_harmonic("least_squares"),
    "diagonal_fingerprint": q_harmonic("diagonal"),
    "two_level_fingerprint": q_two_level("transform"),
    "two_level_reconstruct": q_two_level("reconstruct"),
    "autoencoder_fingerprint": q_autoencoder("transform"),
    "autoencoder_reconstruct": q_autoencoder("reconstruct"),
    "cosinor_fingerprint": q_cosinor_fit(False),
    "cosinor_reconstruct": q_cosinor_fit(True),
}
REGISTERED |= containers.REGISTERED | fixed_basis.REGISTERED | streams.REGISTERED | diagnostics.REGISTERED | outcomes.REGISTERED | geometry.REGISTERED
UNSTATED |= fixed_basis.UNSTATED | diagnostics.UNSTATED | outcomes.UNSTATED | geometry.UNSTATED
QUERIES = {name: run for name, (run, _) in REGISTERED.items()} | UNSTATED
ORACLE_SQL = {name: sql for name, (_, sql) in REGISTERED.items()}
