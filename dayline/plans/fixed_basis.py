"""Queries over modes that need no fit (unit vectors, cosines), so that SQL can say what estimators give; and those that it cannot."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.functions import dense
from dayline.operators import convolution, estimators, evaluation, panels, selection, spectral, two_level
from dayline.operators.estimators import Basis
from dayline.plans.sql import HARMONICS_FULL, LONG, LONG_FULL, PAIRS, PAIRS_FULL, complete_set, event_scores, events_set, longs
from dayline.sources import tables

SIZE, HARMONICS, SHRINKAGE = 5, 2, 0.25


def z6(c) -> F.Column:
    """To six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def fixed(modes: np.ndarray) -> Basis:
    return Basis(np.zeros(modes.shape[1]), modes, np.ones(len(modes)), np.ones(modes.shape[1]), np.ones(len(modes)))


UNIT, COSINES = fixed(np.eye(SIZE)), fixed(dense.cosine_modes(SIZE, 2))


def q_covariance(weighted: bool) -> Callable[[SparkSession, str], DataFrame]:
    """The sums that modes come from, over n - 1 with the roots of the weights, or over n."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        data = events_set(spark, d)
        mean = np.array([r["mean"] for r in data.mean_curve().orderBy("j").collect()])
        n, g = estimators.gram(data.observations, mean)
        root = np.sqrt(data.weights) if weighted else np.ones(SIZE)
        c = g * root[:, None] * root / (n - 1 if weighted else n)
        return spark.createDataFrame([(j, k, float(c[j, k])) for j in range(SIZE) for k in range(SIZE)], "j long, k long, cov double").select("j", "k", F.round("cov", 4).alias("cov"))

    return run


def q_plain_variance(spark: SparkSession, d: str) -> DataFrame:
    found = estimators.fit_basis(events_set(spark, d), 3, weighted=False).all_variances
    return spark.createDataFrame([(float(found.sum()), float((found**2).sum()))], "total double, squares double").select(F.round("total", 4).alias("total"), F.round(F.sqrt("squares"), 4).alias("norm"))


def q_project(spark: SparkSession, d: str) -> DataFrame:
    rows = events_set(spark, d).observations.select("subject_id", "hour", F.posexplode(COSINES.scores()).alias("m", "xi"))
    return rows.select("subject_id", *longs("hour", "m"), z6("xi").alias("xi"))


def q_back(spark: SparkSession, d: str) -> DataFrame:
    rows = estimators.mean_reconstruction(events_set(spark, d), COSINES).select("subject_id", "hour", F.posexplode("curve").alias("j", "v"))
    return rows.select("subject_id", *longs("hour", "j"), z6("v").alias("v"))


def q_mean_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = estimators.mean_fingerprint(events_set(spark, d), COSINES).select("subject_id", F.posexplode("fingerprint").alias("m", "v"))
    return rows.select("subject_id", *longs("m"), z6("v").alias("v"))


def q_offsets(spark: SparkSession, d: str) -> DataFrame:
    return event_scores(events_set(spark, d)).groupBy("subject_id", "m").agg(F.first("offset").alias("o")).select("subject_id", *longs("m"), z6("o").alias("offs"))


def q_design(spark: SparkSession, d: str) -> DataFrame:
    hours = tables.event_curves(spark, d).select("hour").distinct()
    rows = spectral.fourier_table(hours, HARMONICS).select("hour", F.explode(F.arrays_zip(F.array(F.lit(1), F.lit(2)).alias("r"), "c", "s")).alias("x"))
    return rows.select(F.col("hour").cast("long").alias("hour"), F.col("x.r").cast("long").alias("r"), z6("x.c").alias("c"), z6("x.s").alias("s"))


def q_residual(spark: SparkSession, d: str) -> DataFrame:
    data = complete_set(spark, d)
    found = estimators.mode_noise(data.observations.select("subject_id", "hour", UNIT.scores().alias("xi")), HARMONICS, 24.0)
    return spark.createDataFrame([(m, float(v)) for m, v in enumerate(found)], "m long, v double").select("m", F.round("v", 4).alias("v"))


def turned(prints: DataFrame, modes: int) -> DataFrame:
    """subject_id, m, r, offs, a and b from offsets, then amplitudes and phases of each harmonic: the phase is that of a - ib."""
    at = [F.struct(F.lit(m).alias("m"), F.lit(r + 1).alias("r"), F.col("fingerprint")[m].alias("offs"), F.col("fingerprint")[modes * (1 + 2 * r) + m].alias("amp"), F.col("fingerprint")[modes * (2 + 2 * r) + m].alias("phase")) for m in range(modes) for r in range(HARMONICS)]
    rows = prints.select("subject_id", F.inline(F.array(*at)))
    return rows.select("subject_id", *longs("m", "r"), z6("offs").alias("offs"), z6(F.col("amp") * F.cos("phase")).alias("a"), z6(-F.col("amp") * F.sin("phase")).alias("b"))


def q_cosinor(spark: SparkSession, d: str) -> DataFrame:
    return turned(estimators.cosinor(complete_set(spark, d), HARMONICS), SIZE)


def curves_long(rows: DataFrame) -> DataFrame:
    return rows.select("subject_id", "hour", F.posexplode("curve").alias("j", "v")).select("subject_id", *longs("hour", "j"), z6("v").alias("v"))


def q_cosinor_fitted(spark: SparkSession, d: str) -> DataFrame:
    return curves_long(estimators.cosinor(complete_set(spark, d), HARMONICS, reconstruct=True))


def q_orthogonality(spark: SparkSession, d: str) -> DataFrame:
    """Residuals of every subject, also with hours missing, are at right angles to the design: subjects and largest product, to three places."""
    data = events_set(spark, d)
    fitted = estimators.cosinor(data, HARMONICS, reconstruct=True).withColumnRenamed("curve", "fitted")
    both = spectral.fourier_table(data.observations.join(fitted, ["subject_id", "hour"]), HARMONICS)
    rest = F.zip_with("curve", "fitted", lambda a, b: a - b)
    each = both.select("subject_id", F.posexplode(rest).alias("j", "e"), F.array(F.lit(1.0), F.col("c")[0], F.col("s")[0], F.col("c")[1], F.col("s")[1]).alias("x"))
    products = each.groupBy("subject_id", "j").agg(F.greatest(*(F.abs(F.sum(F.col("e") * F.col("x")[k])) for k in range(5))).alias("p"))
    return products.agg(F.countDistinct("subject_id").alias("subjects"), (F.round(F.max("p"), 3) + F.lit(0.0)).alias("most"))


def q_plain_harmonics(spark: SparkSession, d: str) -> DataFrame:
    data = complete_set(spark, d)
    return turned(estimators.fit_harmonic(data, "least_squares", harmonics=HARMONICS, rotate=False, basis=UNIT).transform(data), SIZE)


def q_plain_fitted(spark: SparkSession, d: str) -> DataFrame:
    data = complete_set(spark, d)
    return curves_long(estimators.fit_harmonic(data, "least_squares", harmonics=HARMONICS, rotate=False, basis=UNIT).reconstruct(data))


def q_diagonal(spark: SparkSession, d: str) -> DataFrame:
    """Mode by mode, amplitude times the root of its power, and phase."""
    data = complete_set(spark, d)
    rows = estimators.fit_harmonic(data, "diagonal", harmonics=HARMONICS, shrinkage=SHRINKAGE, basis=UNIT).transform(data)
    at = [F.struct(F.lit(m).alias("m"), F.lit(r + 1).alias("r"), F.col("fingerprint")[m].alias("offs"), F.col("fingerprint")[SIZE + 2 * (HARMONICS * m + r)].alias("amp")) for m in range(SIZE) for r in range(HARMONICS)]
    return rows.select("subject_id", F.inline(F.array(*at))).select("subject_id", *longs("m", "r"), z6("offs").alias("offs"), F.round("amp", 4).alias("amp"))


def q_power(spark: SparkSession, d: str) -> DataFrame:
    found = spectral.power_spectra(spectral.lag_covariance(event_scores(events_set(spark, d)), pooled=True, diagonal=True), HARMONICS)
    return found.select(*longs("r", "m"), z6("psd").alias("psd"))


def q_plain_spectra(spark: SparkSession, d: str) -> DataFrame:
    s = spectral.cross_spectra(spectral.lag_covariance(event_scores(events_set(spark, d))), HARMONICS, symmetric=False)
    return s.select(*longs("r", "m", "n"), z6("re").alias("re"), z6("im").alias("im"))


def fitted(spark: SparkSession, d: str) -> estimators.SpectralModel:
    return estimators.fit_spectral(events_set(spark, d), SIZE, HARMONICS, SHRINKAGE, basis=UNIT)


def q_traces(spark: SparkSession, d: str) -> DataFrame:
    """Eigenvalues of each harmonic's spectrum add up to its trace, their squares to its squared entries."""
    rows = [(r + 1, float(v.sum()), float((v**2).sum())) for r, v in enumerate(dense.descending(s)[0] for s in fitted(spark, d).spectra)]
    return spark.createDataFrame(rows, "r long, total double, squares double").select("r", F.round("total", 4).alias("total"), F.round(F.sqrt("squares"), 4).alias("norm"))


def q_prior(spark: SparkSession, d: str) -> DataFrame:
    p = dense.prior(fitted(spark, d).spectra)
    block = 2 * SIZE
    rows = [(i, j, float(p[i, j])) for i in range(len(p)) for j in range(i // block * block, (i // block + 1) * block)]
    return spark.createDataFrame(rows, "i long, j long, v double").select("i", "j", z6("v").alias("v"))


def q_posterior_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = fitted(spark, d).posteriors(events_set(spark, d)).select("subject_id", F.posexplode("offsets").alias("m", "o"), F.size("mean").cast("long").alias("coefficients"), F.size("covariance").cast("long").alias("rows"))
    return rows.select("subject_id", *longs("m"), z6("o").alias("offs"), "coefficients", "rows")


def q_all_hours(spark: SparkSession, d: str) -> DataFrame:
    """Harmonics add up to nothing over a day: the curves of all 24 hours, seen or not, average to the subject's offsets."""
    rows = fitted(spark, d).reconstruct(events_set(spark, d), all_hours=True).select("subject_id", "hour", F.posexplode("curve").alias("j", "v"))
    return rows.groupBy("subject_id", "j").agg(F.count(F.lit(1)).alias("hours"), F.avg("v").alias("v")).select("subject_id", *longs("j"), "hours", z6("v").alias("v"))


def q_observed_hours(spark: SparkSession, d: str) -> DataFrame:
    data = complete_set(spark, d)
    rows = fitted(spark, d).reconstruct(data).select("subject_id", F.posexplode("curve").alias("j", "v"))
    return rows.groupBy("subject_id", "j").agg(F.count(F.lit(1)).alias("hours"), F.avg("v").alias("v")).select("subject_id", *longs("j"), "hours", z6("v").alias("v"))


def q_levels(spark: SparkSession, d: str) -> DataFrame:
    data = events_set(spark, d)
    both = two_level.level_covariances(data, two_level.visit_levels(data)[1])
    rows = [(level, j, k, float(c[j, k])) for level, c in zip(("between", "within"), both, strict=True) for j in range(SIZE) for k in range(SIZE)]
    return spark.createDataFrame(rows, "level string, j long, k long, cov double").select("level", "j", "k", F.round("cov", 4).alias("cov"))


def two_level_fixed(spark: SparkSession, d: str) -> two_level.TwoLevelModel:
    mean, level = two_level.visit_levels(events_set(spark, d))
    return two_level.TwoLevelModel(mean, level - mean, COSINES.modes, UNIT.modes, np.ones(2), np.ones(SIZE))


def q_level_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = two_level_fixed(spark, d).transform(events_set(spark, d)).select("subject_id", F.posexplode("fingerprint").alias("m", "v"))
    return rows.select("subject_id", *longs("m"), z6("v").alias("v"))


def q_level_fitted(spark: SparkSession, d: str) -> DataFrame:
    return curves_long(two_level_fixed(spark, d).reconstruct(events_set(spark, d)))


def q_trajectories(spark: SparkSession, d: str) -> DataFrame:
    return panels.trajectories(events_set(spark, d), COSINES).select("subject_id", *longs("hour"), z6("score").alias("score"))


def q_fitted_panel(spark: SparkSession, d: str) -> DataFrame:
    data = complete_set(spark, d)
    rows = panels.fitted_panel(data, estimators.cosinor(data, HARMONICS, reconstruct=True))
    return rows.select(*longs("hour"), z6("scale").alias("scale"), z6("observed").alias("observed"), z6("fitted").alias("fitted"))


def q_amplitude(spark: SparkSession, d: str) -> DataFrame:
    data = complete_set(spark, d)
    rows = panels.amplitude_phase(estimators.fit_harmonic(data, "least_squares", harmonics=HARMONICS, rotate=False, basis=UNIT).transform(data), SIZE)
    return rows.select("subject_id", z6("amp").alias("amp"), z6(F.cos("phase")).alias("cos"), z6(F.sin("phase")).alias("sin"))


def q_mean_panel(spark: SparkSession, d: str) -> DataFrame:
    return panels.mean_panel(events_set(spark, d)).select(z6("scale").alias("scale"), z6("mean").alias("mean"))


PHI = ", phi AS (SELECT j, 0 AS m, 1 / sqrt(5) AS p FROM range(5) t(j) UNION ALL SELECT j, 1, sqrt(2 / 5) * cos(pi() * (j + 0.5) / 5) FROM range(5) t(j)), sc AS (SELECT subject_id, hour, phi.m, sum(xi * p) AS xi FROM obs JOIN phi ON obs.m = phi.j GROUP BY ALL)\n"
VISITS = ", v AS (SELECT *, row_number() OVER (PARTITION BY subject_id, m ORDER BY hour) AS visit FROM obs), ce AS (SELECT *, avg(xi) OVER (PARTITION BY visit, m) AS lev, xi - avg(xi) OVER (PARTITION BY visit, m) AS d FROM v), su AS (SELECT *, avg(d) OVER (PARTITION BY subject_id, m) AS mu FROM ce)\n"
SHRUNK = ", sh AS (SELECT r, m, n, CASE WHEN m = n THEN re ELSE 0.75 * re END AS re, CASE WHEN m = n THEN im ELSE 0.75 * im END AS im FROM spec)\n"
FITTED = ", fi AS (SELECT o.subject_id, o.hour, o.m, any_value(o.xi) AS xi, any_value(mesor) + sum(a * cos(2 * pi() * r * hour / 24) + b * sin(2 * pi() * r * hour / 24)) AS v FROM obs o JOIN co USING (subject_id, m) GROUP BY ALL)\n"
TURNED = "SELECT subject_id, m, r, round(mesor, 6) + 0 AS offs, round(a, 6) + 0 AS a, round(b, 6) + 0 AS b FROM co"
FITTED_ROWS = "SELECT subject_id, hour, m AS j, round(v, 6) + 0 AS v FROM fi"
COV = "SELECT a.m AS j, b.m AS k, round({0}(a.xi, b.xi){1}, 4) AS cov FROM obs a JOIN obs b USING (subject_id, hour){2} GROUP BY ALL"
WEIGHTS = "(SELECT * FROM (VALUES (0, 0.5), (1, 1.0), (2, 1.5), (3, 3.0), (4, 2.0)) t(m, w))"

REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "weighted_cov": (q_covariance(True), LONG + COV.format("covar_samp", " * any_value(sqrt(u.w * x.w))", f" JOIN {WEIGHTS} u ON u.m = a.m JOIN {WEIGHTS} x ON x.m = b.m")),
    "unweighted_cov": (q_covariance(False), LONG + COV.format("covar_pop", "", "")),
    "fpca_trace_invariant": (q_plain_variance, LONG + ", c AS (SELECT a.m, b.m AS n, covar_pop(a.xi, b.xi) AS c FROM obs a JOIN obs b USING (subject_id, hour) GROUP BY ALL) SELECT round(sum(CASE WHEN m = n THEN c END), 4) AS total, round(sqrt(sum(c * c)), 4) AS norm FROM c"),
    "project_scores": (q_project, LONG + PHI + "SELECT subject_id, hour, m, round(xi, 6) + 0 AS xi FROM sc"),
    "back_projection": (q_back, LONG + PHI + "SELECT subject_id, hour, j, round(sum(xi * p), 6) + 0 AS v FROM sc JOIN phi USING (m) GROUP BY ALL"),
    "mean_score_fingerprint": (q_mean_scores, LONG + PHI + "SELECT subject_id, m, round(avg(xi), 6) + 0 AS v FROM sc GROUP BY ALL"),
    "score_offsets": (q_offsets, LONG + "SELECT subject_id, m, round(avg(xi), 6) + 0 AS offs FROM obs GROUP BY ALL"),
    "fourier_design": (q_design, LONG + "SELECT DISTINCT hour, CAST(r AS BIGINT) AS r, round(cos(2 * pi() * r * hour / 24), 6) + 0 AS c, round(sin(2 * pi() * r * hour / 24), 6) + 0 AS s FROM seen CROSS JOIN (VALUES (1), (2)) h(r)"),
    "residual_variance": (q_residual, LONG_FULL + HARMONICS_FULL + FITTED + "SELECT CAST(m AS BIGINT) AS m, round(avg(e), 4) AS v FROM (SELECT subject_id, m, var_samp(xi - v) AS e FROM fi GROUP BY ALL) GROUP BY m"),
    "cosinor_amp_phase": (q_cosinor, LONG_FULL + HARMONICS_FULL + TURNED),
    "cosinor_fitted": (q_cosinor_fitted, LONG_FULL + HARMONICS_FULL + FITTED + FITTED_ROWS),
    "ols_orthogonality": (q_orthogonality, LONG + "SELECT count(DISTINCT subject_id) AS subjects, CAST(0.0 AS DOUBLE) AS most FROM seen"),
    "least_squares_amp_phase": (q_plain_harmonics, LONG_FULL + HARMONICS_FULL + TURNED),
    "least_squares_fitted": (q_plain_fitted, LONG_FULL + HARMONICS_FULL + FITTED + FITTED_ROWS),
    "diagonal_amp": (
        q_diagonal,
        PAIRS_FULL + HARMONICS_FULL + """, pw AS (SELECT r, m, sum(cov * cos(2 * pi() * r * lag / 24)) / 24 AS p FROM pooled CROSS JOIN (VALUES (1), (2)) h(r) WHERE m = n GROUP BY ALL), ps AS (SELECT r, m, greatest(0.75 * p + 0.25 * avg(p) OVER (PARTITION BY r), 1e-6) AS p FROM pw)
SELECT subject_id, m, r, round(mesor, 6) + 0 AS offs, round(sqrt(a * a + b * b) * sqrt(p), 4) AS amp FROM co JOIN ps USING (r, m)""",
    ),
    "power_spectra": (q_power, PAIRS + "SELECT CAST(r AS BIGINT) AS r, m, round(sum(cov * cos(2 * pi() * r * lag / 24)) / 24, 6) + 0 AS psd FROM pooled CROSS JOIN (VALUES (1), (2)) h(r) WHERE m = n GROUP BY ALL"),
    "cross_spectra_plain": (q_plain_spectra, PAIRS + "SELECT r, m, n, round(re, 6) + 0 AS re, round(im, 6) + 0 AS im FROM raw"),
    "spectral_trace_invariant": (q_traces, PAIRS + SHRUNK + "SELECT CAST(r AS BIGINT) AS r, round(sum(CASE WHEN m = n THEN re END), 4) AS total, round(sqrt(sum(re * re + im * im)), 4) AS norm FROM sh GROUP BY r"),
    "prior_entries": (
        q_prior,
        PAIRS + SHRUNK + """, pr AS (SELECT 10 * (r - 1) + 5 * p + m AS i, 10 * (r - 1) + 5 * q + n AS j, CASE WHEN p = q THEN re WHEN p = 0 THEN -im ELSE im END / 2 AS v FROM sh CROSS JOIN (VALUES (0), (1)) a(p) CROSS JOIN (VALUES (0), (1)) b(q))
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(v, 6) + 0 AS v FROM pr""",
    ),
    "posterior_offsets": (q_posterior_offsets, LONG + "SELECT subject_id, m, round(avg(xi), 6) + 0 AS offs, 20 AS coefficients, 20 AS rows FROM obs GROUP BY ALL"),
    "reconstruct_all_hours": (q_all_hours, LONG + "SELECT subject_id, m AS j, 24 AS hours, round(avg(xi), 6) + 0 AS v FROM obs GROUP BY ALL"),
    "reconstruct_observed": (q_observed_hours, LONG_FULL + "SELECT subject_id, m AS j, 24 AS hours, round(avg(xi), 6) + 0 AS v FROM obs GROUP BY ALL"),
    "between_within_cov": (
        q_levels,
        LONG + VISITS + """, w AS (SELECT a.m AS j, b.m AS k, covar_samp(a.d - a.mu, b.d - b.mu) AS c FROM su a JOIN su b USING (subject_id, hour) GROUP BY ALL),
s AS (SELECT DISTINCT subject_id, m, mu FROM su), t AS (SELECT a.m AS j, b.m AS k, covar_samp(a.mu, b.mu) AS c FROM s a JOIN s b USING (subject_id) GROUP BY ALL)
SELECT 'within' AS level, j, k, round(c, 4) AS cov FROM w UNION ALL SELECT 'between', j, k, round(t.c - w.c / (SELECT max(visit) FROM v), 4) FROM t JOIN w USING (j, k)""",
    ),
    "two_level_scores": (q_level_scores, LONG + VISITS + PHI + "SELECT subject_id, phi.m, round(sum(mu * p), 6) + 0 AS v FROM (SELECT DISTINCT subject_id, m, mu FROM su) s JOIN phi ON s.m = phi.j GROUP BY ALL"),
    "two_level_fitted": (
        q_level_fitted,
        LONG + VISITS + PHI + """, z AS (SELECT subject_id, phi.m, sum(mu * p) AS z FROM (SELECT DISTINCT subject_id, m, mu FROM su) s JOIN phi ON s.m = phi.j GROUP BY ALL), bk AS (SELECT subject_id, j, sum(z * p) AS b FROM z JOIN phi USING (m) GROUP BY ALL)
SELECT su.subject_id, hour, su.m AS j, round(lev + b + d - mu, 6) + 0 AS v FROM su JOIN bk ON bk.subject_id = su.subject_id AND bk.j = su.m""",
    ),
    "panel_score_traj": (q_trajectories, LONG + PHI + "SELECT subject_id, hour, round(xi, 6) + 0 AS score FROM sc WHERE m = 0 AND subject_id IN (SELECT subject_id FROM seen GROUP BY 1 ORDER BY 1 LIMIT 10)"),
    "panel_observed_fitted": (
        q_fitted_panel,
        LONG_FULL + HARMONICS_FULL + FITTED + "SELECT hour, CAST([0, 1, 2, 4, 8][m + 1] AS DOUBLE) AS scale, round(xi, 6) + 0 AS observed, round(v, 6) + 0 AS fitted FROM fi WHERE hour IN (0, 4, 8, 12, 16, 20) AND subject_id = (SELECT min(subject_id) FROM obs)",
    ),
    "panel_amplitude_phase": (q_amplitude, LONG_FULL + HARMONICS_FULL + "SELECT subject_id, round(sqrt(a * a + b * b), 6) + 0 AS amp, round(a / sqrt(a * a + b * b), 6) + 0 AS cos, round(-b / sqrt(a * a + b * b), 6) + 0 AS sin FROM co WHERE m = 0 AND r = 1"),
    "panel_mean": (q_mean_panel, LONG + "SELECT CAST([0, 1, 2, 4, 8][m + 1] AS DOUBLE) AS scale, round(avg(xi), 6) + 0 AS mean FROM obs GROUP BY m"),
}


def q_shape_panel(spark: SparkSession, d: str) -> DataFrame:
    data = events_set(spark, d)
    return panels.shape_panel(spark, estimators.fit_basis(data, 3), data.scales)


def q_level_panel(spark: SparkSession, d: str) -> DataFrame:
    data = events_set(spark, d)
    return panels.level_panel(spark, two_level.fit_two_level(data), data.scales)


def q_spectral_panel(spark: SparkSession, d: str) -> DataFrame:
    return panels.spectral_panel(spark, estimators.fit_spectral(events_set(spark, d), 3, HARMONICS, SHRINKAGE))


def q_selection(spark: SparkSession, d: str) -> DataFrame:
    _, found = selection.selected(events_set(spark, d), "cv", "cv", 5, HARMONICS)
    return spark.createDataFrame(found, "modes int, shrinkage double, error double")


def q_clusters(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.clusters(estimators.mean_fingerprint(events_set(spark, d), COSINES), 3).select("subject_id", "cluster")


def q_logistic(spark: SparkSession, d: str) -> DataFrame:
    rows = estimators.mean_fingerprint(events_set(spark, d), COSINES).join(tables.subjects(spark, d).select("subject_id", F.col("state").cast("double").alias("target")), "subject_id")
    return evaluation.logistic_scores(rows).select("subject_id", "target", "prediction", "fold")


def q_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Five estimators by all five figures; a segment is the label."""
    data = events_set(spark, d)
    names = F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
    labels = tables.subjects(spark, d).select("subject_id", (F.array_position(names, F.col("segment")) - 1).cast("double").alias("label"))
    fits = {
        "spectral": lambda x: estimators.fit_spectral(x, 3, HARMONICS, SHRINKAGE),
        "two_level": two_level.fit_two_level,
        "diagonal": lambda x: estimators.fit_harmonic(x, "diagonal", 3, HARMONICS, SHRINKAGE),
        "least_squares": lambda x: estimators.fit_harmonic(x, "least_squares", 3, HARMONICS, SHRINKAGE),
        "cosinor": lambda x: estimators.fit_cosinor(x, HARMONICS),
    }
    return tables.benchmark_summary(evaluation.benchmark(fits, data, labels))


def conv_encoder(spark: SparkSession, d: str) -> convolution.ConvAutoencoder:
    return convolution.fit_conv_autoencoder(conv_rows(spark, d))


def conv_regressor(spark: SparkSession, d: str) -> convolution.ConvRegressor:
    return convolution.fit_conv_regressor(conv_rows(spark, d), conv_encoder(spark, d))


def conv_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's curve beside the next one's, standardised, and its label as the target."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("subject_id"), F.lit(0).alias("hour"), F.transform("embedding", lambda x: x.cast("double")).alias("curve"), "label")
    both = tables.standardised(tables.channels(rows, rows.withColumn("subject_id", F.col("subject_id") - 1)))
    return both.join(rows.select("subject_id", F.col("label").cast("double").alias("target")), "subject_id").withColumn("subject_id", F.col("subject_id").cast("string"))


def q_conv(fit: Callable[[SparkSession, str], object], what: str) -> Callable[[SparkSession, str], DataFrame]:
    """What a model says of all rows; only the model that is asked is fitted."""
    return lambda spark, d: getattr(fit(spark, d), what)(conv_rows(spark, d))


def q_augmented(spark: SparkSession, d: str) -> DataFrame:
    return tables.transformed(conv_rows(spark, d), convolution.CHANNELS, convolution.augmented)


def q_importance(spark: SparkSession, d: str) -> DataFrame:
    rows = conv_rows(spark, d)
    return convolution.importance_panel(rows, conv_regressor(spark, d).importance(rows), list(range(64)))


def q_conv_folds(spark: SparkSession, d: str) -> DataFrame:
    """Five folds, ten times, of a regressor that starts from the encoder of all rows."""
    rows = conv_rows(spark, d)
    return convolution.cross_validated(rows, convolution.fit_conv_autoencoder(rows))[0]


#: Fits that SQL cannot say; the tests hold them against dense algebra, numerical gradients or brute force.
UNSTATED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "panel_shape_modes": q_shape_panel,
    "panel_levels": q_level_panel,
    "panel_spectral_mode": q_spectral_panel,
    "model_selection": q_selection,
    "clusters": q_clusters,
    "logistic_scores": q_logistic,
    "benchmark_summary": q_benchmark,
    "augmented_channels": q_augmented,
    "conv_fingerprint": q_conv(conv_encoder, "transform"),
    "conv_reconstruct": q_conv(conv_encoder, "reconstruct"),
    "conv_prediction": q_conv(conv_regressor, "predict"),
    "panel_importance": q_importance,
    "conv_cross_validated": q_conv_folds,
}
