"""Queries over containers, loaders, folds and evaluation, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline import schema
from dayline.dataset import CurveSet
from dayline.functions import dense
from dayline.functions.curves import coherence, linear_axis
from dayline.operators import evaluation, panels, selection
from dayline.plans.sql import EMB, LONG, events_set, r6
from dayline.sources import tables

FULL = LONG + ", whole AS (SELECT subject_id FROM seen GROUP BY 1 HAVING count(*) = 24), ids AS (SELECT subject_id, row_number() OVER (ORDER BY subject_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT subject_id FROM seen))\n"


def long_rows(rows: DataFrame, value: str = "curve") -> DataFrame:
    return rows.select("subject_id", F.col("hour").cast("long").alias("hour"), F.posexplode(value).alias("j", "v")).select("subject_id", "hour", F.col("j").cast("long").alias("j"), r6("v").alias("v"))


def q_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Hours 22 and 23 named alike, and curves of users under 5 cut short: duplicate hours and wrong lengths."""
    rows = tables.event_curves(spark, d).withColumn("hour", F.least("hour", F.lit(22)))
    rows = rows.withColumn("curve", F.when(F.col("subject_id").cast("int") < 5, F.slice("curve", 1, 4)).otherwise(F.col("curve")))
    found = schema.violations(rows, 5)
    return found.groupBy("subject_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def q_lookup(spark: SparkSession, d: str) -> DataFrame:
    return long_rows(events_set(spark, d).curve("7", 5).select(F.lit("7").alias("subject_id"), F.lit(5).alias("hour"), "curve"))


def q_stack(spark: SparkSession, d: str) -> DataFrame:
    return events_set(spark, d).long().select("subject_id", F.col("hour").cast("long").alias("hour"), F.col("j").cast("long").alias("j"), r6("value").alias("v"))


def q_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Each subject's first and last hour by order, from the packed days."""
    ordered = events_set(spark, d).packed().select("subject_id", F.transform("day", lambda x: x["hour"]).alias("h"))
    return ordered.select("subject_id", F.col("h")[0].cast("long").alias("first_hour"), F.element_at("h", -1).cast("long").alias("last_hour"), F.size("h").cast("long").alias("n_hours"))


def q_subset(spark: SparkSession, d: str) -> DataFrame:
    return events_set(spark, d).subset([0, 2, 5]).subject_sizes().select("subject_id", "n_hours", F.col("n_scales").cast("long").alias("n_scales"))


def q_tensor(spark: SparkSession, d: str) -> DataFrame:
    days = CurveSet(tables.complete_days(tables.event_curves(spark, d)), tables.EVENT_SCALES).tensor()
    return days.select("subject_id", F.posexplode("curves").alias("hour", "c")).select("subject_id", F.col("hour").cast("long").alias("hour"), r6(F.col("c")[2]).alias("v"))


def q_channels(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's curve beside the next one's, both standardised."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("curve"))
    first = rows.select(F.col("vec_id").alias("subject_id"), F.lit(0).alias("hour"), "curve")
    both = tables.standardised(tables.channels(first, first.withColumn("subject_id", F.col("subject_id") - 1)))
    return both.select(F.col("subject_id").alias("vec_id"), r6(F.col("a")[0]).alias("a0"), r6(F.col("b")[63]).alias("b63"))


def q_features(spark: SparkSession, d: str) -> DataFrame:
    """Shape features of complete days beside covariates given at every hour."""
    people = tables.adults(tables.subjects(spark, d), least=5).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    found = tables.features(tables.event_curves(spark, d), [0.7, 0.9, 1.1, 1.3, 1.45], people)
    return found.select("subject_id", F.col("hour").cast("long").alias("hour"), r6("bnp").alias("bnp"), r6("dynamic_range").alias("dynamic_range"), r6("auc").alias("auc"))


def q_supervised(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.event_curves(spark, d)
    people = tables.subjects(spark, d).withColumn("hour", F.lit(0))
    first, second = (rows.where(F.col("hour") == h) for h in (0, 4))
    found = tables.supervised(people, first, second, "bnp")
    return found.select("subject_id", r6(F.col("a")[0]).alias("a0"), r6(F.col("b")[4]).alias("b4"), r6("target").alias("target"))


def q_samples(spark: SparkSession, d: str) -> DataFrame:
    """Curves with a missing value where there were no clicks, and the logarithm of a positive balance."""
    rows = tables.event_curves(spark, d).withColumn("curve", F.transform("curve", lambda x, j: F.when((j > 0) | (x > 0), x)))
    found = tables.samples(rows, None, tables.subjects(spark, d).where("bnp > 0"), "bnp")
    return found.select("subject_id", F.col("hour").cast("long").alias("hour"), r6(F.col("a")[0]).alias("a0"), r6("target").alias("target"))


def q_coherence(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.embedding_curves(spark, d)
    return rows.select("subject_id", F.col("hour").cast("long").alias("hour"), r6(coherence(F.col("curve"))).alias("coherence"))


def q_axis(spark: SparkSession, d: str) -> DataFrame:
    scales = [r["s"] for r in spark.read.parquet(f"{d}/nation.parquet").select((F.col("n_nationkey") / 5.0).alias("s")).orderBy("s").collect()]  # 25 rows
    return spark.createDataFrame([(j, float(x)) for j, x in enumerate(linear_axis(scales))], "j long, x double").select("j", r6("x").alias("x"))


def q_modes(spark: SparkSession, d: str) -> DataFrame:
    """How many event types, the most variable first, hold 95 % and half of the variance."""
    rows = events_set(spark, d).long().groupBy("j").agg(F.var_pop("value").alias("v")).collect()  # a row for each scale
    values = np.sort([r["v"] for r in rows])[::-1]
    return spark.createDataFrame([(int(dense.n_modes(values, "share", s)), s) for s in (0.95, 0.5)], "modes long, share double")


def q_folds(spark: SparkSession, d: str) -> DataFrame:
    return selection.contiguous_folds(events_set(spark, d).subject_ids(), 4).select("subject_id", F.col("fold").cast("long").alias("fold"))


def q_equal_folds(spark: SparkSession, d: str) -> DataFrame:
    return selection.contiguous_folds(events_set(spark, d).subject_ids(), 4, equal=True).select("subject_id", F.col("fold").cast("long").alias("fold"))


def q_stratified(spark: SparkSession, d: str) -> DataFrame:
    return selection.stratified_folds(tables.subjects(spark, d).select("subject_id", "segment"), "segment", 3).select("subject_id", "segment", F.col("fold").cast("long").alias("fold"))


def q_ridge(spark: SparkSession, d: str) -> DataFrame:
    """R squared over contiguous folds of a balance on the number of hours."""
    rows = events_set(spark, d).subject_sizes().select("subject_id", F.array(F.col("n_hours").cast("double")).alias("fingerprint"))
    rows = rows.join(tables.subjects(spark, d).select("subject_id", F.col("bnp").alias("target")), "subject_id")
    found = evaluation.ridge_r2(rows, folds=3, placed=selection.contiguous_folds(rows.select("subject_id"), 3))
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(found)], "fold long, r2 double").select("fold", r6("r2").alias("r2"))


def q_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.subjects(spark, d).withColumn("score", F.floor(F.col("bnp") / 500))
    return spark.createDataFrame([(evaluation.auc(rows, F.col("score"), F.col("state")),)], "auc double").select(r6("auc").alias("auc"))


def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.pmod("l_orderkey", F.lit(3)).alias("target"), F.pmod("l_partkey", F.lit(3)).alias("prediction"))
    return evaluation.confusion(rows).select(*(F.col(c).cast("long").alias(c) for c in ("target", "prediction", "n")), r6("share").alias("share"))


def q_errors(spark: SparkSession, d: str) -> DataFrame:
    """Each subject's error where its own mean curve stands for all its hours."""
    data = events_set(spark, d)
    means = data.long().groupBy("subject_id", "j").agg(F.avg("value").alias("v")).groupBy("subject_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("curve"))
    return evaluation.curve_errors(data, data.observations.select("subject_id", "hour").join(means, "subject_id")).select("subject_id", F.round("mse", 4).alias("mse"))


def q_figures(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("metric"), F.col("l_quantity").cast("double").alias("value"))
    return evaluation.summary(rows).select("metric", r6("mean").alias("mean"), r6("deviation").alias("deviation"))


def q_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Hours and balance of users, each in 15 bins."""
    rows = events_set(spark, d).subject_sizes().join(tables.subjects(spark, d), "subject_id").select("subject_id", F.array(F.col("n_hours").cast("double"), "bnp").alias("fingerprint"))
    return panels.offset_histogram(rows, 2).select(F.col("m").cast("long").alias("m"), F.col("bin").cast("long").alias("bin"), r6("low").alias("low"), r6("high").alias("high"), F.col("n").cast("long").alias("n"))


STRATA = """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS subject_id, c_mktsegment AS segment, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1 AS place FROM customer),
k AS (SELECT segment, count(*) AS n, min(place) AS f FROM c GROUP BY 1), o AS (SELECT segment, n, sum(n) OVER (ORDER BY f) - n AS start FROM k),
q AS (SELECT segment, i, (start + n - 1 - i + 3) // 3 - (start - 1 - i + 3) // 3 AS size FROM o CROSS JOIN (VALUES (0), (1), (2)) t(i)),
e AS (SELECT segment, i, sum(size) OVER (PARTITION BY segment ORDER BY i) AS upto FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY place) - 1 AS rank FROM c)
SELECT subject_id, segment, (SELECT count(*) FROM e WHERE e.segment = r.segment AND upto <= rank) AS fold FROM r"""

REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "obs_duplicates": (
        q_duplicates,
        LONG + """SELECT subject_id, 'duplicate_hour' AS rule, count(*) AS n FROM (SELECT subject_id, least(hour, 22) AS h FROM seen GROUP BY ALL HAVING count(*) > 1) GROUP BY 1
UNION ALL SELECT subject_id, 'curve_length', count(*) FROM seen WHERE CAST(subject_id AS INTEGER) < 5 GROUP BY 1""",
    ),
    "curve_lookup": (q_lookup, LONG + "SELECT subject_id, hour, m AS j, round(xi, 6) AS v FROM obs WHERE subject_id = '7' AND hour = 5"),
    "stack_curves": (q_stack, LONG + "SELECT subject_id, hour, m AS j, round(xi, 6) AS v FROM obs"),
    "hours_in_order": (q_ordinals, LONG + "SELECT subject_id, min(hour) AS first_hour, max(hour) AS last_hour, count(*) AS n_hours FROM seen GROUP BY 1"),
    "subject_subset": (q_subset, FULL + "SELECT subject_id, count(*) AS n_hours, 5 AS n_scales FROM seen JOIN ids USING (subject_id) WHERE place IN (0, 2, 5) GROUP BY 1"),
    "tensor_of_complete_days": (q_tensor, FULL + "SELECT subject_id, hour, round(xi, 6) AS v FROM obs JOIN whole USING (subject_id) WHERE m = 2"),
    "channel_standardise": (
        q_channels,
        """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.vec_id, a.x AS a, b.x AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
s AS (SELECT avg(u) AS ma, stddev_pop(u) AS sa, avg(w) AS mb, stddev_pop(w) AS sb FROM (SELECT unnest(a) AS u, unnest(b) AS w FROM p))
SELECT vec_id, round((a[1] - ma) / (sa + 1e-6), 6) AS a0, round((b[64] - mb) / (sb + 1e-6), 6) AS b63 FROM p, s""",
    ),
    "feature_covariate_join": (
        q_features,
        FULL + """, sc AS (SELECT * FROM (VALUES (0, 0.1), (1, 0.2), (2, 0.2), (3, 0.175), (4, 0.075)) t(m, w)), f AS (SELECT subject_id, hour, max(xi) - min(xi) AS dynamic_range, sum(w * xi) AS auc FROM obs JOIN whole USING (subject_id) JOIN sc USING (m) GROUP BY ALL)
SELECT subject_id, hour, round(c_acctbal, 6) AS bnp, round(dynamic_range, 6) AS dynamic_range, round(auc, 6) AS auc FROM f JOIN customer ON CAST(c_custkey AS VARCHAR) = subject_id WHERE c_nationkey >= 5""",
    ),
    "supervised_hour": (
        q_supervised,
        LONG + """, t AS (SELECT CAST(c_custkey AS VARCHAR) AS subject_id, c_acctbal AS y FROM customer WHERE c_acctbal > 0),
v AS (SELECT a.subject_id, a.xi AS a0, b.xi AS b4, y FROM obs a JOIN obs b ON a.subject_id = b.subject_id AND a.hour = 0 AND a.m = 0 AND b.hour = 4 AND b.m = 4 JOIN t ON t.subject_id = a.subject_id)
SELECT subject_id, round(a0, 6) AS a0, round(b4, 6) AS b4, round(log10(y), 6) AS target FROM v WHERE (SELECT count(*) FROM v) >= 10 AND (SELECT count(*) FROM t) >= 10""",
    ),
    "sample_channels": (
        q_samples,
        LONG + """, t AS (SELECT CAST(c_custkey AS VARCHAR) AS subject_id, c_acctbal AS y FROM customer WHERE c_acctbal > 0), x AS (SELECT o.*, CASE WHEN m > 0 OR xi > 0 THEN xi END AS v, y FROM obs o JOIN t USING (subject_id)), s AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM x)
SELECT subject_id, hour, round(coalesce((v - mu) / (sd + 1e-6), 0), 6) AS a0, round(log10(y), 6) AS target FROM x, s WHERE m = 0""",
    ),
    "whole_coherence": (
        q_coherence,
        EMB + """, k AS (SELECT *, v - lag(v) OVER (PARTITION BY subject_id, hour ORDER BY j) AS d, avg(v) OVER (PARTITION BY subject_id, hour) AS mu FROM g)
SELECT subject_id, hour, round(-log10(sum(d * d) / sum((v - mu) * (v - mu))), 6) AS coherence FROM k GROUP BY ALL""",
    ),
    "axis_back_transform": (q_axis, "SELECT CAST(n_nationkey AS BIGINT) AS j, round(pow(10, n_nationkey / 5.0), 6) AS x FROM nation"),
    "n_modes_rule": (
        q_modes,
        LONG + """, v AS (SELECT var_pop(xi) AS v FROM obs GROUP BY m), c AS (SELECT row_number() OVER (ORDER BY v DESC) AS k, sum(v) OVER (ORDER BY v DESC) / sum(v) OVER () AS part FROM v)
SELECT min(k) AS modes, share FROM c JOIN (VALUES (CAST(0.95 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) s(share) ON part >= share GROUP BY share""",
    ),
    "fold_assignment": (q_folds, FULL + "SELECT subject_id, CASE WHEN place < n % 4 * (n // 4 + 1) THEN place // (n // 4 + 1) ELSE (place - n % 4) // (n // 4) END AS fold FROM ids"),
    "fold_equal": (q_equal_folds, FULL + "SELECT subject_id, CASE WHEN place < greatest(n // 4, 1) * 4 THEN place // greatest(n // 4, 1) ELSE -1 END AS fold FROM ids"),
    "fold_stratified": (q_stratified, STRATA),
    "ridge_r2": (
        q_ridge,
        FULL + """, x AS (SELECT subject_id, CAST(count(*) AS DOUBLE) AS x, any_value(c_acctbal) AS y FROM seen JOIN customer ON CAST(c_custkey AS VARCHAR) = subject_id GROUP BY 1),
f AS (SELECT x, y, CASE WHEN place < n % 3 * (n // 3 + 1) THEN place // (n // 3 + 1) ELSE (place - n % 3) // (n // 3) END AS fold FROM x JOIN ids USING (subject_id)),
m AS (SELECT k, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1) AS b FROM f, (VALUES (0), (1), (2)) t(k) WHERE fold <> k GROUP BY k)
SELECT k AS fold, round(1 - sum((y - my - b * (x - mx)) * (y - my - b * (x - mx))) / (var_pop(y) * count(*)), 6) AS r2 FROM f JOIN m ON fold = k GROUP BY k""",
    ),
    "auc_rank": (
        q_auc,
        """WITH c AS (SELECT floor(c_acctbal / 500) AS s, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS l FROM customer), r AS (SELECT l, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS k FROM c)
SELECT round((sum(k * l) - sum(l) * (sum(l) + 1) / 2) / (sum(l) * sum(1 - l)), 6) AS auc FROM r""",
    ),
    "confusion_accuracy": (
        q_confusion,
        "WITH c AS (SELECT l_orderkey % 3 AS target, l_partkey % 3 AS prediction, count(*) AS n FROM lineitem GROUP BY ALL) SELECT target, prediction, n, round(n / sum(n) OVER (PARTITION BY target), 6) AS share FROM c",
    ),
    "mse_by_subject": (q_errors, LONG + "SELECT subject_id, round(avg(c * c), 4) AS mse FROM cen GROUP BY 1"),
    "cv_summary": (q_figures, "SELECT l_returnflag AS metric, round(avg(CAST(l_quantity AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST(l_quantity AS DOUBLE)), 6) AS deviation FROM lineitem GROUP BY 1"),
    "panel_offset_hist": (
        q_histogram,
        LONG + """, v AS (SELECT subject_id, CAST(count(*) AS DOUBLE) AS h, any_value(c_acctbal) AS b FROM seen JOIN customer ON CAST(c_custkey AS VARCHAR) = subject_id GROUP BY 1),
x AS (SELECT 0 AS m, h AS x FROM v UNION ALL SELECT 1, b FROM v), s AS (SELECT m, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1),
k AS (SELECT m, least(floor((x - lo) * 15 / (hi - lo)), 14) AS bin, count(*) AS n FROM x JOIN s USING (m) GROUP BY ALL)
SELECT c.m, CAST(i AS BIGINT) AS bin, round(lo + i * ((hi - lo) / 15), 6) AS low, round(lo + (i + 1) * ((hi - lo) / 15), 6) AS high, coalesce(n, 0) AS n FROM (SELECT * FROM s CROSS JOIN range(15) t(i)) c LEFT JOIN k ON k.m = c.m AND k.bin = c.i""",
    ),
}
