"""Queries that link fingerprints to outcomes by nested folds, and that choose modes and harmonics by hours left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayline.operators import linkage, selection
from dayline.plans.sql import LONG, events_set
from dayline.sources import tables

OUTER, INNER = 5, 5


def linked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each user's mean curve of events beside the balance of the customer with that key."""
    prints = events_set(spark, d).observations.groupBy("subject_id").agg(F.array(*(F.avg(F.col("curve")[j]) for j in range(len(tables.EVENT_SCALES)))).alias("fingerprint"))
    return prints.join(tables.subjects(spark, d).select("subject_id", F.col("bnp").alias("target")), "subject_id")


def q_nested(spark: SparkSession, d: str) -> DataFrame:
    found = linkage.nested(linkage.products(linked_rows(spark, d), OUTER, INNER))
    return spark.createDataFrame(found, "method string, fold int, choice string, n long, mse double, r2 double")


def numbered_products(spark: SparkSession, d: str) -> linkage.Products:
    """Folds by the number of the subject, which SQL can say."""
    rows = linked_rows(spark, d)
    key = F.col("subject_id").cast("long")
    return linkage.products(rows, OUTER, INNER, placed=rows.select("subject_id", (key % OUTER).cast("int").alias("outer"), (F.floor(key / OUTER) % INNER).cast("int").alias("inner")))


def q_components(spark: SparkSession, d: str) -> DataFrame:
    """The first component alone, held against each fold."""
    one = {"first": lambda m: linkage.partial_least_squares(m, 1)}
    found = [(f, n, mse, r2) for _, f, _, n, mse, r2 in linkage.nested(numbered_products(spark, d), one)]
    return spark.createDataFrame(found, "fold long, n long, mse double, r2 double").select("fold", "n", F.round("mse", 3).alias("mse"), F.round("r2", 6).alias("r2"))


def q_predicted(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of the model that inner folds choose from all subjects."""
    return linkage.linked(linkage.products(linked_rows(spark, d), OUTER, INNER)).predict(linked_rows(spark, d))


def q_hours(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(selection.selected_by_hours(events_set(spark, d))[1], "modes int, harmonics int, error double")


REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "first_component_r2": (
        q_components,
        LONG + f""", fp AS (SELECT subject_id, m, avg(xi) AS x FROM obs GROUP BY ALL), ta AS (SELECT CAST(c_custkey AS VARCHAR) AS subject_id, CAST(c_acctbal AS DOUBLE) AS y FROM customer),
al AS (SELECT fp.*, y, CAST(subject_id AS BIGINT) % {OUTER} AS own FROM fp JOIN ta USING (subject_id)), fo AS (SELECT DISTINCT own AS fold FROM al),
st AS (SELECT fold, m, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) / stddev_pop(x) AS s FROM al JOIN fo ON own <> fold GROUP BY ALL),
sc AS (SELECT fold, subject_id, own, any_value(y) AS y, any_value(my) AS my, sum((x - mx) / sx * s) AS t FROM al JOIN st USING (m) GROUP BY ALL),
co AS (SELECT fold, covar_pop(t, y) / var_pop(t) AS b FROM sc WHERE own <> fold GROUP BY fold)
SELECT fold, count(*) AS n, round(avg((y - my - b * t) ** 2), 3) AS mse, round(1 - sum((y - my - b * t) ** 2) / (count(*) * var_pop(y)), 6) AS r2 FROM sc JOIN co USING (fold) WHERE own = fold GROUP BY fold""",
    ),
}

#: Iterated fits, which SQL does not give; the tests hold them against loops over rows.
UNSTATED: dict[str, Callable[[SparkSession, str], DataFrame]] = {"outcome_nested": q_nested, "outcome_prediction": q_predicted, "selection_by_hours": q_hours}
