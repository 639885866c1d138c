"""Schemas of curve data and the checks of a dataset, as DataFrames of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOURS = 24
OBSERVATIONS = T.StructType(
    [
        T.StructField("subject_id", T.StringType(), False),
        T.StructField("hour", T.IntegerType(), False),
        T.StructField("curve", T.ArrayType(T.DoubleType()), False),
    ]
)


def check_scales(scales: list[float]) -> list[float]:
    """The scales as floats; they must be at least two and strictly increasing."""
    scales = [float(s) for s in scales]
    if len(scales) < 2 or any(b <= a for a, b in zip(scales, scales[1:], strict=False)):
        raise ValueError("scales must be at least two, strictly increasing")
    return scales


def violations(observations: DataFrame, n_scales: int | None = None) -> DataFrame:
    """subject_id, hour and rule of each violation: hour_range, no_curve, curve_length, duplicate_hour."""
    size = F.size("curve")
    rules = [F.when(~F.coalesce(F.col("hour").between(0, HOURS - 1), F.lit(False)), F.lit("hour_range")), F.when(F.col("curve").isNull(), F.lit("no_curve"))]
    if n_scales is not None:
        rules.append(F.when(F.col("curve").isNotNull() & (size != n_scales), F.lit("curve_length")))
    each = observations.select("subject_id", "hour", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    twice = observations.groupBy("subject_id", "hour").count().where("count > 1").select("subject_id", "hour", F.lit("duplicate_hour").alias("rule"))
    return each.unionByName(twice)


def validated(observations: DataFrame, n_scales: int | None = None) -> DataFrame:
    """observations, after one job that raises on the first violations."""
    bad = violations(observations, n_scales).limit(5).collect()
    if bad:
        raise ValueError("invalid observations: " + ", ".join(f"{r.subject_id}/{r.hour}: {r.rule}" for r in bad))
    return observations
