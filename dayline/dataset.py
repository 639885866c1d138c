"""A set of curves: observations over one scale grid, and the views that estimators read."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayline import schema
from dayline.functions.curves import quadrature_weights


def numbered(ids: DataFrame) -> DataFrame:
    """subject_id and ``place``, from 0, in the order of all ids. Ids are dealt by range and counted there, so no task meets them all."""
    dealt = ids.repartitionByRange("subject_id").select("subject_id", F.spark_partition_id().alias("part")).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("subject_id")) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(before), "part").select("subject_id", (F.col("before") + F.col("inside")).alias("place"))


@dataclass(frozen=True)
class CurveSet:
    """observations (subject_id, hour, curve), the scales of every curve, and covariates if there are any."""

    observations: DataFrame
    scales: list[float]
    subjects: DataFrame | None = None

    def __post_init__(self):
        object.__setattr__(self, "scales", schema.check_scales(self.scales))

    def checked(self) -> CurveSet:
        """Itself, after one job that raises on bad rows or none."""
        if self.observations.isEmpty():
            raise ValueError("no observations")
        schema.validated(self.observations, len(self.scales))
        return self

    def copy_with(self, **changes) -> CurveSet:
        """With other fields; new observations or scales are checked again, by one job."""
        after = replace(self, **changes)
        return after.checked() if {"observations", "scales"} & set(changes) else after

    @property
    def weights(self) -> list[float]:
        return quadrature_weights(self.scales)

    def ordered(self) -> DataFrame:
        return self.observations.orderBy("subject_id", "hour")

    def subject_sizes(self) -> DataFrame:
        return self.observations.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_hours"), F.max(F.size("curve")).alias("n_scales"))

    def subject_ids(self) -> DataFrame:
        return self.observations.select("subject_id").distinct()

    def has_hour(self, hour: int) -> DataFrame:
        return self.observations.groupBy("subject_id").agg(F.max(F.col("hour") == hour).alias("has_hour"))

    def curve(self, subject_id: str, hour: int) -> DataFrame:
        """The curve at a subject and hour: one row, or none."""
        return self.observations.where((F.col("subject_id") == subject_id) & (F.col("hour") == hour)).select("curve")

    def subject(self, subject_id: str) -> DataFrame:
        rows = self.observations.where(F.col("subject_id") == subject_id)
        if rows.isEmpty():
            raise KeyError(subject_id)
        return rows

    def subset(self, positions: list[int]) -> CurveSet:
        """Subjects at positions of the order of their ids."""
        wanted = numbered(self.subject_ids()).where(F.col("place").isin([int(p) for p in positions])).select("subject_id")
        return replace(self, observations=self.observations.join(wanted, "subject_id", "left_semi"))

    def observed_pairs(self, lag: int) -> DataFrame:
        """subject_id, hour, curve and later: the curve ``lag`` hours on, around the clock, where both exist."""
        lag %= schema.HOURS
        later = self.observations.select("subject_id", F.pmod(F.col("hour") - lag, F.lit(schema.HOURS)).alias("hour"), F.col("curve").alias("later"))
        return self.observations.join(later, ["subject_id", "hour"])

    def long(self) -> DataFrame:
        """subject_id, hour, j and value."""
        return self.observations.select("subject_id", "hour", F.posexplode("curve").alias("j", "value"))

    def mean_curve(self) -> DataFrame:
        """j and mean: every observation counts once. Positions are summed in place, so no value is exploded."""
        n = len(self.scales)
        sums = self.observations.agg(*(F.avg(F.col("curve")[j]).alias(f"m{j}") for j in range(n)))
        return sums.select(F.posexplode(F.array(*(F.col(f"m{j}") for j in range(n)))).alias("j", "mean"))

    def packed(self) -> DataFrame:
        """subject_id and ``day``, its observations (hour, curve) in order: at most 24 in a row."""
        return self.observations.groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("hour", "curve"))).alias("day"))

    def tensor(self) -> DataFrame:
        """subject_id and the matrix of its curves by hour; raises unless all subjects have as many hours."""
        packed = self.packed()
        if packed.agg(F.countDistinct(F.size("day"))).first()[0] > 1:
            raise ValueError("subjects differ in their number of hours")
        return packed.select("subject_id", F.transform("day", lambda x: x["curve"]).alias("curves"))

    def dense(self) -> DataFrame:
        """subject_id, hour, curve and mask for all 24 hours, zeros where an hour is missing."""
        hours = self.subject_ids().select("subject_id", F.explode(F.sequence(F.lit(0), F.lit(schema.HOURS - 1))).alias("hour"))
        joined = hours.join(self.observations, ["subject_id", "hour"], "left")
        return joined.select("subject_id", "hour", F.coalesce("curve", F.array_repeat(F.lit(0.0), len(self.scales))).alias("curve"), F.col("curve").isNotNull().cast("int").alias("mask"))

    def summary(self) -> DataFrame:
        sizes = self.subject_sizes()
        return sizes.agg(F.count(F.lit(1)).alias("subjects"), F.max("n_scales").alias("scales"), F.sum("n_hours").alias("observations"), F.avg("n_hours").alias("mean_hours"))
