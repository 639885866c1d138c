"""A spectral fit that follows a stream of observations, by Structured Streaming.

A stream of (subject_id, hour, version, curve) is taken in micro-batches. Two tables keep the state, both by batch id: ``days`` has the rows of
each batch, and ``sums`` one vector a batch, the change that the batch made to the sums of operators.sums. For the subjects of a batch alone,
their earlier rows are read, the day before and the day after are made, and the difference of their sums is written. Of one subject and hour
the highest version counts (of equal versions the larger curve), whenever it arrives: a late row of an old version changes nothing, a new version
takes the old curve out.

A batch writes under its own id and reads only those before it, so that a batch which Spark hands out again after a failure overwrites what it
had written and nothing is counted twice. The sums up to any batch give the fit of that moment.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from dayline.operators import sums
from dayline.operators.estimators import SpectralModel

ROWS = "subject_id string, hour int, version long, curve array<double>"
#: Folders that ``days`` is cut into by subject, so that a batch reads the ones its subjects are in.
BUCKETS = 64


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset on one machine, one of our own. A cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        return f"file://{tempfile.mkdtemp(prefix=f'spark-{label}-', dir='/tmp')}"
    return f"{found.rstrip('/')}/{label}-{spark.range(1).select(F.uuid()).first()[0]}"


@dataclass(frozen=True)
class StreamedFit:
    root: str
    scales: list[float]
    harmonics: int = 2
    period: float = 24.0

    @property
    def layout(self) -> sums.Layout:
        return sums.Layout(len(self.scales), self.harmonics, self.period)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Take in one micro-batch; again with the same id, nothing changes."""
        spark = batch.sparkSession
        rows = batch.select("subject_id", "hour", "version", "curve").where((F.size("curve") == len(self.scales)) & F.col("hour").between(0, 23))
        newest = F.max(F.struct("version", "curve"))
        own = rows.groupBy("subject_id", "hour").agg(newest.alias("x")).select("subject_id", "hour", "x.version", "x.curve")
        bucket = F.pmod(F.xxhash64("subject_id"), F.lit(BUCKETS)).cast("int")
        at = f"{self.root}/days/batch={batch_id}"
        own.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(at)
        new = spark.read.schema(ROWS + ", bucket int").parquet(at)
        change = np.zeros(self.layout.size)
        if touched := [r[0] for r in new.select("bucket").distinct().collect()]:  # at most BUCKETS
            changes = new.groupBy("subject_id", "hour").agg(newest.alias("x")).select("subject_id", "hour", F.lit(None).cast("array<double>").alias("before"), "x.curve").withColumnRenamed("curve", "after")
            if batch_id:
                old = spark.read.schema(ROWS + ", batch long, bucket int").option("basePath", f"{self.root}/days").parquet(f"{self.root}/days")
                old = old.where((F.col("batch") < batch_id) & F.col("bucket").isin(touched)).join(new.select("subject_id").distinct(), "subject_id", "left_semi")
                both = old.select("subject_id", "hour", "version", "curve", F.lit(True).alias("old")).unionByName(new.select("subject_id", "hour", "version", "curve", F.lit(False).alias("old")))
                before = F.max(F.when(F.col("old"), F.struct("version", "curve"))).alias("b")
                changes = both.groupBy("subject_id", "hour").agg(newest.alias("x"), before).select("subject_id", "hour", F.col("b.curve").alias("before"), F.col("x.curve").alias("after"))
            change = sums.sums_of_changes(changes, self.layout)
        spark.createDataFrame([(change.tolist(),)], "change array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/sums/batch={batch_id}")

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Follow a stream; ``trigger`` is that of the writer, such as availableNow=True."""
        writer = stream.writeStream.foreachBatch(self.update).option("checkpointLocation", f"{self.root}/checkpoint")
        return writer.trigger(**trigger).start() if trigger else writer.start()

    def sums(self, spark: SparkSession, last: int | None = None) -> np.ndarray:
        """All changes up to a batch, or up to now, added up by position: the vector has the size of the scales, squared, for each lag."""
        rows = spark.read.schema("change array<double>, batch long").option("basePath", f"{self.root}/sums").parquet(f"{self.root}/sums")
        rows = rows if last is None else rows.where(F.col("batch") <= last)
        out = np.zeros(self.layout.size)
        for r in rows.select(F.posexplode("change").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    def model(self, spark: SparkSession, n_modes: int | str = 3, shrinkage: float = 0.25, last: int | None = None, **options) -> SpectralModel:
        found = sums.fit_of(self.sums(spark, last), self.layout, self.scales, n_modes)
        return found.model(len(found.basis.modes), shrinkage, **options)
