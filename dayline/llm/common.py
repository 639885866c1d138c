"""Helpers that several operators share: inputs, checkpoints and row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the five ASCII controls from tab to carriage return.
SPACE_CLASS = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset on one machine (tests), one of our own. A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"file://{shared_dir.own}"


def saved(df: DataFrame, label: str, batch: int = 0) -> DataFrame:
    """Write to a table in the shared folder and read it back: lineage ends here, executors may be lost.

    ``batch`` is the number of rows handed to Python at once, for steps whose rows are long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if batch:
        spark.conf.set(name, str(batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that saved() wrote, once no later step reads them."""
    for df in tables:
        files = df.inputFiles()
        if files:
            context = df.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """(doc_id, hash of the text): equal only for repeated rows, and comparable, nulls first."""
    return F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(whole_text(text)).alias("h"))
