"""Sums over all rows as one vector, and the packed day of each subject that they read."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayline.dataset import CurveSet


#: Vectors that reach the driver at most; partitions' sums are added up in as many groups before.
GROUPS = 32


def summed(rows: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum of part(batch), a vector of fixed size, over all batches: one vector leaves each partition, GROUPS at most reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, any_row = np.zeros(size), False
        for batch in batches:
            if len(batch):
                total, any_row = total + part(batch), True
        if any_row:
            yield pd.DataFrame({"g": [TaskContext.get().partitionId() % GROUPS], "v": [total]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"v": [np.sum(group["v"].to_list(), axis=0)]})

    found = rows.mapInPandas(run, "g int, v array<double>").groupBy("g").applyInPandas(added, "v array<double>").toPandas()["v"]
    return np.sum(found.to_list(), axis=0) if len(found) else np.zeros(size)


def days(data: CurveSet) -> DataFrame:
    """subject_id, hours (in order) and values, its curves end to end: at most 24 curves in a row."""
    return data.packed().select("subject_id", F.transform("day", lambda x: x["hour"]).alias("hours"), F.flatten(F.transform("day", lambda x: x["curve"])).alias("values"))
