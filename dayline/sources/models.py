"""Fitted models as Parquet tables: a row for each field, so that any dataclass of numbers, arrays, texts and other such dataclasses can be kept."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import SparkSession

from dayline.operators.autoencoder import Autoencoder
from dayline.operators.convolution import ConvAutoencoder, ConvRegressor
from dayline.operators.estimators import Basis, HarmonicModel, SpectralModel
from dayline.operators.two_level import TwoLevelModel

MODELS = {c.__name__: c for c in (Basis, SpectralModel, HarmonicModel, TwoLevelModel, Autoencoder, ConvAutoencoder, ConvRegressor)}
ROW = "field string, kind string, shape array<int>, re array<double>, im array<double>, text string"


def rows_of(value, field: str) -> list[tuple]:
    if dataclasses.is_dataclass(value):
        own = [(field, "model", None, None, None, type(value).__name__)]
        return own + [r for f in dataclasses.fields(value) for r in rows_of(getattr(value, f.name), f"{field}.{f.name}" if field else f.name)]
    if isinstance(value, dict):
        return [(field, "dict", None, None, None, "\n".join(value))] + [r for k, v in value.items() for r in rows_of(v, f"{field}.{k}")]
    if value is None or isinstance(value, str):
        return [(field, "none" if value is None else "text", None, None, None, value)]
    x = np.asarray(value)
    kind = "tuple" if isinstance(value, tuple) else "array" if isinstance(value, np.ndarray) else "int" if isinstance(value, (int, np.integer)) else "number"
    im = x.imag.ravel().tolist() if np.iscomplexobj(x) else None
    return [(field, kind, list(x.shape), x.real.ravel().astype(float).tolist(), im, None)]


def saved(model, spark: SparkSession, path: str) -> None:
    """Write a model; its size is that of its weights, whatever the data were."""
    spark.createDataFrame(rows_of(model, ""), ROW).coalesce(1).write.mode("overwrite").parquet(path)


def loaded(spark: SparkSession, path: str):
    """The model that saved() wrote."""
    rows = {r["field"]: r for r in spark.read.parquet(path).collect()}

    def value(field: str):
        r = rows[field]
        if r["kind"] == "model":
            names = [f.name for f in dataclasses.fields(MODELS[r["text"]])]
            return MODELS[r["text"]](**{n: value(f"{field}.{n}" if field else n) for n in names})
        if r["kind"] == "dict":
            return {k: value(f"{field}.{k}") for k in r["text"].split("\n") if k}
        if r["kind"] in ("none", "text"):
            return r["text"]
        x = np.array(r["re"], float)
        if r["im"] is not None:
            x = x + 1j * np.array(r["im"])
        x = x.reshape(r["shape"])
        return x if r["kind"] == "array" else tuple(x.tolist()) if r["kind"] == "tuple" else int(x) if r["kind"] == "int" else x.item()

    return value("")
