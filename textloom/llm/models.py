"""Fitted models as tables of arrays, so that one fit serves many runs."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import SparkSession


def save(spark: SparkSession, path: str, **arrays) -> None:
    """Named arrays, one row each; replaces what is there."""
    rows = []
    for name, value in arrays.items():
        raw = io.BytesIO()
        np.save(raw, np.asarray(value), allow_pickle=False)
        rows.append((name, bytearray(raw.getvalue())))
    spark.createDataFrame(rows, "name STRING, value BINARY").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The arrays of a saved model; fails where there is none."""
    return {r["name"]: np.load(io.BytesIO(bytes(r["value"])), allow_pickle=False) for r in spark.read.parquet(path).collect()}
