"""Reading the tables by name; tables kept by what made them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Input of a task below which a scan's partitions may be too few for its cores.
PER_TASK = 16 << 20


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table; with columns only those, spread."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df.select(*columns)) if columns else df


def spread(df: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """Small inputs, whose few row groups would keep most cores idle, in as many partitions as there are cores; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * per_task else df


def materialised(spark: SparkSession, folder: str, name: str, config: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes, written once for each name and configuration and read from then on.

    The folder must be shared by all executors.  A table whose writing was broken off has no mark of success and is
    written again.
    """
    from .sources import storage

    path = f"{folder}/{name}-{hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]}"
    system, inner = storage.opened(path)
    if system.get_file_info(f"{inner}/_SUCCESS").type.name != "File":
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
