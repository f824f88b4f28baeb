"""Arrow batches in, rows out: the one way in which the operators of this subpackage run Python.

Only the key and the text leave the JVM, under fixed names, so other columns of the input cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Texts handled at once; bounds a worker's memory however large an Arrow batch is.
CHUNK = 1024
CHUNK_CHARS = 4_000_000


def pick(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The key as ``k BIGINT`` and the named columns as ``c0, c1, ...``."""
    return df.select(F.col(f"`{key}`").cast("bigint").alias("k"), *(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(columns)))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of at most CHUNK texts and about CHUNK_CHARS characters."""
    start = size = 0
    for n, t in enumerate(texts):
        size += len(t) if isinstance(t, str) else 1
        if n + 1 - start >= CHUNK or size >= CHUNK_CHARS:
            yield start, n + 1
            start, size = n + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """For each chunk of rows the function made once per task gets the columns as lists and yields output tuples."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    return df.mapInArrow(_runner(fields, make), schema)


def _runner(fields: StructType, make):
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for a, b in chunks(columns[1]):
                rows = list(work(*(c[a:b] for c in columns)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return run
