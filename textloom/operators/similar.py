"""All pairs of shingle sets with a Jaccard similarity from a threshold on; none is left out.

Prefix filter: with the shingles of every set in one order, two sets that reach
the threshold share a shingle among the first few of both.  The order puts rare
shingles first, as they have few sets to meet.  How often a shingle occurs is
read from a table of ``BUCKETS`` sums over hashes of shingles, so it may be
overrated; that makes more candidates, but any order finds all pairs, as long as
it is the same for all sets.  Of the candidates, those stay whose shingles could
overlap enough by their counts in classes by hash, and these are verified on
the whole sets.

The sets are shuffled once, by their own hash, reduced to one row for each set,
and read and joined where they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized
from . import minhash

#: Sums over hashes of shingles, in slices that are added up in tasks of their own.
BUCKETS, SLICES = 1 << 21, 16
#: Sums are told apart in steps of a twelfth of a doubling; one byte holds them.
STEPS = 12


def _shingled(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``key, shingles, classes`` of the normalised texts."""

    @F.pandas_udf("shingles array<bigint>, classes array<tinyint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = minhash._sets(n)
        for batch in batches:
            sets = [one(x) for x in batch]
            yield pd.DataFrame({"shingles": sets, "classes": [minhash.classes(x) for x in sets]})

    return df.select(F.col(key), run(normalized(F.coalesce(F.col(text), F.lit("")))).alias("got")).select(key, "got.*")


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return shingles & (BUCKETS - 1)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of the partition's sets fall into each bucket, as a packed row for each slice."""
    total = np.zeros(BUCKETS, np.uint32)
    for batch in batches:
        total += np.bincount(_bucket(batch.column(0).flatten().to_numpy()), minlength=BUCKETS).astype(np.uint32)
    packed = [zlib.compress(x.tobytes(), 1) for x in np.split(total, SLICES)]
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], ["slice", "packed"])


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of the sums of each slice."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[at] = total.get(at, 0) + np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64)
    levels = [np.minimum(STEPS * np.log2(x + 1.0), 255).astype(np.uint8).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(levels, pa.binary())], ["slice", "levels"])


def frequencies(only: DataFrame) -> np.ndarray:
    """The level of each bucket of shingles; ``BUCKETS`` bytes, whatever the size of the input."""
    parts = only.select("shingles").mapInArrow(_tally, "slice INT, packed BINARY").repartition(SLICES, "slice")
    out = np.zeros((SLICES, BUCKETS // SLICES), np.uint8)
    for at, levels in parts.mapInArrow(_levels, "slice INT, levels BINARY").collect():
        out[at] = np.frombuffer(levels, np.uint8)
    return out.ravel()


def prefix_sizes(size: np.ndarray, threshold: float) -> np.ndarray:
    """Of a set's shingles so many stand before the last ceil(threshold * size) - 1, too few for a similar set to share no other."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def _prefixes(levels: np.ndarray, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, id, size, place`` of the first shingles of each set, rare ones first; in a level by their own value."""
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(), batch.column(1)
        size = lists.value_lengths().to_numpy().astype(np.int64)
        shingles = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(size)), size)
        order = (owner << 8 | levels[_bucket(shingles)]).argsort(kind="stable")  # sets are sorted by value
        place = np.arange(len(owner)) - np.repeat(np.r_[0, size.cumsum()[:-1]], size)
        first = place < prefix_sizes(size, threshold)[owner]
        owner = owner[first]
        columns = shingles[order[first]], ids[owner], size[owner].astype(np.int32), place[first].astype(np.int32)
        for at in range(0, len(owner), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in columns], ["token", "id", "size", "place"])


def candidates(only: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: hashes of sets that share one of their first shingles, where sizes and places allow the threshold."""
    work = partial(_prefixes, frequencies(only), threshold)
    return minhash.met(only.select("set_hash", "shingles").mapInArrow(work, "token BIGINT, id BIGINT, size INT, place INT"), threshold)


def similar_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = minhash.NGRAM, threshold: float = minhash.THRESHOLD) -> DataFrame:
    """``id_a < id_b, jaccard``: all pairs of different shingle sets from the threshold on, each set by its smallest key."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    sets = _shingled(df, key, text, n).withColumn("set_hash", F.xxhash64("shingles")).repartition(minhash.parts(df), "set_hash")
    # what memory can't hold is made again from the files of this one shuffle, so it takes no more disk
    only = sets.groupBy("set_hash", F.size("shingles").alias("size")).agg(F.min(key).alias("key"), F.first("shingles").alias("shingles"), F.first("classes").alias("classes")).persist(StorageLevel.MEMORY_ONLY)
    return minhash.verified(candidates(only, threshold), only, "key", threshold)
