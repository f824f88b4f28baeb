"""Near-duplicate documents: MinHash signatures, banding, exact Jaccard, connected classes.

Every text is normalised and shingled once; the table of shingle sets and bands
is shuffled by the sets' hashes and everything else reads it there.  Documents with the same
set of shingles form one class beforehand and are represented by their smallest
key, so that copies, however many, never meet in a bucket; links are made
between different shingle sets only.

A shingle is 62 bits: two 31-bit linear combinations, modulo a prime, of the
hashes of its words.  Buckets of many different sets are cut into blocks, and
each pair of blocks is joined by itself, so all pairs are verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized
from .components import checkpointed, components

PRIME = 2147483647
HASHES, BANDS, NGRAM, THRESHOLD = 100, 20, 5, 0.8
#: Members of a block of a bucket.
BLOCK = 2000
#: Classes by hash in which a set's shingles are counted; counts above MOST aren't given.
CLASSES, MOST = 64, 127


@lru_cache(maxsize=8)
def coefficients(k: int) -> tuple[tuple[int, int], ...]:
    """(a, b) of each hash function, from a fixed linear congruence."""
    out, x = [], 42
    for _ in range(k):
        x = (x * 1103515245 + 12345) % PRIME
        a = x
        x = (x * 1103515245 + 12345) % PRIME
        out.append((a, x))
    return tuple(out)


def ngram_factors(n: int) -> list[tuple[int, int]]:
    """The factors of an n-gram's words in its two hashes."""
    return list(coefficients(64)[64 - n :])


class _Words(dict):
    """Word to the two 31-bit halves of its hash; remembered up to a number of words."""

    def __missing__(self, word: str) -> int:
        h = hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()
        at = (int.from_bytes(h[:4], "big") % PRIME) << 32 | int.from_bytes(h[4:8], "big") % PRIME
        if len(self) < 500_000:
            self[word] = at
        return at


def _sets(n: int):
    """From normalised texts, words separated by single spaces, to sorted distinct shingles."""
    words, factors = _Words(), ngram_factors(n)

    def one(text: str | None) -> np.ndarray:
        ws = text.split(" ") if text else []
        if len(ws) < n:
            return np.zeros(0, np.int64)
        packed = np.array(list(map(words.__getitem__, ws)), np.int64)
        halves = packed >> 32, packed & 0xFFFFFFFF
        m = len(ws) - n + 1
        out = [sum(half[k : k + m] * factors[k][side] % PRIME for k in range(n)) % PRIME for side, half in enumerate(halves)]
        return np.unique(out[0] << 31 | out[1])

    return one


def minima(k: int):
    """From a shingle set to the k minima of its signature; zeros for the empty set."""
    ab = np.array(coefficients(k), np.int64)
    a, b = ab[:, :1], ab[:, 1:]

    def one(shingles) -> np.ndarray:
        if shingles is None or len(shingles) == 0:
            return np.zeros(k, np.int64)
        low = np.full(k, PRIME, np.int64)
        high = np.asarray(shingles, np.int64) >> 31
        for part in np.array_split(high, max(1, len(high) // 4096)):
            low = np.minimum(low, ((a * part[None] + b) % PRIME).min(1))
        return low

    return one


def classes(shingles: np.ndarray) -> np.ndarray | None:
    """How many shingles of a set are in each class by hash: what two sets can have in common at most."""
    counts = np.bincount((shingles >> 40) & (CLASSES - 1), minlength=CLASSES)
    return counts.astype(np.int8) if counts.max() <= MOST else None


def signature(k: int = HASHES):
    """Arrow function from shingles to the k minima."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = minima(k)
        for batch in batches:
            yield pd.Series([one(x) for x in batch])

    return run


def shingled(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = NGRAM) -> DataFrame:
    """``key, shingles`` of the normalised texts; a null text has none."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _sets(n)
        for batch in batches:
            yield pd.Series([one(x) for x in batch])

    return df.select(F.col(key), run(normalized(F.coalesce(F.col(text), F.lit("")))).alias("shingles"))


def prepared(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = HASHES, b: int = BANDS, n: int = NGRAM) -> DataFrame:
    """``key, shingles, size, set_hash, buckets, classes``: all that later steps read, in one pass over the texts."""
    if k % b:
        raise ValueError("the number of hashes must be a multiple of the number of bands")

    @F.pandas_udf("shingles array<bigint>, buckets array<bigint>, classes array<tinyint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one, low = _sets(n), minima(k)
        for batch in batches:
            sets = [one(x) for x in batch]
            yield pd.DataFrame({"shingles": sets, "buckets": [_buckets(low(x), b) for x in sets], "classes": [classes(x) for x in sets]})

    got = run(normalized(F.coalesce(F.col(text), F.lit("")))).alias("got")
    rows = df.select(F.col(key), got).select(key, "got.*")
    return rows.select(key, "shingles", F.size("shingles").alias("size"), F.xxhash64("shingles").alias("set_hash"), "buckets", "classes")


def _buckets(sig: np.ndarray, b: int) -> np.ndarray:
    """A 64-bit hash per band of the band's number and minima."""
    out = (np.arange(1, b + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    for column in sig.reshape(b, -1).T.astype(np.uint64):
        out = (out ^ column) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def representatives(sets: DataFrame, key: str) -> DataFrame:
    """``key, rep``: the smallest key of the documents with the same shingle set.

    The minimum is combined before the shuffle; the join back has one row per set on its other side, so a hot set may
    be split.
    """
    keyed = sets.select(key, "set_hash", "size")
    return keyed.join(keyed.groupBy("set_hash", "size").agg(F.min(key).alias("rep")), ["set_hash", "size"]).select(key, "rep")


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def met(rows: DataFrame, threshold: float) -> DataFrame:
    """``a < b``: the ids of ``token, id, size, place`` that share a token, and whose sizes and its places allow the threshold, once each.

    ``place`` is how many of a set's shingles come before the token; at the first that two sets share, what follows in
    either must be enough for the overlap they need.  The rows are shuffled once, by their tokens, and joined there; those
    of a token with m of more than ``BLOCK`` are cut into ceil(m / BLOCK) blocks, and a row goes to the cells of its block
    with every other one.
    """
    rows = rows.repartition(parts(rows), "token").withColumn("m", F.count("*").over(Window.partitionBy("token"))).where("m > 1").persist(StorageLevel.MEMORY_AND_DISK)
    usual, hot = rows.where(F.col("m") <= BLOCK), rows.where(F.col("m") > BLOCK)
    near = F.least("sx", "sy") >= threshold * F.greatest("sx", "sy") - 1e-9
    enough = F.least(F.col("sx") - F.col("px"), F.col("sy") - F.col("py")) * (1 + threshold) >= threshold * (F.col("sx") + F.col("sy")) - 1e-9
    side = lambda df, n, *more: df.select("token", F.col("id").alias(n), F.col("size").alias(f"s{n}"), F.col("place").alias(f"p{n}"), *more)
    found = side(usual, "x").join(side(usual, "y"), "token").where((F.col("x") < F.col("y")) & near & enough)
    blocks = F.ceil(F.col("m") / BLOCK)
    hot = hot.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), blocks))
    left = side(hot, "x", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"))
    right = side(hot, "y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("own"))).alias("i"), F.col("own").alias("j"))
    once = F.when(F.col("i") == F.col("j"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y"))
    split = left.join(right, ["token", "i", "j"]).where(once & near & enough)
    return found.select("x", "y").unionByName(split.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _banded(only: DataFrame, id: str) -> DataFrame:
    return only.select(F.col(id).alias("id"), "size", F.lit(0).alias("place"), F.explode("buckets").alias("token"))


def candidates(only: DataFrame, key: str) -> DataFrame:
    """``id_a < id_b``: representatives that share a bucket, once each."""
    return met(_banded(only, key), 0.0).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def verified(found: DataFrame, only: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """``id_a < id_b, jaccard`` of pairs ``a, b`` of hashes of sets, at or above the threshold; two empty sets have 1.

    ``only``, with one row for each set, is partitioned by ``set_hash`` and joined where it is.  Of the pairs, those stay
    whose shingles could overlap enough by their classes, and only these take whole sets along.
    """
    side = lambda x, *columns: only.select(F.col("set_hash").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    few = found.join(side("a", "size", "classes"), "a").join(side("b", "size", "classes"), "b")
    most = F.aggregate(F.zip_with("classes_a", "classes_b", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
    few = few.where(F.coalesce(most * (1 + threshold) >= threshold * (F.col("size_a") + F.col("size_b")) - 1e-9, F.lit(True)))
    rows = few.select("a", "b").join(side("a", key, "shingles"), "a").join(side("b", key, "shingles"), "b")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - both
    j = F.when(union == 0, F.lit(1.0)).otherwise(both / union)
    ka, kb = F.col(f"{key}_a"), F.col(f"{key}_b")
    return rows.select(F.least(ka, kb).alias("id_a"), F.greatest(ka, kb).alias("id_b"), j.alias("jaccard")).where(F.col("jaccard") >= threshold)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = HASHES, b: int = BANDS, n: int = NGRAM, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(verified pairs of representatives that share a band, membership ``key, rep``); :mod:`similar` has all pairs.

    The sets are shuffled once, by their own hash; what memory can't hold is made again from the files of that shuffle.
    """
    own = Window.partitionBy("set_hash", "size").orderBy(key)
    sets = prepared(df, key, text, k, b, n).repartition(parts(df), "set_hash")
    sets = sets.select("*", F.first(key).over(own).alias("rep"), F.row_number().over(own).alias("nth")).persist(StorageLevel.MEMORY_ONLY)
    only = sets.where("nth = 1")
    return verified(met(_banded(only, "set_hash"), threshold), only, key, threshold), sets.select(key, "rep")


def clusters(df: DataFrame, key: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """``key, cluster_id, n_links``: the smallest key of each document's class, and its links to other shingle sets."""
    pairs, rep = near_duplicates(df, key, text, **parameters)
    pairs = checkpointed(pairs)  # read three times below
    both = pairs.select("id_a", "id_b").unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    links = both.groupBy(F.col("id_a").alias("rep")).agg(F.count("*").alias("n_links"))
    label = components(pairs.select(F.col("id_a").alias("src"), F.col("id_b").alias("dst")))
    out = rep.join(label.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    return out.select(key, F.coalesce("component", "rep").alias("cluster_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def cluster_sizes(members: DataFrame, key: str = "doc_id", seed: int | None = None) -> DataFrame:
    """``cluster_id, n, kept``: the documents of each class and the one that stays, the smallest key or, with a seed, the
    one whose hash with the seed is smallest; combined before the shuffle."""
    return members.groupBy("cluster_id").agg(F.count("*").alias("n"), _chosen(key, seed).alias("kept"))


def _chosen(key: str, seed: int | None) -> Column:
    if seed is None:
        return F.min(key)
    order = F.struct(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), F.col(key))
    return F.min_by(key, order)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int | None = None, **parameters) -> DataFrame:
    """The documents kept, with all their columns: of every class the smallest key, or a seeded choice."""
    kept = cluster_sizes(clusters(df, key, text, **parameters), key, seed).select(F.col("kept").alias(key))
    return df.join(kept, key, "left_semi")
