"""Token streams as little-endian 16-bit files, filtered text files, archives of kept records, URL lists."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from . import committed

END_OF_TEXT = 50256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(path: str | None = VOCABULARY) -> Callable[[str], list[int]]:
    """Byte-level BPE from a vocabulary file; for None the bytes themselves.  Without the file it fails."""
    if path is None:
        return lambda text: list(text.encode("utf-8"))
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def tokenized(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = VOCABULARY) -> DataFrame:
    """``key, ids``: the tokens of each document and an end-of-text mark; a null text has the mark only.

    The vocabulary is read here, so that a missing one fails at once, and shipped to the executors.
    """
    name = None
    if path is not None:
        encoder(path)
        df.sparkSession.sparkContext.addFile(path)
        name = os.path.basename(path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encoder(name and SparkFiles.get(name))
        for batch in batches:
            yield pd.Series([[*(run(t) if t else ()), END_OF_TEXT] for t in batch])

    return df.select(F.col(key), encode(F.col(text)).alias("ids"))


def totals(tokens: DataFrame) -> DataFrame:
    """One row: documents, tokens, bytes at 16 bits each, mean tokens of a document."""
    n = F.coalesce(F.sum(F.size("ids")), F.lit(0))
    return tokens.agg(F.count("*").alias("documents"), n.alias("tokens"), (2 * n).alias("bytes"), F.round(F.avg(F.size("ids")), 6).alias("mean_tokens"))


def write_stream(tokens: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Writes ``part-*.u16`` files in the order of the key and returns the manifest ``part, key_from, key_to, n_tokens``.

    Parts are ranges of the key, so their concatenation by name is the whole stream; nothing passes the driver.
    """
    spark = tokens.sparkSession
    committed.register(spark)
    ordered = tokens.select(key, "ids").repartitionByRange(key).sortWithinPartitions(key)
    ordered.write.format("tokens16").option("key", key).mode("overwrite").save(folder)
    return spark.read.schema("part STRING, key_from BIGINT, key_to BIGINT, n_tokens BIGINT").json(f"{folder}/manifest.json")


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``part, ids`` of the files written by :func:`write_stream`."""

    @F.pandas_udf("array<int>")
    def ids(raw: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(bytes(x), "<u2").astype(np.int32) for x in raw])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*.u16").load(folder).select(F.col("_metadata.file_name").alias("part"), ids("content").alias("ids"))


def output_name(file: Column) -> Column:
    """The name of the text file for an archive or text file: its base name with ``.txt``."""
    return F.concat(F.regexp_replace(F.regexp_replace(file, "^.*/", ""), r"(\.warc)?(\.wet)?(\.txt)?(\.gz)?$", ""), F.lit(".txt"))


def write_texts(df: DataFrame, folder: str, text: str = "text", file: str = "file", order: str | None = None) -> None:
    """A text file for each input file: its documents, stripped, each followed by a blank line; none where nothing is kept.

    The documents of one input file, which is bounded, are written by one task.
    """
    committed.register(df.sparkSession)
    rows = df.select(output_name(F.col(file)).alias("file"), strip(F.coalesce(F.col(text), F.lit(""))).alias("text"), *([F.col(order).alias("_o")] if order else []))
    rows = rows.where("text <> ''").repartition("file").sortWithinPartitions("file", *(["_o"] if order else []))
    rows.select("file", "text").write.format("texts").mode("overwrite").save(folder)


def write_files(df: DataFrame, folder: str, text: str = "text", file: str = "file") -> None:
    """Each row as a file of its name, the text as it is; empty texts give empty files."""
    committed.register(df.sparkSession)
    df.select(F.col(file).alias("file"), F.coalesce(F.col(text), F.lit("")).alias("text")).write.format("texts").option("sep", "").mode("overwrite").save(folder)


def write_archive(df: DataFrame, folder: str, file: str | None = None) -> None:
    """Kept text records (``target_uri, date, payload``) as gzipped archives, one for each input file where it is named."""
    from ..sources import warc

    warc.register(df.sparkSession)
    rows = df.select("target_uri", "date", "payload", *([F.col(file).alias("file")] if file else []))
    if file:
        rows = rows.repartition("file").sortWithinPartitions("file", "target_uri")
    rows.write.format("warc").mode("overwrite").save(folder)


def write_urls(df: DataFrame, folder: str, url: str = "url") -> None:
    """Addresses, one on each line, gzipped."""
    df.select(F.col(url).alias("value")).where("value is not null").write.mode("overwrite").option("compression", "gzip").text(folder)
