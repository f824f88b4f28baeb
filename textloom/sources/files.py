"""Text files by line, whole and by blank-line blocks; URL lists; links of wiki dumps; directory indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# References in dumps and the addresses inside them.
REFERENCE = r"&lt;ref&gt(.*)&lt;/ref&gt;"
ADDRESS = r"\b(?:https?|telnet|gopher|file|wais|ftp):[\w/#~:.?+=&%@!\-.:?\\-]+?(?=[.:?\-]*(?:[^\w/#~:.?+=&%@!\-.:?\-]|$))"


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """``file, line``"""
    return spark.read.text(list(paths)).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def read_whole(spark: SparkSession, *paths: str) -> DataFrame:
    """``file, text``: one document per file."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def read_blocks(spark: SparkSession, *paths: str) -> DataFrame:
    """``file, text``: documents separated by blank lines, stripped, empty ones dropped."""
    rows = spark.read.option("lineSep", "\n\n").text(list(paths)).select(F.col("_metadata.file_name").alias("file"), strip(F.col("value")).alias("text"))
    return rows.where("text <> ''")


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """``wet_path`` from a headerless list, gzipped or not."""
    return spark.read.csv(path, header=False, schema="wet_path STRING").where("wet_path is not null")


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """``url``: stripped lines that begin with http."""
    return spark.read.text(path).select(stripped_urls(F.col("value")).alias("url")).where("url is not null")


def reference_urls(line: Column) -> Column:
    """The addresses in the first reference of a dump's line, as an array."""
    return F.regexp_extract_all(F.regexp_extract(line, REFERENCE, 0), F.lit(ADDRESS), F.lit(0))


def index_names(html: Column, pattern: str) -> Column:
    """Distinct sorted names in a directory index that match a pattern with one group."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))))


def stripped_urls(value: Column) -> Column:
    """The address, stripped, where it begins with http; null otherwise."""
    url = strip(value)
    return F.when(url.startswith("http"), url)


def universal_lines(text: Column) -> Column:
    """The lines of a text as reading a file by line gives them: line feed, carriage return or both end one; the end of the last opens no further one."""
    parts = F.split(text, "\r\n|\r|\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def blocks(text: Column) -> Column:
    """The parts of a text between blank lines, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda x: x != "")


def catalogue(df: DataFrame, path: str = "path", chunk: int = 4) -> DataFrame:
    """``n, path, chunk``: distinct paths in their order, numbered from 0, in chunks of so many.

    Ranges of paths are sorted and counted apart; only the counts of the ranges are added up in one place.
    """
    rows = df.select(F.col(path).alias("path")).where("path is not null").distinct().repartitionByRange("path").sortWithinPartitions("path")
    rows = rows.select("path", F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id() % (1 << 33)).alias("_i")).persist()
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))  # one row per range
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    n = F.col("_before") + F.col("_i")
    return rows.join(F.broadcast(before), "_p").select(n.alias("n"), "path", F.floor(n / chunk).alias("chunk"))


def sample(df: DataFrame, n: int, key: str = "doc_id", seed: int = 336) -> DataFrame:
    """n rows in the order of a hash of key and seed: the same rows for the same seed, whatever the partitions."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}"))), key).limit(n)
