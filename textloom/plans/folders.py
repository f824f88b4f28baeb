"""Whole folders in, whole folders out: the operators on files, one output file for each input file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines, minhash, naive_bayes
from ..operators.naive_bayes import Model
from ..sinks.tokens import write_archive, write_files
from ..sources import warc
from .pipeline import is_english


def _texts(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, text`` of whole files, line ends made one."""
    rows = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.withColumn("text", F.regexp_replace("text", "\r\n|\r", "\n"))


def _named(path):
    return F.regexp_extract(path, "([^/]+)$", 1)


def dedup_lines(spark: SparkSession, output: str, *paths: str) -> None:
    """Writes every file again without the lines that occur more than once in all of them; files left empty stay, empty."""
    kept = lines.dedup(_texts(spark, *paths), "path")
    write_files(kept.select(_named("path").alias("file"), "text"), output)


def dedup_fuzzy(spark: SparkSession, output: str, *paths: str, seed: int | None = None, **parameters) -> None:
    """Writes one file of every class of near-duplicates as it is."""
    texts = _texts(spark, *paths)
    kept = minhash.dedup(texts, "path", seed=seed, **parameters)
    write_files(kept.select(_named("path").alias("file"), "text"), output)


def english_archives(spark: SparkSession, output: str, path: str, language: Model, threshold: float = 0.7) -> None:
    """Writes the English text records of archives as archives of the same names."""
    warc.register(spark)
    archive = spark.read.format("warc").option("path", path).load().where("record_type = 'conversion'")
    text = F.lower(F.make_valid_utf8(F.col("payload").cast("string")))
    rows = archive.withColumn("_v", naive_bayes.scorer(spark, {"v": language})(text)).where(is_english(F.col("_v.v_label"), F.col("_v.v_score"), threshold))
    write_archive(rows.select("target_uri", "date", "payload", _named("file").alias("name")), output, "name")
