"""Repeated lines across documents: each line that occurs more than once anywhere is removed everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unfolded(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, line``: lines keep their line feed; no empty line follows the last one."""
    parts = F.split(F.col(text), "\n")
    last = F.size(parts) - 1
    rows = df.select(F.col(key), F.posexplode(parts).alias("pos", "line"), last.alias("last"))
    return rows.where(~((F.col("pos") == F.col("last")) & (F.col("line") == ""))).select(key, "pos", F.when(F.col("pos") < F.col("last"), F.concat("line", F.lit("\n"))).otherwise(F.col("line")).alias("line"))


def frequencies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``line, n`` by the line's hash, for lines that occur more than once."""
    return unfolded(df, key, text).groupBy(F.md5("line").alias("line")).agg(F.count("*").alias("n")).where("n > 1")


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, kept_lines``: every document without the lines that occur more than once, in any document.

    Lines travel as hash, key and position only; counting by hash brings the single survivor's place along.  The places
    go back to the documents, whose own arrays of lines are cut there.  Counts are combined before the shuffle.
    Documents left empty stay.
    """
    single = unfolded(df, key, text).groupBy(F.md5("line").alias("h")).agg(F.count("*").alias("n"), F.min(key).alias(key), F.min("pos").alias("pos")).where("n = 1")
    kept = single.groupBy(key).agg(F.sort_array(F.collect_set("pos")).alias("_kept"))
    # split below the join: within the lambda it would be evaluated for each line
    rows = df.select(key, F.split(F.col(text), "\n").alias("_lines")).join(kept, key, "left")
    here = F.array_join(F.transform("_kept", lambda i: F.element_at("_lines", i + 1)), "\n")
    end = F.when(F.element_at("_kept", -1) < F.size("_lines") - 1, "\n").otherwise("")  # all but a text's last line have one
    return rows.select(key, F.coalesce(F.concat(here, end), F.lit("")).alias(text), F.coalesce(F.size("_kept"), F.lit(0)).cast("bigint").alias("kept_lines"))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``text_md5, n, first_id``: groups of documents with the same text, of two or more."""
    return df.where(F.col(text).isNotNull()).groupBy(F.md5(text).alias("text_md5")).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n > 1")
