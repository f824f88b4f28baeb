"""Heuristic quality rules with the reason for which a document is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, lines, words

# The bounds of the rules.
MIN_WORDS, MAX_WORDS = 50, 100_000
MIN_MEAN_LENGTH, MAX_MEAN_LENGTH = 3.0, 10.0
MAX_ELLIPSIS_SHARE = 0.3
MIN_LETTER_SHARE = 0.8


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, n_alpha, sum_alpha_len, n_lines, n_ellipsis."""
    alpha = F.filter(F.col("_words"), lambda w: w.rlike("[a-zA-Z]"))
    return (
        df.withColumn("_words", words(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_alpha", alpha)
        .withColumn("_lines", lines(F.coalesce(F.col(text), F.lit(""))))
        .withColumns(
            {
                "n_words": F.size("_words").cast("bigint"),
                "n_alpha": F.size("_alpha").cast("bigint"),
                "sum_alpha_len": F.char_length(F.array_join("_alpha", "")).cast("bigint"),
                "n_lines": F.size("_lines").cast("bigint"),
                "n_ellipsis": F.size(F.filter("_lines", lambda x: x.rlike(f"\\.\\.\\.[{SPACE}]*$"))).cast("bigint"),
            }
        )
        .drop("_words", "_alpha", "_lines")
    )


def drop_reason() -> Column:
    """Over the columns of :func:`with_stats`: the first rule a document breaks, or null."""
    mean = F.col("sum_alpha_len") / F.when(F.col("n_alpha") > 0, F.col("n_alpha"))
    return (
        F.when(F.col("n_words") == 0, "empty")
        .when((F.col("n_alpha") < MIN_WORDS) | (F.col("n_alpha") > MAX_WORDS), "word_count")
        .when((mean < MIN_MEAN_LENGTH) | (mean > MAX_MEAN_LENGTH), "mean_word_length")
        .when(F.col("n_ellipsis") / F.when(F.col("n_lines") > 0, F.col("n_lines")) > MAX_ELLIPSIS_SHARE, "ellipsis_lines")
        .when(F.col("n_alpha") / F.when(F.col("n_words") > 0, F.col("n_words")) < MIN_LETTER_SHARE, "letter_words")
    )


def rules(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``keep`` and ``drop_reason``; a null text is an empty one."""
    names = ("n_words", "n_alpha", "sum_alpha_len", "n_lines", "n_ellipsis")
    return with_stats(df, text).withColumn("drop_reason", drop_reason()).withColumn("keep", F.col("drop_reason").isNull()).drop(*names)


def summary(df: DataFrame, text: str = "text") -> DataFrame:
    """Documents and their percentage per reason; kept ones have the reason ``kept``."""
    counts = rules(df.select(text), text).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))
    total = df.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))
    # one row on either side of this join
    return counts.join(F.broadcast(total)).select("drop_reason", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))
