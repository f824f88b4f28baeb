"""The row-level stages on a stream: they are column expressions, so the plan is the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import mask_all
from ..operators.quality_rules import rules


def ruled_and_masked(stream: DataFrame, text: str = "text") -> DataFrame:
    """Documents that no rule drops, masked; for batch and streaming frames alike."""
    return rules(stream, text).where("keep").withColumn(text, mask_all(F.col(text))).drop("keep", "drop_reason")


def first_seen(stream: DataFrame, time: str, text: str = "text", delay: str = "1 hour") -> DataFrame:
    """The first of documents with the same text; the state is dropped once the watermark has passed."""
    return stream.withColumn("text_md5", F.md5(text)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_md5"])
