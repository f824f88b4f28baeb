"""The queries of this subpackage by name, each over its whole tables, and SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..io import spread
from . import abuse, boilerplate, language, leakage, mixture, mojibake, pii, repetition, text_form
from .sql import SQL as SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that is smaller than 1 MB for each core is spread over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, 1 << 20) if name in ("documents", "wet_records", "pages") else df


def _conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "wet_records").where(F.col("record_type") == "conversion")


def _samples(spark: SparkSession, sf_dir: str) -> list[str]:
    return mojibake.sample_texts(_table(spark, sf_dir, "lang_samples"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mentions(_table(spark, sf_dir, "documents"))


def p1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.masked(_table(spark, sf_dir, "documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.garbled_records(_conversions(spark, sf_dir), _table(spark, sf_dir, "lang_samples"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = mojibake.repair(_conversions(spark, sf_dir), _table(spark, sf_dir, "lang_samples"), only_garbled=True)
    return fixed.select("record_id", F.size("garbled").alias("garbled_lines"), F.col("restored").alias("payload")).distinct()


def _field(spark: SparkSession, sf_dir: str) -> abuse.Field:
    return abuse.fit(*abuse.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.offending(_table(spark, sf_dir, "documents"), _field(spark, sf_dir))


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(_table(spark, sf_dir, "documents"), _field(spark, sf_dir))


def p3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.offsets(_table(spark, sf_dir, "documents"), _field(spark, sf_dir))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(_table(spark, sf_dir, "documents"), _field(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = text_form.text_forms(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"), _samples(spark, sf_dir))
    return forms.where(F.col("form").isin("list", "table", "junk")).select("doc_id", "form").distinct()


def p4_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_form.text_forms(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"), _samples(spark, sf_dir))


def p4_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text_form.voted(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"), _samples(spark, sf_dir))
    return rows.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in text_form.STATS[1:]])


def _language_model(spark: SparkSession, sf_dir: str) -> language.Model:
    return language.load(_table(spark, sf_dir, "lang_samples"), _table(spark, sf_dir, "common_words"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(_table(spark, sf_dir, "documents"), _language_model(spark, sf_dir))


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(_table(spark, sf_dir, "documents"), _language_model(spark, sf_dir))


def _line_model(spark: SparkSession, sf_dir: str) -> boilerplate.LineModel:
    return boilerplate.fit(*boilerplate.training_pages(_table(spark, sf_dir, "pages")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.boilerplate_lines(_conversions(spark, sf_dir), _line_model(spark, sf_dir), pages=_table(spark, sf_dir, "pages"))


def p6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_text(_conversions(spark, sf_dir), _line_model(spark, sf_dir), pages=_table(spark, sf_dir, "pages"))


def p6_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    rows, border = boilerplate.training_pages(pages)
    rows.unpersist()
    return boilerplate.html_content(pages, border=border)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def p7_decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.decontaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[1]


def p8_share_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source keeps its cap and, of those with documents, comes within two points of its share."""
    rows = mixture.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "mix_targets"))[1].where(F.col("source").isNotNull())
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0)
    wanted = F.when(usable, F.col("target_share")).otherwise(0.0)
    rows = rows.withColumn("wanted", wanted / F.sum(wanted).over(Window.partitionBy()))  # one row per source
    return rows.select("source", "documents", "max_repeats", (F.col("most_copies") <= F.coalesce("max_repeats", F.lit(0))).alias("cap_kept"), (F.abs(F.col("actual_share") - F.col("wanted")) < 0.02).alias("share_kept"))


def p9_repeated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repeated_shares(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("repeated_share", 6).alias("repeated_share"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetitive(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"), _samples(spark, sf_dir))


def p9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_masked, p2_found, p2_repaired, p3_found, p3_scores, p3_spans, p3_rates, p4_found, p4_statistics, p4_text_statistics, p5_found, p5_segments, p6_found, p6_main_text, p6_html_content, p7_found, p7_spans, p7_decontaminated, p8_mixture, p8_shares, p8_share_check, p9_repeated_share, p9_found, p9_repetition)}
