"""The registered queries of the core library, each over its whole tables, and their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import html_to_text, html_to_text_sql
from ..functions.masking import mask_all, mask_emails, mask_ips, mask_phones
from ..functions.text import normalized
from ..io import spread, table
from ..operators import lines, minhash, naive_bayes, quality_rules, similar
from ..sinks import tokens
from ..sources import files, warc
from . import pipeline
from .sql import SQL as SQL

#: Input of a task below which all pairs are worth the disk that another shuffle of the texts takes.
PAIRS_PER_TASK = 2 << 20


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


def doc_word_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.with_stats(_docs(spark, d)).drop("text")


def quality_rules_(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.rules(_docs(spark, d)).select("doc_id", "keep", "drop_reason")


def quality_rule_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.summary(_docs(spark, d))


def _masked(mask):
    def query(spark: SparkSession, d: str) -> DataFrame:
        m = mask(F.col("text"))
        return _docs(spark, d).select("doc_id", F.md5(m["text"]).alias("masked_md5"), m["n"].cast("bigint").alias("n"))

    return query


def mask_all_(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(mask_all(F.col("text"))).alias("masked_md5"))


def line_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return lines.frequencies(_docs(spark, d))


def dedup_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.dedup(_docs(spark, d)).select("doc_id", F.md5("text").alias("text_md5"), "kept_lines")


def exact_doc_groups(spark: SparkSession, d: str) -> DataFrame:
    return lines.exact_groups(_docs(spark, d))


def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(normalized(F.coalesce("text", F.lit("")))).alias("normalized_md5"))


def doc_shingles(spark: SparkSession, d: str) -> DataFrame:
    return minhash.shingled(_docs(spark, d)).select("doc_id", F.size("shingles").cast("bigint").alias("n_shingles"), F.shiftright(F.array_min("shingles"), 31).alias("min_hash"))


def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    sig = minhash.signature(20)("shingles")
    return minhash.shingled(_docs(spark, d)).select("doc_id", F.md5(F.array_join(sig.cast("array<string>"), ",")).alias("signature_md5"))


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sets = minhash.prepared(_docs(spark, d))
    rep = minhash.representatives(sets, "doc_id")
    return sets.join(rep.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi"), rep


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"), PAIRS_PER_TASK)


def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return minhash.candidates(_sets(spark, d)[0], "doc_id")


def shingle_set_members(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d)[1]


def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similar.similar_pairs(_texts(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


def duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    return minhash.clusters(_texts(spark, d))


def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return minhash.cluster_sizes(minhash.clusters(_texts(spark, d))).where("n > 1")


def dedup_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return minhash.dedup(_texts(spark, d)).select("doc_id")


def dedup_fuzzy_seeded(spark: SparkSession, d: str) -> DataFrame:
    return minhash.dedup(_texts(spark, d), seed=42).select("doc_id")


def _language(spark: SparkSession, d: str) -> DataFrame:
    return naive_bayes.classify(_docs(spark, d), pipeline.language_samples(table(spark, d, "lang_samples")), pipeline.LANGUAGES)


def english_documents(spark: SparkSession, d: str) -> DataFrame:
    return _language(spark, d).where(pipeline.is_english(F.col("label"), F.col("score"))).select("doc_id")


def label_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.coalesce(pipeline.remapped(F.col("lang")), F.lit("")).alias("label")).agg(F.count("*").alias("n"))


def _judged(column: str, empty=("unknown", 0.0)):
    def query(spark: SparkSession, d: str) -> DataFrame:
        docs = _docs(spark, d)
        truth = pipeline.judged(table(spark, d, "labels"), column, *pipeline.CLASSES[column])
        return naive_bayes.classify(docs, docs.join(truth, "doc_id"), pipeline.CLASSES[column], empty)

    return query


def classifier_metrics(spark: SparkSession, d: str) -> DataFrame:
    truth = pipeline.judged(table(spark, d, "labels"), "toxic", "toxic", "non-toxic")
    return naive_bayes.metrics(_judged("toxic")(spark, d), truth)


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.training_rows(_docs(spark, d), table(spark, d, "labels"), seed=42).select("doc_id", "label", F.md5("text").alias("text_md5"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages", "page_id", "html").select("page_id", F.md5(html_to_text_sql(F.col("html"))).alias("text_md5"))


def html_text_parsed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages", "page_id", "html").select("page_id", html_to_text("html").alias("text"))


def _models(spark: SparkSession, d: str) -> dict:
    return pipeline.fit_models(_docs(spark, d), table(spark, d, "labels"), table(spark, d, "lang_samples"))


def filter_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.filter_documents(_docs(spark, d), _models(spark, d)).select("doc_id", F.md5("text").alias("masked_md5"))


def filter_stats(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.filter_stats(_docs(spark, d), _models(spark, d))


def filter_stats_by_source(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.filter_stats(table(spark, d, "documents", "doc_id", "text", "source"), _models(spark, d), by="source")


def kept_text_share(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "text", "lang").select("text", F.coalesce("lang", F.lit("")).alias("lang"))
    size = F.char_length("text")
    agg = quality_rules.rules(docs).groupBy("lang").agg(F.sum(F.when(F.col("keep"), size).otherwise(0)).alias("kept_chars"), F.sum(size).alias("total_chars"))
    return agg.withColumn("share", F.round(F.col("kept_chars") / F.greatest(F.col("total_chars"), F.lit(1)), 6))


def conversion_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "wet_records").where("record_type = 'conversion'").select("record_id", "file_id", F.char_length("payload").alias("n_chars"), F.octet_length("payload").alias("n_bytes"))
    return rows.distinct().groupBy("file_id").agg(F.count("*").alias("records"), F.sum("n_chars").alias("n_chars"), F.sum("n_bytes").alias("n_bytes"))


def long_conversions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wet_records").where((F.col("record_type") == "conversion") & (F.char_length("payload") >= 200)).select("record_id").distinct()


def sampled_negatives(spark: SparkSession, d: str) -> DataFrame:
    return files.sample(_docs(spark, d).where("char_length(text) >= 100").select("doc_id"), 100)


def token_stream(spark: SparkSession, d: str) -> DataFrame:
    ids = F.col("ids")
    return tokens.tokenized(_docs(spark, d)).select("doc_id", F.size(ids).alias("n_tokens"), F.element_at(ids, 1).alias("first_id"), F.element_at(ids, -1).alias("last_id"))


def byte_stream(spark: SparkSession, d: str) -> DataFrame:
    ids = F.col("ids")
    return tokens.tokenized(_docs(spark, d), path=None).select("doc_id", F.size(ids).cast("bigint").alias("n_tokens"), F.element_at(ids, -1).alias("last_id"))


def token_totals(spark: SparkSession, d: str) -> DataFrame:
    return tokens.totals(tokens.tokenized(_docs(spark, d), path=None))


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.posexplode(files.universal_lines(F.col("text"))).alias("pos", "line"))
    return rows.select("doc_id", "pos", F.md5("line").alias("line_md5"))


def document_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.posexplode(files.blocks(F.col("text"))).alias("pos", "block"))
    return rows.select("doc_id", "pos", F.md5("block").alias("block_md5"))


def http_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "wet_records").select(files.stripped_urls(F.col("target_uri")).alias("url")).where("url is not null").distinct()


def file_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return files.catalogue(table(spark, d, "crawl_files"), "wet_path")


def output_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_files").select("file_id", tokens.output_name(F.col("wet_path")).alias("name"))


def rule_stats_by_file(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "wet_records").where("record_type = 'conversion'").select("record_id", "file_id", F.col("payload").alias("text")).distinct()
    ruled = quality_rules.rules(rows)
    return ruled.groupBy("file_id", F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count("*").alias("n"))


def warc_scan(spark: SparkSession, d: str) -> DataFrame:
    """The text records written as archives, one for each file, to the shared folder, and read again."""
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp()}/warc-{uuid.uuid4().hex}"
    rows = table(spark, d, "wet_records").where("record_type = 'conversion' and payload is not null").select("record_id", "file_id", "target_uri", F.col("warc_date").alias("date"), F.col("payload").cast("binary").alias("payload")).distinct()
    tokens.write_archive(rows.withColumn("file", F.concat(F.coalesce(F.col("file_id").cast("string"), F.lit("none")), F.lit(".warc.wet.gz"))), folder, "file")
    got = warc.conversions(spark.read.format("warc").option("path", folder).load())
    return got.select(F.regexp_extract("file", r"([^/]+)\.warc\.wet\.gz$", 1).alias("file"), "target_uri", F.md5("text").alias("text_md5"), F.octet_length("text").alias("n_bytes"))


QUERIES = {
    "doc_word_stats": doc_word_stats,
    "quality_rules": quality_rules_,
    "quality_rule_summary": quality_rule_summary,
    "mask_emails": _masked(mask_emails),
    "mask_phones": _masked(mask_phones),
    "mask_ips": _masked(mask_ips),
    "mask_all": mask_all_,
    "line_frequencies": line_frequencies,
    "dedup_lines": dedup_lines,
    "exact_doc_groups": exact_doc_groups,
    "normalized_text": normalized_text,
    "doc_shingles": doc_shingles,
    "minhash_signatures": minhash_signatures,
    "shingle_set_members": shingle_set_members,
    "lsh_candidates": lsh_candidates,
    "near_duplicate_pairs": near_duplicate_pairs,
    "duplicate_clusters": duplicate_clusters,
    "cluster_sizes": cluster_sizes,
    "dedup_fuzzy": dedup_fuzzy,
    "dedup_fuzzy_seeded": dedup_fuzzy_seeded,
    "language_id": _language,
    "english_documents": english_documents,
    "label_variants": label_variants,
    "toxicity": _judged("toxic"),
    "nsfw": _judged("nsfw"),
    "quality_class": _judged("quality", ("cc", 1.0)),
    "training_rows": training_rows,
    "classifier_metrics": classifier_metrics,
    "html_text": html_text,
    "html_text_parsed": html_text_parsed,
    "filter_pipeline": filter_pipeline,
    "filter_stats": filter_stats,
    "filter_stats_by_source": filter_stats_by_source,
    "kept_text_share": kept_text_share,
    "conversion_records": conversion_records,
    "long_conversions": long_conversions,
    "sampled_negatives": sampled_negatives,
    "token_stream": token_stream,
    "byte_stream": byte_stream,
    "token_totals": token_totals,
    "document_lines": document_lines,
    "document_blocks": document_blocks,
    "http_urls": http_urls,
    "file_catalogue": file_catalogue,
    "output_names": output_names,
    "rule_stats_by_file": rule_stats_by_file,
    "warc_scan": warc_scan,
}
