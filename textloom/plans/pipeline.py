"""The filter pipeline: rules, language, nsfw, toxicity, quality, then masking, with a reason for every drop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masking import mask_all
from ..functions.text import clean
from ..operators import naive_bayes, quality_rules
from ..operators.naive_bayes import Model

LANGUAGES = ["de", "en", "es", "fr", "it", "pt", "ru", "zh"]
CLASSES = {"language": LANGUAGES, "nsfw": ["nsfw", "non-nsfw"], "toxic": ["toxic", "non-toxic"], "quality": ["wiki", "cc"]}
EMPTY = {"quality": ("cc", 1.0)}
#: Labels of variants of Chinese.
VARIANTS = {"zh-cn": "zh", "zh-tw": "zh", "zh-hans": "zh", "zh-hant": "zh", "zh_hans": "zh", "zh_hant": "zh", "zh-hk": "zh"}


@dataclass(frozen=True)
class Config:
    """Thresholds; the names of the classes are those of the verdicts."""

    language: str = "en"
    min_language: float = 0.65
    max_nsfw: float = 0.5
    max_toxic: float = 0.5
    min_quality: float = 0.5
    use_quality: bool = True


def remapped(label: Column) -> Column:
    """A language label with variants made one; others stay as they are, in lower case and stripped."""
    low = F.lower(F.trim(label))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in VARIANTS.items() for x in kv]), low), low)


def language_samples(samples: DataFrame) -> DataFrame:
    """``text, label`` of clean sentences of known language."""
    return samples.select("text", remapped(F.col("lang")).alias("label"))


def is_english(label: Column, score: Column, threshold: float = 0.7) -> Column:
    """Whether a verdict says English with at least this score."""
    return F.coalesce((label == "en") & (score >= threshold), F.lit(False))


def judged(labels: DataFrame, column: str, yes: str, no: str) -> DataFrame:
    """``doc_id, label`` from 0/1 judgements; the highest of several counts, nulls don't."""
    return labels.groupBy("doc_id").agg(F.max(column).alias("v")).where("v is not null").select("doc_id", F.when(F.col("v") == 1, yes).otherwise(no).alias("label"))


def judgements(labels: DataFrame) -> DataFrame:
    """``doc_id, nsfw, toxic, quality`` as class names, from one pass over the judgements."""
    once = labels.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("nsfw", "toxic", "quality")])
    named = lambda c: F.when(F.col(c) == 1, CLASSES[c][0]).when(F.col(c).isNotNull(), CLASSES[c][1]).alias(c)
    return once.select("doc_id", *[named(c) for c in ("nsfw", "toxic", "quality")])


def fit_models(documents: DataFrame, labels: DataFrame, samples: DataFrame) -> dict[str, Model]:
    """The four models: language from clean sentences, the others from the judged documents, in one pass each."""
    out = naive_bayes.fit(language_samples(samples).withColumnRenamed("label", "language"), {"language": LANGUAGES})
    rows = documents.select("doc_id", "text").join(judgements(labels), "doc_id")
    return out | naive_bayes.fit(rows, {c: CLASSES[c] for c in ("nsfw", "toxic", "quality")}, empty=EMPTY)


def training_rows(documents: DataFrame, labels: DataFrame, positives_pass_rules: bool = True, seed: int | None = None) -> DataFrame:
    """``doc_id, label, text`` for a quality model: positives, on which the rules are applied again, and negatives, each on one line, empty ones left out.

    With a seed the rows come in the order of its hash with the key, otherwise positives first.
    """
    rows = documents.select("doc_id", "text").join(judged(labels, "quality", "wiki", "cc"), "doc_id")
    if positives_pass_rules:
        rows = quality_rules.rules(rows).where((F.col("label") != "wiki") | F.col("keep"))
    rows = rows.select("doc_id", "label", clean(F.col("text")).alias("text")).where("text <> ''")
    order = [F.desc(F.col("label") == "wiki")] if seed is None else [F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f"/{seed}")))]
    return rows.orderBy(*order, "doc_id")


def decided(documents: DataFrame, models: dict[str, Model], config: Config = Config(), *keep: str) -> DataFrame:
    """``doc_id, text, stage`` and the columns of ``keep``: the first stage that drops a document, or ``kept``.

    Only documents that the rules keep are scored.
    """
    ruled = quality_rules.rules(documents.select("doc_id", "text", *keep)).drop("keep")
    names = [n for n in CLASSES if n != "quality" or config.use_quality]
    # what the rules drop reaches the scorer as null; a filter would repeat the rules' expressions once for each mention
    passed = F.when(F.col("drop_reason").isNull(), F.lower(clean(F.col("text"))))
    rows = ruled.withColumn("_v", naive_bayes.scorer(documents.sparkSession, {n: models[n] for n in names})(passed))
    stage = (
        F.when(F.col("drop_reason").isNotNull(), "rules")
        .when((F.col("_v.language_label") != config.language) | (F.col("_v.language_score") < config.min_language), "language")
        .when((F.col("_v.nsfw_label") == "nsfw") & (F.col("_v.nsfw_score") > config.max_nsfw), "nsfw")
        .when((F.col("_v.toxic_label") == "toxic") & (F.col("_v.toxic_score") > config.max_toxic), "toxic")
    )
    if config.use_quality:
        likely = F.when(F.col("_v.quality_label") == "wiki", F.col("_v.quality_score")).otherwise(1 - F.col("_v.quality_score"))
        stage = stage.when(likely < config.min_quality, "quality")
    return rows.select("doc_id", "text", *keep, stage.otherwise("kept").alias("stage"))


def filter_documents(documents: DataFrame, models: dict[str, Model], config: Config = Config()) -> DataFrame:
    """``doc_id, text`` of the documents kept, masked."""
    return decided(documents, models, config).where("stage = 'kept'").select("doc_id", mask_all(F.col("text")).alias("text"))


def filter_stats(documents: DataFrame, models: dict[str, Model], config: Config = Config(), by: str | None = None) -> DataFrame:
    """``stage, n, pct``: how many documents each stage drops, of all or, with ``by``, of each of its groups (an input file, a source)."""
    keys = [by] if by else []
    counts = decided(documents, models, config, *keys).groupBy(*keys, "stage").agg(F.count("*").alias("n"))
    if by:
        total = counts.groupBy(by).agg(F.sum("n").alias("total"))
        rows = counts.join(total.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    else:
        rows = counts.join(F.broadcast(documents.agg(F.greatest(F.count("*"), F.lit(1)).alias("total"))))  # one row
    return rows.select(*keys, "stage", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))
