"""Problem 8: mixing sources to target weights.

Sizes are tokens of a public tokenizer, whose vocabulary file is a parameter.
Every document of a source has the same expected number of copies: the tokens
its source should give over those it has.  Systematic sampling then takes
documents in a fixed pseudo-random order, adds their expected copies up within
the source, adds one offset per source, and emits a document once per integer
boundary that the sum crosses.  No document is used more than the cap allows,
as the expected copies never exceed it.

The prefix sums are found without gathering a source in one task: documents are
put into buckets of the order, of about ``IN_BUCKET`` documents each, the
buckets are counted, and places are numbered within a bucket only.

Defined results: a null or empty text has 0 tokens; documents without a source
or with a source without target are not used, and are reported with share 0;
sources without documents are reported with 0 tokens, and the shares of the
others are taken relative to their sum; a cap of null counts as 1; repeated
rows are documents of their own; other columns are ignored whatever their
names.
"""

from __future__ import annotations

import base64
from functools import lru_cache, partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import map_rows, pick

#: Vocabulary of byte-level BPE as ranks, outside the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Documents of a bucket of the sampling order; a source has as many buckets as that takes.
IN_BUCKET = 50_000


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a vocabulary file, once per process.  Its special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(path: str):
    def work(docs, texts, sources):
        encode = encoder(path).encode_ordinary
        for d, t, s in zip(docs, texts, sources, strict=True):
            yield d, s, len(encode(t)) if t else 0

    return work


def token_sizes(documents: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc, source, tokens`` of every document."""
    return map_rows(pick(documents, doc, text, source), f"`{doc}` BIGINT, source STRING, tokens BIGINT", partial(_sizes, vocabulary))


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Per source: target share, cap, documents, tokens, and expected copies per document.

    Without ``total_tokens`` the total is the largest at which every source with documents can give its share.
    """
    have = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    want = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    both = want.join(have, "source", "full").na.fill(0, ["documents", "tokens"]).na.fill(0.0, ["target_share"])
    everything = Window.partitionBy()  # one row per source
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    both = both.withColumn("share", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(everything)).otherwise(0.0))
    limit = F.min(F.when(usable, F.col("tokens") * F.col("max_repeats") / F.col("share"))).over(everything)
    total = limit if total_tokens is None else F.least(F.lit(float(total_tokens)), limit)
    return both.withColumn("rate", F.when(usable, F.least(F.col("share") * total / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)).drop("share")


def copies(sizes: DataFrame, rate: DataFrame, doc: str = "doc_id", seed: int = 42) -> DataFrame:
    """``doc, source, tokens, copies`` by systematic sampling; documents not taken have 0."""
    order = F.xxhash64(F.lit(seed), F.col(doc))
    sources = F.broadcast(rate.select("source", "rate", F.ceil((F.col("documents") + 1) / IN_BUCKET).alias("buckets")))  # one row per source
    placed = sizes.where(F.col("source").isNotNull()).join(sources.select("source", "buckets"), "source").withColumn("o", order)
    placed = placed.withColumn("b", F.floor((F.col("o") / F.lit(float(1 << 63)) + 1) / 2 * F.col("buckets"))).drop("buckets")
    counts = placed.groupBy("source", "b").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["before"])
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(1 << 30)) / float(1 << 30)
    bounds = before.join(sources, "source").select("source", "b", "before", "rate", offset.alias("offset"))
    place = F.row_number().over(Window.partitionBy("source", "b").orderBy("o", doc, "tokens"))
    at = placed.withColumn("place", place).join(bounds, ["source", "b"])
    end = (F.col("before") + F.col("place")) * F.col("rate") + F.col("offset")
    begin = (F.col("before") + F.col("place") - 1) * F.col("rate") + F.col("offset")
    return at.select(doc, "source", "tokens", (F.floor(end) - F.floor(begin)).cast("int").alias("copies"))


def mixture(documents: DataFrame, targets: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", total_tokens: float | None = None, seed: int = 42, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(the mixture ``doc, source, tokens, copy`` with a row per copy; the report of the shares reached)."""
    sizes = token_sizes(documents, doc, text, source, vocabulary).persist(StorageLevel.MEMORY_AND_DISK)
    rate = rates(sizes, targets, total_tokens)
    taken = copies(sizes, rate, doc, seed)
    mixed = taken.where(F.col("copies") > 0).select(doc, "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    got = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum((F.col("copies") > 0).cast("long")).alias("used_documents"), F.max("copies").alias("most_copies"))
    whole = F.sum("mixed_tokens").over(Window.partitionBy())  # one row per source
    report = rate.join(got, "source", "left").na.fill(0, ["mixed_tokens", "used_documents", "most_copies"])
    report = report.withColumn("actual_share", F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0))
    return mixed, report.select("source", "target_share", "actual_share", "max_repeats", "most_copies", "documents", "used_documents", "tokens", "mixed_tokens")
