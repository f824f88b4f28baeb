"""Command lines: ``python -m textloom filter | tokenize | paths``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .functions.masking import mask_all
from .operators import quality_rules
from .operators.naive_bayes import Model
from .plans import pipeline
from .session import progress, session
from .sinks import tokens
from .sources import files, warc


def _filter(spark, a) -> None:
    warc.register(spark)
    archive = spark.read.format("warc").option("path", a.input_dir).load()
    docs = warc.conversions(archive).select(F.monotonically_increasing_id().alias("doc_id"), "text", "file")
    if a.models:
        config = pipeline.Config(use_quality=not a.no_quality)
        names = [n for n in pipeline.CLASSES if n != "quality" or config.use_quality]
        rows = pipeline.decided(docs, {n: Model.load(spark, f"{a.models}/{n}") for n in names}, config, "file")
    else:
        rows = quality_rules.rules(docs).select("doc_id", "text", "file", F.when(F.col("keep"), "kept").otherwise("rules").alias("stage"))
    rows = rows.persist()
    kept = rows.where("stage = 'kept'").withColumn("text", mask_all(F.col("text")))
    tokens.write_texts(kept, a.output_dir, order="doc_id")
    total = max(1, rows.count())
    for stage, n in sorted((r["stage"], r["n"]) for r in rows.groupBy("stage").agg(F.count("*").alias("n")).collect()):
        print(f"{stage:10s} {n:12d} {100 * n / total:6.2f} %")
    for r in archive.where("record_type = 'broken'").select("file", "error").collect():  # one row for each broken file
        print(f"broken: {r['file']}: {r['error']}", file=sys.stderr)


def _tokenize(spark, a) -> None:
    docs = files.read_blocks(spark, f"{a.input_dir}/*.txt").select(F.monotonically_increasing_id().alias("doc_id"), "text")
    ids = tokens.tokenized(docs, path=a.vocabulary).persist()
    manifest = tokens.write_stream(ids, a.output_path)
    print(manifest.agg(F.sum("n_tokens")).first()[0] or 0, "tokens")


def _paths(spark, a) -> None:
    chosen = files.sample(files.read_paths(spark, a.list).distinct(), a.n_files, "wet_path", a.seed)
    tokens.write_urls(chosen.select(F.concat(F.lit(a.base), "wet_path").alias("url")), a.output_dir)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom")
    sub = top.add_subparsers(dest="command", required=True)
    f = sub.add_parser("filter", help="archives of text records to text files, one for each archive")
    f.add_argument("--input-dir", required=True)
    f.add_argument("--output-dir", required=True)
    f.add_argument("--models", help="folder of saved models; without it only the rules and the masks run")
    f.add_argument("--no-quality", action="store_true")
    t = sub.add_parser("tokenize", help="text files to a stream of 16-bit tokens")
    t.add_argument("--input-dir", required=True)
    t.add_argument("--output-path", required=True)
    t.add_argument("--vocabulary", default=tokens.VOCABULARY)
    p = sub.add_parser("paths", help="a seeded choice of archive paths, as addresses")
    p.add_argument("--list", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--n-files", type=int, default=200)
    p.add_argument("--seed", type=int, default=336)
    p.add_argument("--base", default="")
    for x in (f, t, p):
        x.add_argument("--workers", type=int, help="threads, where no cluster is named")
    return top


def main(argv: list[str] | None = None, spark=None) -> None:
    a = parser().parse_args(argv)
    spark = spark or session(f"textloom {a.command}", f"local[{a.workers}]" if a.workers else None)
    with progress(spark, lambda x: print(x, file=sys.stderr)):
        {"filter": _filter, "tokenize": _tokenize, "paths": _paths}[a.command](spark, a)


if __name__ == "__main__":
    main()
