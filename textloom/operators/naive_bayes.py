"""Multinomial naive Bayes over hashed words and word pairs: (label, score) verdicts for every document.

A model is a table of fixed size: for each of ``BUCKETS`` hashes how often its
features stand in texts of each class.  It is counted by Spark over all
labelled texts, can be saved and loaded, and goes to the executors as one
broadcast of that size; texts are then scored where they are, without a
shuffle, for as many models as are asked for in one pass.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean

#: Runs of letters; every Chinese character is a word.  The same in Python's, Java's and RE2's regular expressions but for the escapes.
TOKEN = r"[\x{4e00}-\x{9fff}]|[a-z0-9\x{df}-\x{24f}\x{430}-\x{45f}]+"
_TOKEN = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m.group(1), 16):04x}", TOKEN))
BUCKETS = 1 << 18
#: Words of a feature at most.
PAIRS = 2


class _Features(dict):
    """Feature to bucket; remembered up to a number."""

    def __missing__(self, feature: str) -> int:
        at = int.from_bytes(hashlib.md5(feature.encode("utf-8", "surrogatepass")).digest()[:4], "big") % BUCKETS
        if len(self) < 1_000_000:
            self[feature] = at
        return at


def features(known: _Features, text: str | None) -> np.ndarray:
    """The buckets of the words and word pairs of a lower-case text."""
    words = _TOKEN.findall(text) if text else []
    return np.array([*map(known.__getitem__, words), *(known[f"{a} {b}"] for a, b in zip(words, words[1:], strict=False))], np.int64)


@dataclass(frozen=True)
class Model:
    """Counts per class and bucket, and the labelled texts of each class."""

    classes: tuple[str, ...]
    counts: np.ndarray
    texts: np.ndarray
    empty: tuple[str, float] = ("unknown", 0.0)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each bucket that was seen in training, 0 elsewhere, by class; of each class.  A class
        without a text is never given."""
        seen = self.counts.sum(0) > 0
        total = self.counts.sum(1, keepdims=True) + seen.sum()
        own = np.where(seen, np.log((self.counts + 1.0) / np.maximum(total, 1)), 0.0)
        return own, np.where(self.texts > 0, np.log((self.texts + 1.0) / (self.texts.sum() + len(self.classes))), -np.inf)

    def save(self, spark: SparkSession, path: str) -> None:
        """One row per used bucket, bucket -1 for the texts of each class, -2 for the names; replaces what is there."""
        used = np.flatnonzero(self.counts.sum(0))
        rows = [(int(b), self.counts[:, b].astype(int).tolist(), None, None) for b in used]
        rows += [(-1, self.texts.astype(int).tolist(), None, None), (-2, [], list(self.classes), [self.empty[0], repr(self.empty[1])])]
        spark.createDataFrame(rows, "bucket INT, n ARRAY<BIGINT>, classes ARRAY<STRING>, empty ARRAY<STRING>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        """Fails where there is no model."""
        rows = spark.read.parquet(path).collect()  # at most BUCKETS + 2
        named = next(r for r in rows if r["bucket"] == -2)
        counts = np.zeros((len(named["classes"]), BUCKETS), np.int64)
        for r in rows:
            if r["bucket"] >= 0:
                counts[:, r["bucket"]] = r["n"]
        return Model(tuple(named["classes"]), counts, np.array(next(r["n"] for r in rows if r["bucket"] == -1), np.int64), (named["empty"][0], float(named["empty"][1])))


def _lower(text: str) -> Column:
    return F.lower(clean(F.col(text)))


def fit(rows: DataFrame, truths: dict[str, list[str]], text: str = "text", empty: dict[str, tuple[str, float]] | None = None) -> dict[str, Model]:
    """A model for each column of labels in ``truths`` (column: its classes) from one pass over the rows.

    Rows whose label is null or no class don't count.  A task adds its texts up before it sends the buckets it used.
    """
    names = list(truths)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, totals = _Features(), [np.zeros((len(truths[t]), BUCKETS), np.int64) for t in names]
        texts = [np.zeros(len(truths[t]), np.int64) for t in names]
        at = [{c: n for n, c in enumerate(truths[t])} for t in names]
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                own = [(k, at[k][c]) for k, c in enumerate(row[1:]) if c in at[k]]
                if own:
                    hit, n = np.unique(features(known, row[0]), return_counts=True)
                    for k, c in own:
                        totals[k][c, hit] += n
                        texts[k][c] += 1
        for k, _ in enumerate(names):
            for c, used in enumerate(totals[k]):
                hit = np.flatnonzero(used)
                yield pd.DataFrame({"model": k, "class": c, "bucket": np.r_[hit, -1], "n": np.r_[used[hit], texts[k][c]]})

    labelled = rows.select(_lower(text).alias("_t"), *[F.col(t).cast("string") for t in names]).where(F.coalesce(*names).isNotNull())
    merged = labelled.mapInPandas(count, "model INT, class INT, bucket INT, n BIGINT").groupBy("model", "class", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for k, t in enumerate(names):
        counts, texts = np.zeros((len(truths[t]), BUCKETS), np.int64), np.zeros(len(truths[t]), np.int64)
        mine = merged[merged["model"] == k]
        docs = mine["bucket"] == -1
        counts[mine["class"][~docs], mine["bucket"][~docs]] = mine["n"][~docs]
        texts[mine["class"][docs]] = mine["n"][docs]
        out[t] = Model(tuple(truths[t]), counts, texts, (empty or {}).get(t, ("unknown", 0.0)))
    return out


def scorer(spark: SparkSession, models: dict[str, Model]):
    """A column function from lower-case texts to a struct with ``<name>_label`` and ``<name>_score`` for each model."""
    shared = spark.sparkContext.broadcast({name: (m.classes, *m.weights(), m.empty) for name, m in models.items()})  # BUCKETS rows for each class
    schema = ", ".join(f"{name}_label string, {name}_score double" for name in models)

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, tables = _Features(), shared.value
        for batch in batches:
            found = [features(known, t) for t in batch]
            out = {}
            for name, (classes, own, prior, empty) in tables.items():
                labels, scores = [], []
                for x in found:
                    if x.size and (own[0, x] != 0).any():
                        s = own[:, x].sum(1) + prior
                        best = int(s.argmax())
                        labels.append(classes[best])
                        scores.append(round(float(1 / np.exp(s - s[best]).sum()), 6))
                    else:
                        labels.append(empty[0])
                        scores.append(empty[1])
                out[f"{name}_label"], out[f"{name}_score"] = labels, scores
            yield pd.DataFrame(out, columns=[f"{n}_{x}" for n in tables for x in ("label", "score")])

    return run


def predict(df: DataFrame, models: dict[str, Model], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, and label and score of each model: the likeliest class and its probability, the model's ``empty`` where no
    feature is known.  Ties go to the class named first."""
    return df.select(F.col(key), scorer(df.sparkSession, models)(_lower(text)).alias("_v")).select(key, "_v.*")


def classify(df: DataFrame, labelled: DataFrame, classes: list[str], empty: tuple[str, float] = ("unknown", 0.0), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, label, score``: fits on the rows of ``labelled(text, label)`` and gives a verdict for all."""
    model = fit(labelled, {"label": classes}, text, {"label": empty})["label"]
    return predict(df, {"v": model}, key, text).select(key, F.col("v_label").alias("label"), F.col("v_score").alias("score"))


def sanity(spark: SparkSession, model: Model, examples: list[tuple[str, str]]) -> list[tuple[str, str, float, bool]]:
    """(text, label, score, whether it is the expected one) for (text, expected label) after training."""
    rows = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(examples)], "n INT, text STRING")
    got = {r["n"]: r for r in predict(rows, {"v": model}, "n").collect()}
    return [(t, got[n]["v_label"], got[n]["v_score"], got[n]["v_label"] == want) for n, (t, want) in enumerate(examples)]


def metrics(predicted: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``label, tp, fp, fn, precision, recall`` against the given labels."""
    both = predicted.join(labels.select(F.col(key), F.col("label").alias("truth")), key)
    seen = both.select(F.explode(F.array_distinct(F.array("label", "truth"))).alias("l"), "label", "truth")
    agg = seen.groupBy(F.col("l").alias("label")).agg(
        F.count(F.when((F.col("label") == F.col("l")) & (F.col("truth") == F.col("l")), 1)).alias("tp"),
        F.count(F.when((F.col("label") == F.col("l")) & (F.col("truth") != F.col("l")), 1)).alias("fp"),
        F.count(F.when((F.col("label") != F.col("l")) & (F.col("truth") == F.col("l")), 1)).alias("fn"),
    )
    ratio = lambda a, b: F.round(F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1)), 6)
    return agg.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))
