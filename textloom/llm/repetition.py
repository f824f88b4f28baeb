"""Problem 9: repetition inside a single document.

Perplexity under a modified Kneser-Ney trigram model that Spark counts over the
whole corpus, with two marks before the first word.  A trigram counts once per
document: repeating it there doesn't make it usual.  Words are 64-bit hashes,
trigrams are counted by their three words, and the lower orders by the distinct
words before them, so the model is the same however the rows are partitioned.

Counting is exact, and all n-grams of all orders count, whatever the size of the
corpus: the model stays in Spark, where each trigram of a block of documents is
joined with its probability.  The trigrams are shuffled once, by their middle
words, and counted and joined where they are.  (:func:`fit` makes a bounded
model in arrays, of n-grams with at least one in ``SIZE`` of all counts of their
order; the queries don't use it.)

While a document is read, continuations seen earlier in the same document raise
the probability (an adaptive cache over the model), so that a document which
says the same things again has a low perplexity.  Each language has its own
lower and upper band around the median of its documents.  A document below the
lower band is a candidate for repetition, and the exact share of its words in
later copies follows for it; one above the upper band is marked only, as odd
words don't keep a document from repeating itself.

Words are compared without letter case, punctuation and apostrophes, and
numbers as one word; each Chinese character is a word, and a phrase there is
longer.  Defined results: null, blank and wordless texts have share 0, no
perplexity and no band; texts shorter than a phrase have share 0; repeated rows
give rows of their own; other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text_form
from .batches import chunks, map_rows, pick

#: An n-gram is kept from this part of all counts of its order on, so at most so many are.
SIZE = 1 << 20
#: Trigrams that a task adds up before it sends them.
HELD = 2_000_000
PHRASE = 4
PHRASE_HAN = 7
#: Probability given to what followed the same two words earlier in the document.
CACHE = 0.7
#: Bands as factors of the median surprisal of a language.
LOWER, UPPER = 0.85, 1.3
SHARE = 0.5

_WORD = re.compile(r"[㐀-鿿]|\d+|[^\W\d㐀-鿿_]+")
_QUOTES = re.compile("['’‘ʼ`]")
#: The hash that stands before the first word of a text.
START = np.uint64(0x27D4EB2F165667C5)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Vocabulary(dict):
    """Word to its row; rows hold the word's hash, whether it is Chinese, and the number of its set of languages."""

    LIMIT = 400_000

    def __init__(self, langs: dict[str, int]):
        super().__init__()
        self.langs = langs
        self.reset()

    def reset(self):
        self.clear()
        self.hash: list[int] = []
        self.han: list[bool] = []
        self.spoken: list[int] = []

    def __missing__(self, word: str) -> int:
        if word[0].isdigit() and word != "0":
            self[word] = at = self["0"]
            return at
        self[word] = at = len(self.hash)
        self.hash.append(xxhash.xxh3_64_intdigest(word))
        self.han.append("㐀" <= word <= "鿿")
        self.spoken.append(self.langs.get(word, 0))
        return at


class Tokens:
    """The words of some texts as arrays: hashes, Chinese or not, set of languages, the text each belongs to."""

    def __init__(self, vocab: Vocabulary, texts: list[str | None]):
        if len(vocab.hash) > Vocabulary.LIMIT:
            vocab.reset()
        ids: list[int] = []
        sizes = []
        get = vocab.__getitem__
        for t in texts:
            before = len(ids)
            if t:
                ids.extend(map(get, _WORD.findall(_QUOTES.sub("", t.lower()))))
            sizes.append(len(ids) - before)
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        at = np.array(ids, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.r_[0, self.sizes.cumsum()[:-1]] if len(sizes) else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        self.hash = np.array(vocab.hash, np.uint64)[at] if len(at) else np.zeros(0, np.uint64)
        self.han = np.array(vocab.han, bool)[at] if len(at) else np.zeros(0, bool)
        self.spoken = np.array(vocab.spoken, np.int64)[at] if len(at) else np.zeros(0, np.int64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the n-gram that ends at each word, and whether it lies within one text."""
        kept = self.kept.get(n)
        if kept is not None:
            return kept
        h = _mixed(self.hash)
        out = h.copy()
        for k in range(1, n):
            out[k:] = _mixed(out[k:] * np.uint64(3) + _shifted(h, k)[k:] * _MIX[k % 3])
        inside = np.zeros(len(h), bool)
        if len(h) >= n:
            inside[n - 1 :] = self.doc[n - 1 :] == self.doc[: len(h) - n + 1]
        self.kept[n] = out, inside
        return out, inside

    def before(self, k: int) -> np.ndarray:
        """The hash of the word k places before each, START where that is outside its text."""
        out = _shifted(self.hash, k)
        place = np.arange(len(out)) - np.repeat(self.starts, self.sizes)
        out[place < k] = START
        return out

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        return np.bincount(self.doc, weights=values, minlength=len(self.sizes))


def _shifted(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros_like(h)
    out[k:] = h[:-k]
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX[0]
    return h ^ (h >> np.uint64(29))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(a) * np.uint64(3) + _mixed(b) * _MIX[1])


def _triple(pair: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _mixed(pair * np.uint64(3) + _mixed(c) * _MIX[2])


def _first_in_doc(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its value within its text."""
    n = len(keys)
    bits = np.uint64(max(1, n.bit_length()))  # the place of a key in its low bits: sorting is then stable
    ranked = np.sort((_mixed(keys ^ _mixed(doc.astype(np.uint64) + np.uint64(1))) >> bits << bits) | np.arange(n, dtype=np.uint64))
    first = np.ones(n, bool)
    order = (ranked[1:] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first[order] = (ranked[1:] >> bits) != (ranked[:-1] >> bits)
    return first


def repeated_words(tokens: Tokens) -> np.ndarray:
    """Per text: the number of words in second or later copies of phrases."""
    n = len(tokens.hash)
    if not n:
        return np.zeros(len(tokens.sizes))
    han = tokens.per_text(tokens.han) * 2 > tokens.sizes
    mark = np.zeros(n, bool)
    for size, use in ((PHRASE, ~han), (PHRASE_HAN, han)):
        if not use.any():
            continue
        keys, inside = tokens.grams(size)
        at = np.flatnonzero(inside & use[tokens.doc])
        later = at[~_first_in_doc(keys[at], tokens.doc[at])]
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, later - size + 1, 1)
        np.add.at(edge, later + 1, -1)
        mark |= edge[:-1].cumsum() > 0
    return tokens.per_text(mark)


_COUNTS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("w", pa.int64()), ("c", pa.int64())])


def _summed(parts: list[tuple]) -> tuple:
    """(key, u, v, w, count) with each key once."""
    key, u, v, w, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    uniq, first, inv = np.unique(key, return_index=True, return_inverse=True)
    return uniq, u[first], v[first], w[first], np.bincount(inv, weights=c).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams with the number of texts that have them, added up over the partition before they are sent."""
    vocab, parts, size = Vocabulary({}), [], 0

    def sent(total):
        _, u, v, w, c = total
        for at in range(0, len(c), 200_000):
            to = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[to].view(np.int64)) for x in (u, v, w, c)], schema=_COUNTS)

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in chunks(texts):
            tokens = Tokens(vocab, texts[a:b])
            if not len(tokens.hash):
                continue
            u, v, w = tokens.before(2), tokens.before(1), tokens.hash
            key = _triple(_pair(u, v), w)
            at = np.flatnonzero(_first_in_doc(key, tokens.doc))
            parts.append((key[at], u[at], v[at], w[at], np.ones(len(at))))
            size += len(at)
            if size > HELD:
                parts = [_summed(parts)]
                size = len(parts[0][0])
                if size > HELD // 2:
                    yield from sent(parts[0])
                    parts, size = [], 0
    if parts:
        yield from sent(_summed(parts))


class Sorted:
    """Values by 64-bit hash: arrays sorted by hash, with an index of the hashes' first bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        order = keys.argsort(kind="stable")
        self.keys, self.values, self.missing = keys[order], values[order].astype(np.float32), missing

    def spread(self) -> Sorted:
        self.shift = np.uint64(64 - max(1, min(22, len(self.keys).bit_length() + 1)))
        first = (self.keys >> self.shift).astype(np.int64)
        self.start = np.searchsorted(first, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        return self

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.missing)
        if not len(self.keys):
            return out
        top = (hashes >> self.shift).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        live = np.flatnonzero(at < end)
        at, end, want = at[live], end[live], hashes[live]
        while len(live):
            hit = self.keys[at] == want
            out[live[hit]] = self.values[at[hit]]
            at = at + 1
            go = ~hit & (at < end)
            live, at, end, want = live[go], at[go], end[go], want[go]
        return out


class Model:
    """Modified Kneser-Ney: per order the kept n-grams with their discounted probability, and per context its weight of the lower order."""

    def __init__(self, grams: list[Sorted], contexts: list[Sorted], unseen: float):
        self.grams, self.contexts, self.unseen, self.ready = grams, contexts, unseen, False

    def probability(self, tokens: Tokens) -> np.ndarray:
        """P(word | the two words before it), from the lowest order up."""
        if not self.ready:
            for x in (*self.grams, *self.contexts):
                x.spread()
            self.ready = True
        u, v, w = tokens.before(2), tokens.before(1), tokens.hash
        context = _pair(u, v)
        p = self.grams[0](_mixed(w)) + self.contexts[0].missing * self.unseen
        p = self.grams[1](_pair(v, w)) + self.contexts[1](_mixed(v)) * p
        p = self.grams[2](_triple(context, w)) + self.contexts[2](context) * p
        return np.maximum(p, 1e-12)


def _discounts(counts: DataFrame):
    """The discounts of counts of 1, 2 and more, and the counts of counts."""
    n = F.col("c")
    s = counts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("all"), F.count("*").alias("kinds"), *[F.count(F.when(n == j, 1)).alias(f"n{j}") for j in (1, 2, 3, 4)], F.count(F.when(n > 2, 1)).alias("more")).first()
    n1, n2, n3, n4 = (max(1, s[f"n{j}"]) for j in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return np.clip(np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]), [0, 0.05, 0.1, 0.1], [0, 0.95, 1.9, 2.9]), s


def _order(counts: DataFrame, context: list[str], size: int):
    """Of ``(context.., w, c)`` the discounts, the kept rows and the totals of their contexts."""
    n = F.col("c")
    cut, s = _discounts(counts)
    least = max(1, -(-s["all"] // size))
    kept = _columns(counts.where(n >= least), [*context, "w", "c"])
    totals = _columns(counts.groupBy(*context).agg(F.sum(n).alias("total"), F.max(n).alias("most")).where(F.col("most") >= least), [*context, "total"]) if context else {"total": np.array([s["all"]])}
    kept["gain"] = kept["c"] - cut[np.minimum(kept["c"], 3).astype(np.int64)]
    return kept, totals, s["kinds"]


def _columns(df: DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    """Columns of a bounded frame; hashes as unsigned."""
    table = df.select(*names).toArrow()
    return {x: np.asarray(table.column(x).to_numpy(), np.int64).view(np.uint64) if x in "uvw" else np.asarray(table.column(x).to_numpy(), float) for x in names}


def _tables(grams: np.ndarray, gain: np.ndarray, owner: np.ndarray, contexts: np.ndarray, total: np.ndarray) -> tuple[Sorted, Sorted]:
    """Discounted probabilities of n-grams with the hashes of their contexts; what is left of each context."""
    order = contexts.argsort(kind="stable")
    at = order[np.searchsorted(contexts, owner, sorter=order)] if len(owner) else np.zeros(0, np.int64)
    own = gain / total[at]
    left = np.clip(1 - np.bincount(at, weights=own, minlength=len(contexts)), 1e-6, 1)
    return Sorted(grams, own, 0.0), Sorted(contexts, left, 1.0)


def fit(documents: DataFrame, text: str = "text", size: int = SIZE) -> Model:
    """A bounded model to take elsewhere; the queries use :func:`probabilities`, which leaves no n-gram out.

    Counts over all documents by Spark; the driver gets at most ``size`` n-grams and as many contexts of each order.

    Trigrams are shuffled by all three words, so a context that every text has is spread; contexts and the distinct words
    before each bigram are counted from their sums and combined before the shuffle.
    """
    rows = documents.select(F.col(text).alias("t")).mapInArrow(_count, "u BIGINT, v BIGINT, w BIGINT, c BIGINT")
    three = rows.repartition("u", "v", "w").groupBy("u", "v", "w").agg(F.sum("c").alias("c")).persist(StorageLevel.MEMORY_AND_DISK)
    two = three.groupBy("v", "w").agg(F.count("*").alias("c")).persist(StorageLevel.MEMORY_AND_DISK)
    one = two.groupBy("w").agg(F.count("*").alias("c"))
    k3, t3, _ = _order(three, ["u", "v"], size)
    k2, t2, _ = _order(two, ["v"], size)
    k1, t1, kinds = _order(one, [], size)
    two.unpersist()
    three.unpersist()
    g3, c3 = _tables(_triple(_pair(k3["u"], k3["v"]), k3["w"]), k3["gain"], _pair(k3["u"], k3["v"]), _pair(t3["u"], t3["v"]), t3["total"])
    g2, c2 = _tables(_pair(k2["v"], k2["w"]), k2["gain"], _mixed(k2["v"]), _mixed(t2["v"]), t2["total"])
    all_words = max(1.0, float(t1["total"][0]))
    left = float(np.clip(1 - k1["gain"].sum() / all_words, 1e-6, 1))
    g1, c1 = Sorted(_mixed(k1["w"]), k1["gain"] / all_words, 0.0), Sorted(np.zeros(0, np.uint64), np.zeros(0), left)
    return Model([g1, g2, g3], [c1, c2, c3], 1.0 / max(1000, kinds + 1))


def _ones() -> list[Column]:
    """How many rows have a count of 1, of 2, and of more: what a context's discounts are made of."""
    c = F.col("c")
    return [F.count(F.when(x, 1)) for x in (c == 1, c == 2, c > 2)]


def _discounted(cut: np.ndarray, total: Column, ones: list[Column]) -> tuple[Column, Column]:
    """An n-gram's discounted share of its context, and what the discounts leave to the lower order."""
    c = F.col("c")
    gain = c - F.when(c == 1, float(cut[1])).when(c == 2, float(cut[2])).otherwise(float(cut[3]))
    left = sum(float(cut[n]) * x for n, x in enumerate(ones, 1)) / total
    return gain / total, F.greatest(F.least(left, F.lit(1.0)), F.lit(1e-6))


def probabilities(three: DataFrame, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """``u, v, w, p``: P(word | the two words before it) of every trigram ``u, v, w, c``, and the frames kept for it.

    The same model as :func:`fit` makes, with all n-grams of all orders; it stays in Spark, whatever its size.  The
    trigrams are in ``parts`` partitions by ``v`` and stay there: their contexts ``u, v``, the bigrams ``v, w`` and the
    contexts ``v`` are whole in a partition.  Only the bigrams go to their last words and back.
    """
    two = three.groupBy("v", "w").agg(F.count("*").alias("c")).persist(StorageLevel.MEMORY_AND_DISK)
    one = two.groupBy("w").agg(F.count("*").alias("c")).persist(StorageLevel.MEMORY_AND_DISK)
    (cut3, _), (cut2, _), (cut1, s) = (_discounts(x) for x in (three, two, one))
    words = max(1.0, float(s["all"]))
    gain, left = _discounted(cut1, F.lit(words), [F.lit(s[x]) for x in ("n1", "n2", "more")])
    p1 = one.select("w", (gain + left / max(1000, s["kinds"] + 1)).alias("p1"))
    own2 = two.select("v", "w", *_shares_of("v", cut2))
    p2 = own2.join(p1, "w").select("v", "w", (F.col("own") + F.col("left") * F.col("p1")).alias("p2")).repartition(parts, "v")
    own3 = three.select("u", "v", "w", *_shares_of(["u", "v"], cut3))
    return own3.join(p2, ["v", "w"]).select("u", "v", "w", F.greatest(F.col("own") + F.col("left") * F.col("p2"), F.lit(1e-12)).alias("p")), [two, one]


def _shares_of(context: str | list[str], cut: np.ndarray) -> tuple[Column, Column]:
    """Of each row its discounted share ``own`` of its context, and what is ``left`` there."""
    over = Window.partitionBy(context)
    gain, left = _discounted(cut, F.sum("c").over(over), [x.over(over) for x in _ones()])
    return gain.alias("own"), left.alias("left")


#: A document's row has its figures. A trigram's row has for a block of documents, of which ``id`` is the first, in how
#: many it is, and 16 bits for each of its words there: the document's place in the block, and whether the continuation
#: was seen in it (2), only the context (1), or neither (0). ``v``, by which rows are partitioned, is the id of a document.
FIGURES = pa.struct([("k", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("repeated_share", pa.float64()), ("votes", pa.string())])
ROWS = pa.schema([("id", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("w", pa.int64()), ("c", pa.int64()), ("places", pa.binary()), ("figures", FIGURES)])
ROWS_SQL = "id BIGINT, u BIGINT, v BIGINT, w BIGINT, c BIGINT, places BINARY, figures STRUCT<k: BIGINT, lang: STRING, n_words: BIGINT, repeated_share: DOUBLE, votes: STRING>"
SUMS = pa.schema([("id", pa.int64()), ("own", pa.int64()), ("plain", pa.int64())])
BLOCK = 1 << 14
#: Surprisals are added up as whole numbers of this part of one, so the order of the rows cannot matter.
UNIT = 1 << 32


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ROWS], schema=ROWS)


def _block(first: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The trigrams of a block of documents, those of a context beside each other, as they then take less in the shuffle.

    They are sorted by parts of their hashes.  Where these are equal, a trigram may have several rows, which add up.
    """
    u, v, w, places = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = (v >> np.uint64(42) << np.uint64(42) | u >> np.uint64(43) << np.uint64(21) | w >> np.uint64(43)).argsort(kind="stable")
    places = places[order]
    starts = np.flatnonzero(np.logical_or.reduce([np.r_[True, x[1:] != x[:-1]] for x in (u[order], v[order], w[order])]))
    c = np.add.reduceat((places & 3 != 2).astype(np.int64), starts)
    at, ends = order[starts], np.r_[starts, len(places)]
    for a in range(0, len(at), 200_000):
        b = min(a + 200_000, len(at))
        offsets = ((ends[a : b + 1] - ends[a]) * 2).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(places[ends[a] : ends[b]].tobytes())])
        yield _rows(b - a, id=np.full(b - a, first), c=c[a:b], places=lists, **{n: x[at[a:b]].view(np.int64) for n, x in (("u", u), ("v", v), ("w", w))})


def _surprisals(places: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words the surprisals with and without their document's own past."""
    seen = places & 3
    own = np.where(seen == 2, CACHE + (1 - CACHE) * p, np.where(seen == 1, (1 - CACHE) * p, p))
    return tuple(np.rint(-np.log(x) * UNIT).astype(np.int64) for x in (own, p))


def _summed_by(ids: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each id once, and the sums of its values."""
    order = ids.argsort(kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[starts], *(np.add.reduceat(x[order], starts) for x in values)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, sizes.cumsum()]


#: To a block, of some of its trigrams: the places, how many each trigram has, and its probability; or, where that is
#: shorter, as with few partitions, the documents' places in the block and their sums of surprisals.
REPLIES = pa.schema([("id", pa.int64()), ("places", pa.binary()), ("sizes", pa.binary()), ("p", pa.binary()), ("own", pa.binary()), ("plain", pa.binary())])


def _replies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block, from ``id, places, p``."""
    parts, size = [], 0

    def packed():
        first, sizes, p = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:3])
        places = np.concatenate([x[3] for x in parts])[np.repeat(first, sizes).argsort(kind="stable")]
        order = first.argsort(kind="stable")
        first, sizes, p = first[order], sizes[order].astype(np.uint32), p[order]
        bounds, ends, rows = np.r_[np.flatnonzero(np.r_[True, first[1:] != first[:-1]]), len(first)], _ends(sizes.astype(np.int64)), []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            own = places[ends[a] : ends[b]]
            if 18 * np.count_nonzero(np.bincount(own >> 2)) < 12 * (b - a) + 2 * len(own):
                docs, *sums = _summed_by(own >> 2, *_surprisals(own, np.repeat(p[a:b], sizes[a:b])))
                rows.append((int(first[a]), docs.tobytes(), None, None, *(x.tobytes() for x in sums)))
            else:
                rows.append((int(first[a]), own.tobytes(), sizes[a:b].tobytes(), p[a:b].tobytes(), None, None))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), REPLIES, strict=True)], schema=REPLIES)

    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(1)
        places = np.frombuffer(b"".join(lists.to_pylist()), np.uint16)
        parts.append((batch.column(0).to_numpy(), pc.binary_length(lists).to_numpy() // 2, batch.column(2).to_numpy(), places))
        size += len(places)
        if size > HELD:
            yield packed()
            parts, size = [], 0
    if parts:
        yield packed()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document the sums of surprisals over the replies to its block."""
    parts, size = [], 0

    def sums():
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _summed_by(*(np.concatenate(x) for x in zip(*parts, strict=True)))], schema=SUMS)

    def joined(column, kind):
        return np.frombuffer(b"".join(column.to_pylist()), kind)

    for batch in batches:
        for of_words in (True, False):
            rows = batch.filter(pc.is_valid(batch.column("p")) if of_words else pc.is_null(batch.column("p")))
            if not rows.num_rows:
                continue
            places = joined(rows.column("places"), np.uint16)
            first = np.repeat(rows.column("id").to_numpy(), pc.binary_length(rows.column("places")).to_numpy() // 2)
            if of_words:
                parts.append((first + (places >> 2), *_surprisals(places, np.repeat(joined(rows.column("p"), np.float64), joined(rows.column("sizes"), np.uint32)))))
            else:
                parts.append((first + places, joined(rows.column("own"), np.int64), joined(rows.column("plain"), np.int64)))
            size += len(places)
            if size > HELD:
                yield sums()
                parts, size = [], 0
    if parts:
        yield sums()


def _scores(langs: list[str], words: dict[str, int], sets: np.ndarray, judged: tuple | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocab = Vocabulary(words)
    form_votes = None
    if judged:
        common, samples, least = judged
        letters = text_form.Letters(samples)
        form_votes = lambda t: text_form.votes(t, text_form.statistics(t, common), common, letters)
    names = [*langs, "zh"]
    at = first = TaskContext.get().partitionId() << 33
    parts, size = [], 0
    for batch in batches:
        keys, every = (c.to_pylist() for c in batch.columns)
        for a, b in chunks(every):
            docs, texts = keys[a:b], every[a:b]
            if size > HELD or at + len(docs) - first > BLOCK:
                if parts:
                    yield from _block(first, parts)
                parts, size, first = [], 0, at
            tokens = Tokens(vocab, texts)
            ids = np.arange(at, at + len(docs))
            at += len(docs)
            share, lang, votes_of = np.zeros(len(docs)), [None] * len(docs), [None] * len(docs)
            if len(tokens.hash):
                keys2, in2 = tokens.grams(2)
                keys3, in3 = tokens.grams(3)
                again2 = in2 & ~_first_in_doc(np.where(in2, keys2, tokens.hash), tokens.doc)
                again3 = in3 & ~_first_in_doc(np.where(in3, keys3, tokens.hash), tokens.doc)
                known = np.r_[False, again2[:-1]] & in3
                u, v, w = tokens.before(2), tokens.before(1), tokens.hash
                places = ((ids - first)[tokens.doc] * 4 + np.where(again3, 2, known)).astype(np.uint16)
                parts.append((u, v, w, places))
                size += len(places)
                share = repeated_words(tokens) / np.maximum(tokens.sizes, 1)
                votes = np.stack([tokens.per_text(sets[tokens.spoken, k]) for k in range(len(langs))] + [tokens.per_text(tokens.han) * 0.5])
                best, most = votes.argmax(0), votes.max(0)
                lang = [(names[best[k]] if most[k] > 0 else "und") if n else None for k, n in enumerate(tokens.sizes)]
                votes_of = [form_votes(texts[k]) if form_votes and n and share[k] >= least else None for k, n in enumerate(tokens.sizes)]
            figures = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((docs, lang, tokens.sizes, share, votes_of), FIGURES, strict=True)], fields=list(FIGURES))
            yield _rows(len(docs), id=ids, v=ids, figures=figures)
    if parts:
        yield from _block(first, parts)


@contextmanager
def _joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Lets plans join frames that are partitioned by one of the joined columns without another shuffle."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scored(documents: DataFrame, common_words: DataFrame, doc: str = "doc_id", text: str = "text", judged: tuple | None = None) -> DataFrame:
    """Key, language, words, surprisal with and without the document's own past, and the exact repeated share.

    Every trigram of a block of documents is joined with its probability, the probabilities go back to the block, and
    what each document has of them is added up there.
    ``judged`` (frequent words, sample sentences, share): the votes on the form of texts from that share on.
    """
    rows = [(r[0], r[1].lower()) for r in common_words.where(F.col("lang").isNotNull() & F.col("word").isNotNull()).select("lang", "word").distinct().orderBy("lang", "word").collect()]
    langs = sorted({lang for lang, _ in rows} - {"zh"})
    spoken: dict[str, set[int]] = {}
    for lang, w in rows:
        if lang in langs:
            spoken.setdefault(w, set()).add(langs.index(lang))
    kinds = sorted({tuple(sorted(x)) for x in spoken.values()})
    sets = np.zeros((len(kinds) + 1, max(1, len(langs))), np.int8)
    for n, x in enumerate(kinds, 1):
        sets[n, list(x)] = 1
    words = {w: 1 + kinds.index(tuple(sorted(x))) for w, x in spoken.items()}
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows and counts that memory can't hold are made again from the files of this one shuffle, so they take no more disk
    rows = pick(documents, doc, text).mapInArrow(partial(_scores, langs, words, sets, judged), ROWS_SQL).repartition(parts, "v").persist(StorageLevel.MEMORY_ONLY)
    grams = rows.where("places is not null")
    three = grams.groupBy("u", "v", "w").agg(F.greatest(F.sum("c"), F.lit(1)).alias("c")).persist(StorageLevel.MEMORY_ONLY)
    model, kept = probabilities(three, parts)
    found = grams.select("u", "v", "w", "id", "places").join(model, ["u", "v", "w"]).select("id", "places", "p")
    replies = found.mapInArrow(_replies, "id BIGINT, places BINARY, sizes BINARY, p BINARY, own BINARY, plain BINARY").repartition("id")
    found = replies.mapInArrow(_added, "id BIGINT, own BIGINT, plain BIGINT")
    every = found.unionByName(rows.where("places is null").select("id", "figures.*"), allowMissingColumns=True)
    sums = every.groupBy("id").agg(F.sum("own").alias("own"), F.sum("plain").alias("plain"), *[F.max(x.name).alias(x.name) for x in FIGURES])
    size = F.greatest("n_words", F.lit(1)) * UNIT
    out = sums.select(F.col("k").alias(doc), "lang", "n_words", (F.col("own") / size).alias("surprisal"), (F.col("plain") / size).alias("plain_surprisal"), "repeated_share", "votes")
    with _joined_in_place(documents.sparkSession):  # the plan is made when the frame is marked
        out.persist(StorageLevel.MEMORY_AND_DISK).count()
    for x in (rows, three, *kept):
        x.unpersist()
    return out


def _banded(rows: DataFrame, lower: float, upper: float) -> DataFrame:
    """With each row's band; the medians, one for each language of the fixed table of words, go through the driver."""
    middles = rows.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.percentile_approx("surprisal", 0.5, 1000)).collect()
    table = [F.lit(x) for lang, m in middles for x in (lang, m)]
    out = rows.withColumn("middle", F.element_at(F.create_map(*table), F.col("lang")) if table else F.lit(None).cast("double"))
    band = F.when(F.col("surprisal") < lower * F.col("middle"), "low").when(F.col("surprisal") > upper * F.col("middle"), "high").when(F.col("surprisal").isNotNull(), "usual")
    return out.withColumn("band", band).drop("middle")


def repetition(documents: DataFrame, common_words: DataFrame, doc: str = "doc_id", text: str = "text", lower: float = LOWER, upper: float = UPPER) -> DataFrame:
    """The scores of every document with its perplexity and ``band``: ``low``, ``usual`` or ``high`` for its language."""
    rows = scored(documents, common_words, doc, text)
    return _banded(rows, lower, upper).select(doc, "lang", "n_words", F.exp("surprisal").alias("perplexity"), F.exp("plain_surprisal").alias("corpus_perplexity"), "band", "repeated_share")


def _shares():
    vocab = Vocabulary({})

    def work(docs, texts):
        tokens = Tokens(vocab, texts)
        share = repeated_words(tokens) / np.maximum(tokens.sizes, 1)
        yield from zip(docs, tokens.sizes.tolist(), share.tolist(), strict=True)

    return work


def repeated_shares(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, n_words, repeated_share``: the exact share of words in later copies of phrases, without the model."""
    return map_rows(pick(documents, doc, text), f"`{doc}` BIGINT, n_words BIGINT, repeated_share DOUBLE", _shares)


def repetitive(documents: DataFrame, common_words: DataFrame, samples: list[str], doc: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """The documents below their language's perplexity band of which at least ``share`` of the words are repeated.

    Of these candidates, tables and junk (see :mod:`text_form`) are left out.
    """
    judged = (text_form.load_words(common_words), samples, share)
    rows = scored(documents, common_words, doc, text, judged)
    low = _banded(rows, LOWER, UPPER).where((F.col("band") == "low") & (F.col("repeated_share") >= share))
    patterns = sorted((r[0], r[1]) for r in low.groupBy("votes").count().collect())
    forms, _ = text_form.posterior_maps(patterns)
    return low.where(~F.col("votes").isin([p for p, f in forms.items() if f in ("table", "junk")])).select(doc).distinct()
