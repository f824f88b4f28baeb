"""Problem 3: abusive, hateful and sexually explicit language.

A linear-chain conditional random field with the states none, toxic and nsfw
tags the words of every sentence; forward-backward marginals add up to a score
per document and category and give the offsets of offending spans.

The field is trained here.  Judgements are given per document only, so words
are labelled first: word sequences that occur mostly in documents judged
positive mark the words they cover, everything in documents judged negative is
none.  The sample of judged documents is bounded (``FIT_DOCS`` per category and
as many negatives, the first in the order of a hash of their key).

Words are compared after undoing disguises: look-alike letters of other
scripts, figures and signs for letters, stretched letters, letters set apart
and masked letters.

Defined results: null and blank texts score 0 and have no spans; without any
positive judgement every score is 0; of several judgements of one document the
highest counts; repeated rows give rows of their own; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models
from .batches import map_rows, pick

STATES = ("none", "toxic", "nsfw")
FIT_DOCS = 3000
BUCKETS = 1 << 17
#: Words of a unit; longer sentences go on in the next unit.
UNIT = 60
EPOCHS = 5
#: A word sequence marks its words from this log-likelihood ratio (chance: about 1 in 50,000) and this share of its
#: documents judged positive.
SURE = 18.0
PURE = 0.85
#: A span has at least this many words above half, or this mean marginal.
SPAN_WORDS = 3
SPAN_MEAN = 0.6

#: Letters of other scripts that look like Latin ones, and signs used for letters.
_LOOKALIKE = str.maketrans("асеорхуіѕјԁһкмтвнοαερνκι", "aceopxyisjdhkmtbhoaepvki")
_LEET = str.maketrans("01345789@$!|€", "oieasthgasiie")

_APART = re.compile(r"(?<!\S)(?:[^\W\d_]|[@$!*0-9])(?: (?:[^\W\d_]|[@$!*0-9])){2,}(?![^\s.,;:!?])")
_TOKEN = re.compile(r"[㐀-鿿]|[^\s㐀-鿿]+")
_EDGE = ".,;:!?…\"'“”‘’«»()[]{}<>-–—¿¡。，！？、；：*_~`"
_STRETCH = re.compile(r"(.)\1{2,}")


def normal(token: str) -> str:
    """A word without its disguise; masked words keep their first and last letters around one star."""
    t = unicodedata.normalize("NFKC", token)
    if "*" in t.strip(".,;:!?") and re.search(r"[^\W\d_]\*+|\*+[^\W\d_]", t):
        core = t.strip(".,;:!?\"'()")
        return core[0] + "*" + core[-1] if len(core) > 1 else core
    core = t.strip(_EDGE)
    if not core:
        return "¶" if t and t[-1] in ".!?。！？…" else "·"
    if core.isascii() and core.isalpha():
        return _STRETCH.sub(r"\1", core)
    latin = sum("a" <= c <= "z" for c in core)
    if latin and not core.isascii():
        core = core.translate(_LOOKALIKE)
    if latin and not core.isalpha() and (latin >= 2 or "@" in core or "$" in core) and not re.fullmatch(r"\d+[a-z]{1,2}|[a-z]+[-_]?\d+|[a-z]+(?:['’-][a-z]+)+", core) and not re.search(r"@.*\.", core):
        core = core.translate(_LEET)
    if core.isdigit():
        return "0"
    return _STRETCH.sub(r"\1", core)


def _join(m: re.Match) -> str:
    return m.group().replace(" ", "")


def tokens(text: str) -> list[str]:
    low = text.lower()
    if _APART.search(low):
        low = _APART.sub(_join, low)
    return _TOKEN.findall(low)


def _h(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature)


class Vocab(dict):
    """Raw token to a row: hash of its normal form, its own feature buckets, whether a sentence ends with it."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self):
        self.clear()
        self.hash, self.own, self.ends, self.normal = [], [], [], []

    def __missing__(self, raw: str) -> int:
        w = normal(raw)
        self[raw] = at = len(self.hash)
        self.hash.append(_h(w))
        tail = raw.rstrip("\"'”’»)")
        self.ends.append(bool(tail) and tail[-1] in ".!?。！？…")
        shape = "m" if "*" in w else "p" if w in "¶·" else "0" if w == "0" else "o" if w != raw.strip(_EDGE) else "w"
        self.own.append([_h(f) % BUCKETS for f in (f"w{w}", f"p{w[:4]}", f"s{w[-4:]}", f"#{shape}")])
        self.normal.append(w)
        return at


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(31))) * _B) >> np.uint64(64 - 17)).astype(np.int64)


class Units:
    """The words of some texts cut into units at sentence ends, as arrays."""

    def __init__(self, vocab: Vocab, texts: list[str | None]):
        if len(vocab.hash) > 300_000:
            vocab.reset()
        ids: list[int] = []
        sizes = []
        get = vocab.__getitem__
        for t in texts:
            n = len(ids)
            if t:
                ids.extend(map(get, tokens(t)))
            sizes.append(len(ids) - n)
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        n = len(ids)
        if not n:
            return
        start = np.zeros(n, bool)
        start[0] = True
        start[1:] = np.array(vocab.ends)[self.ids[:-1]] | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(start)
        length = np.diff(np.r_[first, n])
        within = np.arange(n) - np.repeat(first, length)
        start |= within % UNIT == 0
        self.first = np.flatnonzero(start)
        self.length = np.diff(np.r_[self.first, n])
        self.unit = np.repeat(np.arange(len(self.first)), self.length)
        h = np.array(vocab.hash, np.uint64)[self.ids]
        same = np.r_[False, self.unit[1:] == self.unit[:-1]]
        before = np.where(same, np.r_[np.uint64(0), h[:-1]], np.uint64(1))
        behind = np.where(np.r_[same[1:], False], np.r_[h[1:], np.uint64(0)], np.uint64(2))
        self.context = np.stack([_bucket(before * _A + np.uint64(11)), _bucket(behind * _A + np.uint64(12)), _bucket(before * _A + h * _B), _bucket(h * _A + behind * _B + np.uint64(7))], 1)


def _padded(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words by (unit, step), and which of them exist."""
    t = int(length.max())
    at = first[:, None] + np.arange(t)[None]
    ok = np.arange(t)[None] < length[:, None]
    return np.where(ok, at, 0), ok


def marginals(emit: np.ndarray, ok: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded units: P(state) per word, the sum of P(state, next state), log Z."""
    n, t, s = emit.shape
    m = np.exp(trans)
    e = np.exp(np.clip(emit - emit.max(2, keepdims=True), -30, 0))
    alpha, scale = np.zeros((n, t, s)), np.ones((n, t))
    alpha[:, 0] = e[:, 0] / s
    for k in range(t):
        if k:
            step = (alpha[:, k - 1] @ m) * e[:, k]
            alpha[:, k] = np.where(ok[:, k, None], step, alpha[:, k - 1])
        scale[:, k] = np.where(ok[:, k], alpha[:, k].sum(1), 1.0)
        alpha[:, k] /= alpha[:, k].sum(1, keepdims=True)
    beta = np.ones((n, t, s))
    pair = np.zeros((s, s))
    for k in range(t - 2, -1, -1):
        nxt = e[:, k + 1] * beta[:, k + 1]
        step = nxt @ m.T
        step /= step.sum(1, keepdims=True)
        both = alpha[:, k, :, None] * m[None] * nxt[:, None, :]
        both /= both.sum((1, 2), keepdims=True)
        pair += (both * ok[:, k + 1, None, None]).sum(0)
        beta[:, k] = np.where(ok[:, k + 1, None], step, 1.0)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    return post, pair, np.log(scale).sum(1)


def least_lean(trans: np.ndarray) -> float:
    """How far the likeliest other state of a unit's words may lean against none before no marginal can pass one half.

    Against the same path with none in its place, a run of m words in other states weighs at most E X q (q G)^(m - 1): q is
    the exponential of the lean, E and X of entering and leaving the run, G of the changes within it.  All runs over one
    word together weigh E X q / (1 - q G)^2, and its marginal is less than that.
    """
    gain = np.exp(trans - trans[0, 0])
    enter, leave, within = max(1.0, gain[0, 1:].max()), max(1.0, gain[1:, 0].max()), gain[1:, 1:].sum(1).max()
    low, high = -60.0, 0.0
    for _ in range(60):
        lean = (low + high) / 2
        q = np.exp(lean)
        if q * within < 1 and enter * leave * q / (1 - q * within) ** 2 <= 0.5:
            low = lean
        else:
            high = lean
    return low


class Field:
    """Weights per hashed feature and state, and of state changes."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans, self.least = weights, trans, least_lean(trans)
        self.vocab = Vocab()
        self.rows = np.zeros((0, len(STATES)), np.float32)

    def save(self, spark, path: str) -> None:
        models.save(spark, path, weights=self.weights, trans=self.trans)

    @staticmethod
    def load(spark, path: str) -> Field:
        return Field(**models.load(spark, path))

    def __getstate__(self):
        return self.weights, self.trans

    def __setstate__(self, state):
        self.__init__(*state)

    def tag(self, texts: list[str | None]) -> tuple[Units, np.ndarray]:
        """P(state) of every word of the texts.

        Units in which no marginal of toxic or nsfw can pass one half (:func:`least_lean`) have no spans: the recursions
        are left out there, and their words count as none.
        """
        units = Units(self.vocab, texts)
        out = np.zeros((len(units.ids), len(STATES)), np.float32)
        if not len(units.ids):
            return units, out
        if len(self.vocab.own) < len(self.rows):
            self.rows = np.zeros((0, len(STATES)), np.float32)
        if len(self.vocab.own) > len(self.rows):
            new = np.array(self.vocab.own[len(self.rows) :])
            self.rows = np.concatenate([self.rows, self.weights[new].sum(1)])
        emit = self.rows[units.ids]
        for k in range(units.context.shape[1]):
            emit = emit + self.weights[units.context[:, k]]
        lean = emit[:, 1:].max(1) - emit[:, 0]
        worth = np.maximum.reduceat(lean, units.first) > self.least
        pick_ = np.flatnonzero(worth)
        by = pick_[units.length[pick_].argsort(kind="stable")]
        for part in np.array_split(by, max(1, len(by) // 2000)):
            if len(part):
                at, ok = _padded(units.first[part], units.length[part])
                post, _, _ = marginals(emit[at].astype(float), ok, self.trans)
                out[at[ok]] = post[ok]
        return units, out


def _surroundings(units: Units, words: np.ndarray) -> np.ndarray:
    """Per word a hash of the unit before its own, or behind it: copies of a document don't count again."""
    place = np.arange(len(words), dtype=np.uint64) - units.first[units.unit].astype(np.uint64)
    h = words * (place * np.uint64(2) + np.uint64(1))
    own = np.add.reduceat(h ^ (h >> np.uint64(33)), units.first) * _B
    doc = units.doc[units.first]
    n = len(own)
    near = np.arange(n, dtype=np.uint64) * _A  # a unit alone in its document has no surroundings
    if n > 1:
        near[:-1] = np.where(doc[:-1] == doc[1:], own[1:] * np.uint64(3), near[:-1])
        near[1:] = np.where(doc[1:] == doc[:-1], own[:-1], near[1:])
    return near[units.unit]


def _labels(vocab: Vocab, units: Units, marks: np.ndarray) -> np.ndarray:
    """A state per word: covered by a word sequence of which documents judged positive hold much more than others.

    ``marks``: per document and category 1, 0 or -1 where unknown.
    """
    n = len(units.ids)
    state, best = np.zeros(n, np.int8), np.zeros(n)
    words = np.array(vocab.hash, np.uint64)[units.ids]
    around = _surroundings(units, words)
    keys, covers = [], []
    for size in (1, 2, 3):
        h = words.copy()
        for k in range(1, size):
            h[: n - k] = h[: n - k] * _A + words[k:] * _B
        ok = np.zeros(n, bool)
        ok[: n - size + 1] = units.unit[: n - size + 1] == units.unit[size - 1 :]
        keys.append(np.where(ok, h * np.uint64(size), np.uint64(0)))
        covers.append(size)
    for c in range(marks.shape[1]):
        yes, no = marks[:, c] == 1, marks[:, c] == 0
        p_all, q_all = yes.sum(), no.sum()
        if not p_all:
            continue
        gain = np.zeros(n)
        for key, size in zip(keys, covers, strict=True):
            _, one = np.unique(key ^ around, return_index=True)
            one = one[np.unique(key[one] ^ ((units.doc[one].astype(np.uint64) + np.uint64(1)) * _B), return_index=True)[1]]
            uniq, inv = np.unique(key[one], return_inverse=True)
            d = units.doc[one]
            p, q = np.bincount(inv, weights=yes[d]), np.bincount(inv, weights=no[d])
            share = p_all / (p_all + q_all)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = 2 * (np.where(p > 0, p * np.log(p / ((p + q) * share)), 0.0) + np.where(q > 0, q * np.log(q / ((p + q) * (1 - share))), 0.0))
            odds = np.where((p > PURE * (p + q)) & (uniq != 0), ratio, 0.0)
            got = odds[np.searchsorted(uniq, key)]
            for k in range(size):
                gain[k:] = np.maximum(gain[k:], got[: n - k])
        own = yes[units.doc] & (gain > SURE)
        near = np.convolve(own, np.ones(5), "same") >= 3  # single words by chance don't count
        filled = own & near
        for k in range(1, 3):  # gaps of up to two words inside a passage
            filled[k:-k] |= filled[: -2 * k] & filled[2 * k :] & (units.unit[: -2 * k] == units.unit[2 * k :]) & yes[units.doc[k:-k]] if n > 2 * k else False
        take = filled & (gain + 1e-3 >= best)
        state[take] = c + 1
        best = np.where(take, gain, best)
    return state


def fit(texts: list[str], marks: np.ndarray, seed: int = 3, epochs: int = EPOCHS) -> Field:
    """Trains the field by stochastic gradient ascent on the likelihood of the word labels."""
    s = len(STATES)
    vocab = Vocab()
    units = Units(vocab, texts)
    field = Field(np.zeros((BUCKETS, s), np.float32), np.array([[0.0, -3.0, -3.0], [-2.0, 1.0, -3.0], [-2.0, -3.0, 1.0]]))
    field.weights[_h("#w") % BUCKETS, 1:] = -4.0
    if not len(units.ids) or not (marks == 1).any():
        field.weights[:, 1:] = -4.0
        return field
    state = _labels(vocab, units, marks)
    rng = np.random.default_rng(seed)
    feats = np.concatenate([np.array(vocab.own)[units.ids], units.context], 1)
    hot = np.maximum.reduceat(state, units.first) > 0
    positive = (marks == 1).any(1)[units.doc[units.first]]
    # unlabelled units of documents judged positive may still hold what was missed: they don't teach
    teach = np.flatnonzero(hot | ~positive)
    cold = teach[~hot[teach]]
    if len(cold) > 5 * hot.sum() + 2000:
        cold = rng.choice(cold, int(5 * hot.sum()) + 2000, replace=False)
    use = np.r_[np.flatnonzero(hot), cold]
    h = np.array(vocab.hash, np.uint64)[units.ids] * (state.astype(np.uint64) * np.uint64(2) + np.uint64(3))
    whole = np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - units.first[units.unit].astype(np.uint64) + np.uint64(1)), units.first)
    use = use[np.unique(whole[use], return_index=True)[1]]  # the same words with the same labels teach once
    w, trans = np.zeros((BUCKETS, s)), field.trans.copy()
    g2 = np.full((BUCKETS, s), 0.05)
    w[_h("#w") % BUCKETS, 0] = 1.0
    for epoch in range(epochs):
        order = rng.permutation(use)
        order = order[(units.length[order] + rng.random(len(order)) * 6).argsort(kind="stable")]
        parts = np.array_split(order, max(1, len(order) // 250))
        for b in rng.permutation(len(parts)):
            part = parts[b]
            at, ok = _padded(units.first[part], units.length[part])
            f = feats[at]
            post, pair, _ = marginals(w[f].sum(2), ok, trans)
            truth = state[at]
            err = (np.eye(s)[truth] - post) * ok[..., None]
            flat, e = f[ok].ravel(), np.repeat(err[ok], f.shape[2], 0)
            hit, inv = np.unique(flat, return_inverse=True)
            g = np.stack([np.bincount(inv, weights=e[:, k], minlength=len(hit)) for k in range(s)], 1) - 2e-3 * w[hit]
            g2[hit] += g * g
            w[hit] += 0.35 * g / np.sqrt(g2[hit])
            step = ok[:, 1:]
            seen = np.zeros((s, s))
            np.add.at(seen, (truth[:, :-1][step], truth[:, 1:][step]), 1)
            trans += 0.02 * (seen - pair) / max(1, len(part)) * 4
    return Field(w.astype(np.float32), trans)


def judged(documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", bound: int = FIT_DOCS) -> tuple[list[str], np.ndarray]:
    """Texts and judgements of at most ``bound`` documents judged positive per category, and of as many negatives."""
    once = labels.groupBy(F.col(doc).cast("bigint").alias("k")).agg(F.max("toxic").alias("toxic"), F.max("nsfw").alias("nsfw"), F.min("toxic").alias("t0"), F.min("nsfw").alias("n0"))
    group = F.when(F.col("toxic") == 1, "toxic").when(F.col("nsfw") == 1, "nsfw").otherwise("none")
    order = F.xxhash64("k")
    ranked = once.withColumn("g", group)
    chosen = None
    for g, n in (("toxic", bound), ("nsfw", bound), ("none", 2 * bound)):
        part = ranked.where(F.col("g") == g).orderBy(order, "k").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 4 * bound keys
    rows = pick(documents, doc, text).join(F.broadcast(chosen), "k").select("k", "c0", "toxic", "nsfw").where(F.col("c0").isNotNull()).collect()
    rows = sorted({(r["k"], r["c0"], r["toxic"], r["nsfw"]) for r in rows}, key=lambda r: (r[0], r[1]))
    marks = np.array([[-1 if v is None else int(v) for v in (r[2], r[3])] for r in rows]).reshape(-1, 2)
    return [r[1] for r in rows], marks


def spans(units: Units, post: np.ndarray) -> list[tuple[int, str, int, int, float]]:
    """(text, category, first word, different words, mean marginal, words) of runs of words above one half."""
    out = []
    start = np.r_[0, units.sizes.cumsum()]
    for c in (1, 2):
        p = post[:, c]
        on = p > 0.5
        if not on.any():
            continue
        edge = np.flatnonzero(np.diff(np.r_[0, on.astype(np.int8), 0]))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            cuts = np.r_[a, a + 1 + np.flatnonzero(np.diff(units.doc[a:b])), b]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                out.append((int(units.doc[x]), STATES[c], int(x - start[units.doc[x]]), len(set(units.ids[x:y].tolist())), float(p[x:y].mean()), int(y - x)))
    return out


def _offending(found, least: int = SPAN_WORDS):
    return [f for f in found if f[3] >= least and f[4] >= SPAN_MEAN]


def _scores(field: Field):
    def work(docs, texts):
        units, post = field.tag(texts)
        best = {}
        for d, c, _, n, mean, _ in spans(units, post):
            score = mean * min(1.0, n / SPAN_WORDS)
            best[d, c] = 1 - (1 - best.get((d, c), 0.0)) * (1 - score)
        for n, d in enumerate(docs):
            yield d, best.get((n, "toxic"), 0.0), best.get((n, "nsfw"), 0.0)

    return work


def scores(documents: DataFrame, field: Field, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, toxic_score, nsfw_score``: one minus the product of (1 - mean marginal) over the spans of a document."""
    return map_rows(pick(documents, doc, text), f"`{doc}` BIGINT, toxic_score DOUBLE, nsfw_score DOUBLE", partial(_scores, field))


def _found(field: Field):
    def work(docs, texts):
        units, post = field.tag(texts)
        for n, c in sorted({(f[0], f[1]) for f in _offending(spans(units, post))}):
            yield docs[n], c

    return work


def offending(documents: DataFrame, field: Field, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, category`` of documents with a span of the category, once each."""
    return map_rows(pick(documents, doc, text), f"`{doc}` BIGINT, category STRING", partial(_found, field)).distinct()


def _offsets(field: Field):
    def work(docs, texts):
        units, post = field.tag(texts)
        for n, c, first, _, mean, size in _offending(spans(units, post)):
            where = positions(texts[n])
            yield docs[n], c, where[first][0], where[first + size - 1][1], mean

    return work


def positions(text: str) -> list[tuple[int, int]]:
    """Start and end in the text of each of its tokens."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    apart = [m.span() for m in _APART.finditer(low)]
    out, k = [], 0
    for m in _TOKEN.finditer(low):
        while k < len(apart) and apart[k][1] <= m.start():
            k += 1
        if k < len(apart) and apart[k][0] < m.start() < apart[k][1] and out:
            out[-1] = (out[-1][0], m.end())
        else:
            out.append(m.span())
    return out


def offsets(documents: DataFrame, field: Field, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, category, start_char, end_char, confidence`` of every offending span."""
    return map_rows(pick(documents, doc, text), f"`{doc}` BIGINT, category STRING, start_char INT, end_char INT, confidence DOUBLE", partial(_offsets, field))


def rates(documents: DataFrame, field: Field, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Documents per source, and the share of them with a span of each category, as in :func:`offending`; pre-aggregated
    before the shuffle."""
    found = map_rows(pick(documents, doc, text, source), "source STRING, toxic INT, nsfw INT", partial(_with_source, field))
    return found.groupBy("source").agg(F.count("*").alias("documents"), F.avg("toxic").alias("toxic_rate"), F.avg("nsfw").alias("nsfw_rate"))


def _with_source(field: Field):
    def work(docs, texts, sources):
        hits = {(f[0], f[1]) for f in _offending(spans(*field.tag(texts)))}
        for n, s in enumerate(sources):
            yield s, int((n, "toxic") in hits), int((n, "nsfw") in hits)

    return work
