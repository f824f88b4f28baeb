"""Problem 5: the language of each document and of each segment of a mixed one.

A linear softmax over averaged hashed subword embeddings, trained here by
stochastic gradient descent in numpy on the fixed table of clean sentences.
Words are cut into character n-grams with their ends marked; every n-gram has a
hashed row of the embedding table.  As the model is linear, embedding and
output weights are multiplied once into one row of scores per bucket, and the
scores of a word are remembered.

Rejection is calibrated on held-out sentences: a temperature makes confidence
match accuracy, and a text whose n-grams are less familiar than almost all
held-out sentences gets no language.

Defined results: null, blank and wordless texts have no language (null, 0.0);
ties go to the language first in alphabetical order; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, pick

BUCKETS = 1 << 15
DIM = 16
EPOCHS = 16
#: ISO 639 codes and names by which labels name a language.
NAMES = {
    "en": "en eng english anglais englisch inglés inglese inglês английский 英语 英文",
    "de": "de deu ger german deutsch allemand alemán tedesco alemão немецкий 德语 德文",
    "fr": "fr fra fre french français francais französisch francés francese francês французский 法语 法文",
    "es": "es spa spanish español espanol castellano spanisch espagnol spagnolo espanhol испанский 西班牙语",
    "it": "it ita italian italiano italienisch italien итальянский 意大利语",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese португальский 葡萄牙语",
    "ru": "ru rus russian русский russisch russe ruso russo 俄语 俄文",
    "zh": "zh zho chi cmn chinese 中文 汉语 漢語 chinesisch chinois chino cinese chinês китайский mandarin",
}

_WORD = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]+")
_STOP = re.compile(r"[.!?]+(?=[\s\"'”»)]|$)|[。！？]+|\n")


def label_code(label: str | None) -> str | None:
    """The two-letter code a label names, in whatever spelling, region or script; None where it names no language."""
    if not label:
        return None
    head = re.split(r"[-_.@ (]", unicodedata.normalize("NFKC", label).strip().lower())[0]
    return _CODES.get(head)


_CODES = {w: code for code, names in NAMES.items() for w in names.split()}


def grams(word: str) -> list[int]:
    """Hashed buckets of a word's n-grams; of Chinese, single characters and pairs."""
    if "㐀" <= word[0] <= "鿿":
        parts = [*word, *(word[i : i + 2] for i in range(len(word) - 1))]
    else:
        w = f"<{word}>"
        parts = [w, *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))]
    h = xxhash.xxh32_intdigest
    return [h(p) % BUCKETS for p in parts]


class Model:
    """Scores per bucket, the buckets seen in training, and what calibration found."""

    #: Words whose scores are kept at a time; beyond them remembering starts anew.
    REMEMBERED = 300_000

    def __init__(self, langs: list[str], table: np.ndarray, seen: np.ndarray, temperature: float, familiar: float, common: dict[str, list[int]]):
        self.langs, self.table, self.seen, self.temperature, self.familiar, self.common = langs, table, seen, temperature, familiar, common
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, 2 * len(langs) + 3), np.float32)

    def __getstate__(self):
        return self.langs, self.table, self.seen, self.temperature, self.familiar, self.common

    def __setstate__(self, state):
        self.__init__(*state)

    def words(self, words: list[str]) -> np.ndarray:
        """Per word: summed scores, number of n-grams, number of familiar n-grams, whether frequent in each language, letters."""
        rows = self.rows
        if len(rows) > self.REMEMBERED:
            rows.clear()
        get = rows.get
        ids = [get(w, -1) for w in words]
        if -1 in ids:
            for n, i in enumerate(ids):
                if i < 0:
                    ids[n] = self._add(words[n])
        return self.scores[ids]

    def _add(self, word: str) -> int:
        at = self.rows.get(word)
        if at is None:
            at = self.rows[word] = len(self.rows)
            if at >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            g = grams(word)
            k = len(self.langs)
            self.scores[at, :k] = self.table[g].sum(0)
            self.scores[at, k] = len(g)
            self.scores[at, k + 1] = self.seen[g].sum()
            self.scores[at, k + 2 : 2 * k + 2] = 0
            self.scores[at, [k + 2 + c for c in self.common.get(word, ())]] = 1
            self.scores[at, 2 * k + 2] = len(word)
        return at

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        k = len(self.langs)
        logits = sums[:, :k] / np.maximum(sums[:, k : k + 1], 1) / self.temperature
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _train_table(x: list[np.ndarray], y: np.ndarray, k: int, rng: np.random.Generator, epochs: int) -> np.ndarray:
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, k), np.float32)
    for epoch in range(epochs):
        rate = 6.0 * (1 - epoch / epochs)
        order = rng.permutation(len(x))
        for part in np.array_split(order, max(1, len(x) // 16)):
            flat = np.concatenate([x[i] for i in part])
            sizes = np.array([len(x[i]) for i in part])
            starts = np.r_[0, sizes.cumsum()[:-1]]
            hidden = np.add.reduceat(emb[flat], starts) / sizes[:, None]
            logits = hidden @ out
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p /= len(part)
            back = (p @ out.T) / sizes[:, None]
            out -= rate * hidden.T @ p
            step = np.repeat(-rate * len(part) * back, sizes, 0)
            by = flat.argsort(kind="stable")
            hit, first = np.unique(flat[by], return_index=True)
            emb[hit] += np.add.reduceat(step[by], first)
    return emb @ out


def train(samples: list[tuple[str, str]], common: list[tuple[str, str]] = (), seed: int = 7, epochs: int = EPOCHS) -> Model:
    """``samples``: (language, sentence).  Whole sentences and pieces of four words are the training texts.

    A fifth of the sentences is held out first, for the temperature and the bound of familiarity; then all are used.
    """
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in samples})
    frequent: dict[str, list[int]] = {}
    for lang, word in common:
        if lang in langs:
            frequent.setdefault(word.lower(), []).append(langs.index(lang))
    texts = [(langs.index(lang), _WORD.findall(t.lower())) for lang, t in samples]
    texts = [(c, w) for c, w in texts if w]
    hold = np.zeros(len(texts), bool)
    hold[rng.permutation(len(texts))[: len(texts) // 5]] = True

    def examples(mask):
        x, y = [], []
        for (c, w), use in zip(texts, mask, strict=True):
            if use:
                for piece in (w, *(w[i : i + 4] for i in range(0, len(w) - 3, 4))):
                    x.append(np.array([b for word in piece for b in grams(word)]))
                    y.append(c)
        return x, np.array(y)

    def seen(x):
        s = np.zeros(BUCKETS, bool)
        s[np.concatenate(x)] = True
        return s

    if hold.any() and (~hold).any():
        x, y = examples(~hold)
        trial = Model(langs, _train_table(x, y, len(langs), rng, epochs // 2), seen(x), 1.0, 0.0, {})
        sums = np.stack([trial.words(w).sum(0) for (c, w), h in zip(texts, hold, strict=True) if h])
        truth = np.array([c for (c, _), h in zip(texts, hold, strict=True) if h])
        loss = []
        for t in np.geomspace(0.25, 8, 16):
            trial.temperature = t
            loss.append((-np.log(trial.probabilities(sums)[np.arange(len(truth)), truth] + 1e-9).mean(), t))
        temperature = min(loss)[1]
        familiar = float(np.quantile(sums[:, len(langs) + 1] / sums[:, len(langs)], 0.01))
    else:
        temperature, familiar = 1.0, 0.0
    x, y = examples(np.ones(len(texts), bool))
    return Model(langs, _train_table(x, y, len(langs), rng, epochs), seen(x), float(temperature), familiar, frequent)


def pieces(text: str) -> list[tuple[int, int, bool]]:
    """Spans of a text's sentences and other pieces, and whether each ends as a sentence.

    Long lines are wrapped and go on in the next; short ones end a piece, as a blank line does.
    """
    out, last = [], 0
    lines = text.split("\n")
    at, soft = 0, set()
    for n, line in enumerate(lines[:-1]):
        at += len(line) + 1
        if len(line) >= 45 and lines[n + 1].strip():
            soft.add(at - 1)
    for m in _STOP.finditer(text):
        if m.group() == "\n" and m.start() in soft:
            continue
        if m.end() > last:
            out.append((last, m.end(), m.group() != "\n"))
        last = m.end()
    if last < len(text):
        out.append((last, len(text), False))
    return out


#: A sentence counts as one of another language from this many words (or characters of Chinese), with this confidence
#: and with more of that language's frequent words than of the main one's.
SENTENCE_WORDS = 4
SENTENCE_HAN = 8
SURE = 0.9
#: Languages that their letters alone tell from the others here; their sentences need no frequent words.
OWN_SCRIPT = ("ru", "zh")
#: Texts of less familiar n-grams are still accepted for sentences this familiar (two, or a tenth of the text).
SURELY_FAMILIAR = 0.84
#: Mean letters of a word below which a text is code or figures.  Runs of Chinese are longer.
SHORTEST_WORDS = 2.6


class Text:
    """What was found in one text: main language or None, its confidence, and a language for each piece."""

    __slots__ = ("main", "confidence", "spans", "langs", "confidences")

    def __init__(self, main=None, confidence=0.0, spans=(), langs=(), confidences=()):
        self.main, self.confidence, self.spans, self.langs, self.confidences = main, confidence, spans, langs, confidences


def analyse(model: Model, texts: list[str | None]) -> list[Text]:
    """The languages of many texts at once: one pass over the words of all, one softmax over all their pieces."""
    k, zh = len(model.langs), model.langs.index("zh") if "zh" in model.langs else -1
    words: list[str] = []
    sizes: list[int] = []
    owned: list[list[tuple[int, int, bool]]] = []
    for t in texts:
        own: list[tuple[int, int, bool]] = []
        if t:
            low = t.lower()
            if len(low) != len(t):
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
            findall = _WORD.findall
            for span in pieces(t):
                found = findall(low, span[0], span[1])
                if found:
                    words += found
                    sizes.append(len(found))
                    own.append(span)
        owned.append(own)
    if not words:
        return [Text() for _ in texts]
    counts = np.array(sizes)
    sums = np.add.reduceat(model.words(words), np.r_[0, counts.cumsum()[:-1]])
    prob = model.probabilities(sums)
    best = prob.argmax(1)
    sure = prob[np.arange(len(best)), best]
    whole = np.array([s[2] for own in owned for s in own])
    length = np.array([s[1] - s[0] for own in owned for s in own])
    long = np.where(best == zh, length >= SENTENCE_HAN, counts >= SENTENCE_WORDS)
    known = sums[:, k + 1] >= model.familiar * sums[:, k]
    strong = whole & long & known & (sure >= SURE)
    frequent = sums[:, k + 2 : 2 * k + 2]
    own_frequent = frequent[np.arange(len(best)), best]
    own_script = np.array([lang in OWN_SCRIPT for lang in model.langs])
    out, at = [], 0
    for own in owned:
        n = len(own)
        if not n:
            out.append(Text())
            continue
        part = slice(at, at + n)
        at += n
        total = sums[part].sum(0)
        letters, n_words = total[2 * k + 2], counts[part].sum()
        plain = strong[part] & (sums[part, k + 1] >= SURELY_FAMILIAR * sums[part, k])
        strange = total[k + 1] < model.familiar * total[k] or letters < SHORTEST_WORDS * n_words
        if strange and plain.sum() < 2 and (length[part] * plain).sum() < 0.1 * length[part].sum():
            out.append(Text())
            continue
        weight = np.bincount(best[part], weights=length[part] * strong[part], minlength=k)
        doc = model.probabilities(total[None])[0]
        main = int(weight.argmax()) if weight.any() else int(doc.argmax())
        other = strong[part] & (best[part] != main)
        if other.any():
            other &= (own_frequent[part] > frequent[part, main]) | own_script[best[part]]
        langs = np.where(other, best[part], main)
        confidence = doc[main]
        if weight.any():
            mine = strong[part] & (best[part] == main)
            confidence = max(confidence, sure[part][mine].mean())
        out.append(Text(model.langs[main], float(confidence), own, langs.tolist(), prob[part][np.arange(n), langs].tolist()))
    return out


def load(samples: DataFrame, common_words: DataFrame) -> Model:
    """The model trained on the fixed tables of clean sentences and of frequent words."""
    rows = [(r[0], r[1]) for r in samples.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text").distinct().orderBy("lang", "text").collect()]
    common = [(r[0], r[1]) for r in common_words.where(F.col("lang").isNotNull() & F.col("word").isNotNull()).select("lang", "word").distinct().orderBy("lang", "word").collect()]
    return train(rows, common)


def _found(model: Model):
    def work(docs, texts, labels):
        for d, label, x in zip(docs, labels, analyse(model, texts), strict=True):
            if x.main is None:
                continue
            langs = {model.langs[c] for c in x.langs} | {x.main}
            if len(langs) > 1 or label_code(label) != x.main:
                for lang in sorted(langs):
                    yield d, lang

    return work


def mislabelled(documents: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``doc, found_lang``: the languages of documents without a right label and of those in several languages."""
    return map_rows(pick(documents, doc, text, label), f"`{doc}` BIGINT, found_lang STRING", partial(_found, model)).distinct()


def _segments(model: Model):
    def work(docs, texts):
        for d, x in zip(docs, analyse(model, texts), strict=True):
            merged: list[list] = []
            for (a, b, _), c, p in zip(x.spans, x.langs, x.confidences, strict=True):
                if merged and merged[-1][2] == c:
                    merged[-1][1], merged[-1][3] = b, merged[-1][3] + p * (b - a)
                    merged[-1][4] += b - a
                else:
                    merged.append([a, b, c, p * (b - a), b - a])
            if not merged:
                yield d, 0, 0, 0, None, 0.0
            for n, (a, b, c, p, size) in enumerate(merged):
                yield d, n, a, b, model.langs[c], p / max(1, size)

    return work


def segments(documents: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, segment, start_char, end_char, found_lang, confidence``: the runs of one language in each document.

    A document without a language has one row with null.
    """
    schema = f"`{doc}` BIGINT, segment INT, start_char BIGINT, end_char BIGINT, found_lang STRING, confidence DOUBLE"
    return map_rows(pick(documents, doc, text), schema, partial(_segments, model))
