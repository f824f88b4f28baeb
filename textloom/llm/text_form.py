"""Problem 4: per-document text statistics and the form of a text: prose, list, table or junk.

The statistics of a text and of its layout are thresholded by labelling
functions, each of which votes for one form or abstains.  How far each function
can be trusted is not given: expectation-maximisation over the votes of all
documents learns a confusion table per function, and the posterior of a
document's votes is its form.

EM runs on the counts of distinct vote patterns.  Each function votes for
one form or abstains, so their number is bounded by a constant whatever the
corpus; Spark counts them over all rows and only the counts reach the driver.

Defined results: a null or blank text has no form (null), zero counts and
ratios; ties between forms go to the earlier of FORMS; repeated rows count as
often as they occur; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import partial

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, pick

FORMS = ("prose", "list", "table", "junk")

_WORD = re.compile(r"[㐀-鿿぀-ヿ]|[^\W㐀-鿿぀-ヿ_]+(?:['’-][^\W㐀-鿿぀-ヿ_]+)*")
_ASCII_WORD = re.compile(r"[a-z0-9]+(?:['-][a-z0-9]+)*")
_LINE = re.compile(r"[^\n]*\S[^\n]*")
_ENDS = re.compile(r"[.!?…。！？][\"'”’»)\]]*[ \t\r]*$", re.M)
_STOP = re.compile(r"[.!?]+(?=[\s\"'”»)]|$)|[。！？]+|\n")
_MARKER = re.compile(r"^[ \t]*(?:[-*•·–—+▪◦‣●○>→✓☐]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\])[ \t]+\S", re.M)
_LEADER = re.compile(r"(?:\.{4,}|(?: \.){3,})[ \t]*\d+[ \t\r]*$", re.M)
_DUMP = frozenset(a + b for a in "0123456789abcdefABCDEF" for b in "0123456789abcdefABCDEF")
_CELLS = re.compile(r"(?<!\S)(?:[-+]?[\d.,:/]*\d[\d.,:/]*%?|-|n/a)(?!\S)", re.I)
_TOKENS = r"\b(?=[^\W\d]*+\d)(?=[^\WA-Za-z]*+[A-Za-z])\w{6,}|\b[0-9a-f]{2}\b(?= [0-9a-f]{2}\b)"
_MIXED, _MIXED_PLAIN = re.compile(rf"{_TOKENS}|[A-Za-z]++[=%&][A-Za-z]"), re.compile(_TOKENS)  # the latter for texts without these signs
_TO_CELLS = re.compile(r'[|,;"\t]')
_HAN = re.compile("[\u3400-\u9fff]")
_CODE = "{}()[]=<>"
_NOISE = re.compile(r"[`~|^](?<=[\w.,?!].)(?=\s|$)|[.?!;](?<=[a-z].)(?=[a-z])")
_INLINE = ",;、，；•·|/"
_DELIMS = ("|", "\t", ";", ",")
_GAP = re.compile(r"\S(?: {2,}|\t+)(?=\S)")


class Letters:
    """How usual the letter pairs of a text are, after the sample sentences of all languages."""

    def __init__(self, samples: list[str]):
        pairs: Counter = Counter()
        for s in samples:
            for w in re.findall(r"[^\W\d_]+", s.lower()):
                pairs.update(zip(f" {w}", f"{w} ", strict=True))
        total = sum(pairs.values())
        self.floor = math.log(0.02 / max(1, total))
        self.log = {k: math.log(v / total) for k, v in pairs.items()}
        own = [self.score(s) for s in samples if not _HAN.search(s)] or [0.0]
        self.low = float(np.quantile(own, 0.01)) - 0.3

    def score(self, text: str) -> float:
        words = re.findall(r"[^\W\d_]+", text.lower())
        get, floor, n, total = self.log.get, self.floor, 0, 0.0
        for w in words:
            n += len(w) + 1
            for p in zip(f" {w}", f"{w} ", strict=True):
                total += get(p, floor)
        return total / n if n else floor


STATS = ("n_words", "mean_word_len", "symbol_ratio", "punct_line_share", "common_share")


def statistics(text: str | None, common: frozenset) -> tuple[int, float, float, float, float]:
    """Word count, mean word length, symbols (what stands outside words) per character that isn't white space, share of lines that end in
    punctuation, share of words in ``common``."""
    if not text or not text.strip():
        return 0, 0.0, 0.0, 0.0, 0.0
    low = text.lower()
    words = (_ASCII_WORD if low.isascii() else _WORD).findall(low)
    n = len(words)
    letters = sum(map(len, words))
    lines = len(_LINE.findall(text))
    solid = sum(map(len, text.split()))
    return (
        n,
        letters / n if n else 0.0,
        max(0, solid - letters) / solid,
        min(1.0, len(_ENDS.findall(text)) / lines),
        sum(map(common.__contains__, words)) / n if n else 0.0,
    )


def _rows(lines: list[str]) -> float:
    """Share of the lines, up to two of them aside, that are rows with as many cells as most."""
    n, best, text = len(lines), 0.0, "\n".join(lines)
    for d in _DELIMS:
        if text.count(d) < 0.8 * n:
            continue
        counts = [x.count(d) for x in lines]
        cells, hits = max(((c, k) for c, k in Counter(counts).items() if c), key=lambda x: x[1], default=(0, 0))
        if hits >= 3 and (cells >= 2 or d in "|\t;"):
            chars = sum(len(x) for x, c in zip(lines, counts, strict=True) if c == cells) / hits / (cells + 1)
            if chars <= 24:
                best = max(best, hits / max(3, n - min(2, n - hits)))
    if text.count("  ") + text.count("\t") >= 0.8 * n:
        gaps = sum(bool(_GAP.search(x.strip())) for x in lines)
        if gaps >= 3:
            best = max(best, gaps / max(3, n - min(2, n - gaps)))
    return best


def _sentences(text: str, least_chars: int, least_gaps: int) -> tuple[float, int]:
    """Share of the text in sentences, pieces of some length that end in a stop, and their words."""
    last = chars = words = 0
    for m in _STOP.finditer(text):
        if m.group() != "\n":
            n, gaps = m.end() - last, text.count(" ", last, m.start())
            if n > least_chars and gaps >= least_gaps:
                chars += n
                words += gaps + 1
        last = m.end()
    return chars / max(1, len(text)), words


def votes(text: str, stats: tuple, common: frozenset, letters: Letters) -> str:
    """One digit per labelling function: 0 abstains, otherwise 1 + the number of the form in FORMS.

    A title and a single sentence don't count: shares of lines leave up to two lines aside.
    """
    n, mean_len, symbols, punct, share = stats
    lines = _LINE.findall(text)
    m = len(lines)
    body = lines[1:] if m > 1 and len(lines[0]) < 120 else lines
    flat = "".join(f"{x} " if len(x) >= 45 else f"{x}\n" for x in body)  # long lines are wrapped, short ones end
    han = 0.0 if flat.isascii() else len(_HAN.findall(flat)) / max(1, len(flat))
    in_sentences, sentence_words = _sentences(flat, *((8, 0) if han > 0.3 else (20, 3)))
    markers = len(_MARKER.findall(text)) if m > 1 else 0
    leaders = len(_LEADER.findall(text)) if "...." in text or ". . ." in text else 0
    n_pieces = sum(map(flat.count, _INLINE)) + 1
    sparse = n_pieces <= n / 6
    noise = len(_NOISE.findall(text)) / max(1, n)
    code = sum(map(text.count, _CODE)) / max(1, len(text))
    aside = lambda hits: hits / max(1, m - min(2, m - hits))
    listed = aside(markers) >= 0.8 and markers >= 3 or aside(leaders) >= 0.4 and leaders >= 3
    clean = noise < 0.2 and code < 0.06 and not listed
    prose = (
        1 if in_sentences >= 0.5 and share >= 0.1 and clean else 0,
        1 if share >= 0.12 and n / m >= 7 and sparse and clean else 0,
    )
    tokens = text.split()
    symbols = 0.0 if leaders >= 3 else symbols
    solid = max(1, sum(map(len, tokens)))
    cells = _TO_CELLS.sub(" ", text).split()
    numeric = sum(not c.isalpha() and _CELLS.fullmatch(c) is not None for c in cells) / max(1, len(cells))
    rows = _rows(lines) if m >= 3 else 0.0
    short = sum(len(x) <= (14 if han > 0.3 else 46) and x.count(" ") <= 6 for x in lines)
    mixed = sum(map(len, (_MIXED if "=" in text or "%" in text or "&" in text else _MIXED_PLAIN).findall(text))) / solid
    long_tokens = sum(len(t) for t in tokens if len(t) > 22 and not t.startswith(("http", "www"))) / solid
    strange = share < 0.12 and han < 0.1 and n >= 4 and letters.score(text) < letters.low
    is_rows = rows >= 0.8 and in_sentences < 0.5 and (numeric >= 0.1 or text.count("|") >= 2 * m or text.count("\t") + text.count(";") >= m)
    cell_rows = m >= 3 and numeric >= 0.25 and in_sentences < 0.3 and han < 0.3 and len(tokens) >= 2 * m and aside(sum(bool(_CELLS.search(x)) for x in lines)) >= 0.75
    odd = symbols > 0.35 and not listed or strange or mixed > 0.35 or code > 0.08 or noise > 0.3
    dump = sum(map(_DUMP.__contains__, tokens)) >= 0.5 * len(tokens)
    is_rows, cell_rows = is_rows and not dump, cell_rows and not dump
    table = is_rows or cell_rows and mixed < 0.3
    out = (
        2 if listed and not odd else 0,
        2 if m >= 4 and aside(short) >= 0.85 and short >= 4 and not odd and not table and (punct < 0.9 or listed) else 0,
        2 if n_pieces >= 5 and n <= 6 * n_pieces and in_sentences < 0.3 and not odd and not table and m <= 4 + len(flat) / 40 else 0,
        3 if is_rows and not listed else 0,
        3 if cell_rows and mixed < 0.3 and not listed else 0,
        4 if symbols > 0.35 and not table and not listed and share < 0.1 else 0,
        4 if strange and not table else 0,
        4 if dump or (mixed > 0.35 or long_tokens > 0.5 and han < 0.1) and not table and share < 0.1 else 0,
        4 if code > 0.08 and not table else 0,
        4 if noise > 0.3 and share < 0.2 and not table and not listed else 0,
        *prose,
        1 if in_sentences >= 0.35 and share >= 0.05 and clean and sentence_words >= 12 and not table and not odd and not listed else 0,
        1 if share >= 0.02 and symbols < 0.15 and numeric < 0.1 and clean and n / m >= 12 and sparse and not odd else 0,
    )
    return "".join(map(str, out))


def fit(patterns: list[tuple[str, int]], rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns and their counts: the accuracy of each function, and its form or -1.

    A function's accuracy is how often its form is right where it votes; abstaining says nothing, and the forms are
    equally likely beforehand.  Accuracies start at 0.8 with the weight of a twentieth of the votes.
    """
    k = len(patterns[0][0])
    v = np.array([[int(x) for x in p] for p, _ in patterns])
    w = np.array([n for _, n in patterns], float)
    own = v.max(0) - 1
    total = ((v > 0) * w[:, None]).sum(0)
    accuracy = np.full(k, 0.8)
    for _ in range(rounds):
        post = _posterior(v, accuracy, own) * w[:, None]
        right = np.array([(post[:, own[j]] * (v[:, j] > 0)).sum() for j in range(k)])
        accuracy = np.clip((right + 0.8 * (0.05 * total + 1)) / (1.05 * total + 1), 0.3, 0.995)
    return accuracy, own


def _posterior(v: np.ndarray, accuracy: np.ndarray, own: np.ndarray) -> np.ndarray:
    c = len(FORMS)
    score = np.zeros((len(v), c))
    score[:, 0] = 1e-6  # no vote: prose
    for j in range(v.shape[1]):
        if own[j] >= 0:
            gain = np.full(c, np.log((1 - accuracy[j]) / (c - 1)))
            gain[own[j]] = np.log(accuracy[j])
            score += (v[:, j] > 0)[:, None] * gain
    score = np.exp(score - score.max(1, keepdims=True))
    return score / score.sum(1, keepdims=True)


def _vote_rows(common: frozenset, samples: list[str]):
    letters = Letters(samples)

    def work(docs, texts):
        for d, t in zip(docs, texts, strict=True):
            s = statistics(t, common)
            yield (d, *s, None if not t or not t.strip() else votes(t, s, common, letters))

    return work


def load_words(common_words: DataFrame) -> frozenset:
    """The words of the fixed table of frequent words, lower case."""
    return frozenset(r[0].lower() for r in common_words.where(F.col("word").isNotNull()).select("word").distinct().collect())


def voted(documents: DataFrame, common_words: DataFrame, samples: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, the statistics and ``votes`` for every document."""
    schema = f"`{doc}` BIGINT, n_words BIGINT, mean_word_len DOUBLE, symbol_ratio DOUBLE, punct_line_share DOUBLE, common_share DOUBLE, votes STRING"
    return map_rows(pick(documents, doc, text), schema, partial(_vote_rows, load_words(common_words), samples))


def text_forms(documents: DataFrame, common_words: DataFrame, samples: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, statistics, ``form`` and its posterior ``confidence`` for every document.

    The texts are read once: the small rows of statistics and votes are kept on disk between counting and scoring.
    """
    rows = voted(documents, common_words, samples, doc, text).persist(StorageLevel.MEMORY_AND_DISK)
    patterns = sorted((r[0], r[1]) for r in rows.where(F.col("votes").isNotNull()).groupBy("votes").count().collect())
    form, confidence = posterior_maps(patterns)
    table = documents.sparkSession.createDataFrame([(p, form[p], confidence[p]) for p in form], "votes STRING, form STRING, confidence DOUBLE")
    return rows.join(F.broadcast(table), "votes", "left").select(*[c for c in rows.columns if c != "votes"], "form", "confidence")


def posterior_maps(patterns: list[tuple[str, int]]) -> tuple[dict[str, str], dict[str, float]]:
    """The form and its posterior for each vote pattern, after EM over all of them."""
    if not patterns:
        return {}, {}
    post = _posterior(np.array([[int(x) for x in p] for p, _ in patterns]), *fit(patterns))
    best = post.argmax(1)
    return {p: FORMS[b] for (p, _), b in zip(patterns, best, strict=True)}, {p: float(post[n, b]) for n, ((p, _), b) in enumerate(zip(patterns, best, strict=True))}
