"""Problem 6: the main content of web pages.

From HTML, events of the standard library's streaming parser give, per line of
text, its characters and the tags around it: start tags count to the line they
open, end tags to the line they close, and each tag has a weight, small for
tags of running text and large for those that lay a page out.  The log of this
text-to-tag ratio is put to either side of the border between two clusters
(2-means over the lines of all pages), squashed, and smoothed along the page with a
Gaussian; lines above the border are main content.  Enough text outweighs any
tag: an article in bare ``div`` elements is main content.

A payload of plain text has lost its tags.  Records whose page was kept as HTML
get the ratios of that page, line by line.  For all other lines the ratio is
predicted: from the words and the shape of the line, after all pages with HTML,
by a logistic model; and then once more from the ratios Gaussian-smoothed over
the lines before and behind it, which is what tells a page's own title from the
titles in a sidebar.  The pages are fitted in parts by a hash of their key, from
the same start, and the parts' weights are averaged by what each has seen, so
the model is the same however the rows are partitioned.  Where a page's own ratio is
close to the border, the prediction is added to it.

Defined results: null and blank payloads have no lines to report and null or
unchanged main text; blank lines are never reported; without any HTML to learn
from, the ratio is the line's length against a fixed width; of several pages of
one record the one with the smallest key counts; rows delivered twice give one
set of rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models
from .batches import map_rows, pick

#: Pages in a part that is fitted by itself, about; all parts count.
PART_PAGES = 1500
BUCKETS = 1 << 16
SIGMAS = (0.8, 2.0, 5.0)

SKIPPED = frozenset("script style noscript template title head svg".split())
#: Tags that end a line of text, with what each start or end tag weighs against the text.
BLOCKS = {
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote td th tr caption figcaption br hr".split(), 0.1),
    **dict.fromkeys("ul ol dl table figure body".split(), 0.2),
    **dict.fromkeys("main article section".split(), 1.0),
    **dict.fromkeys("div header".split(), 16.0),
    **dict.fromkeys("nav aside footer form menu dialog button".split(), 20.0),
}
INLINE = {"a": 2.0}
#: Lists inside these stand under their weight.
HOLDERS = frozenset("nav aside footer form menu dialog".split())
LISTS = frozenset("ul ol dl li dd dt a".split())
#: The border between the clusters of log ratios where no pages tell, how wide it is, and the share and reach of the smoothing.
BORDER, WIDTH = 1.7, 0.7
SMOOTH, SIGMA = 0.5, 1.5
#: A page's own ratio decides alone from this distance to the border on.
CLEAR = 0.5


class Lines(HTMLParser):
    """Collects [text, characters, weight of its tags] per line of text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.skip = 0
        self.parts: list[str] = []
        self.weight = self.held = 0.0

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += tag != "head"
            return
        own = BLOCKS.get(tag)
        if own is not None:
            self.flush()
            if tag in HOLDERS:
                self.held = own
            elif tag not in LISTS:
                self.held = 0.0
            elif tag == "li":
                self.weight += self.held
        self.weight += own if own is not None else INLINE.get(tag, 0.1)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - (tag != "head"))
            return
        own = BLOCKS.get(tag)
        if own is not None:
            self.flush()
            if tag in HOLDERS:
                self.held = 0.0
        w = own if own is not None else INLINE.get(tag, 0.1)
        if self.rows and not "".join(self.parts).strip():
            self.rows[-1][2] += w
        else:
            self.weight += w

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)

    def flush(self):
        for line in "".join(self.parts).split("\n"):
            line = line.strip()
            if line:
                self.rows.append([line, len(line), self.weight])
                self.weight = 0.0
        self.parts = []


def html_lines(html: str) -> list[list]:
    p = Lines()
    p.feed(html)
    p.close()
    p.flush()
    return p.rows


def tag_ratio(rows: list[list]) -> np.ndarray:
    """Log text-to-tag ratio of each line."""
    return np.log1p(np.array([r[1] for r in rows], float)) - np.log1p(np.array([r[2] for r in rows], float))


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along a page, normalised at its ends."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    if len(values) == 0:
        return values
    top = np.convolve(values, kernel)[reach : reach + len(values)]
    return top / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def threshold(values: np.ndarray, rounds: int = 20) -> float:
    """The border between two clusters of values, by 2-means; 0 where there is one cluster only."""
    low, high = float(values.min(initial=0.0)), float(values.max(initial=0.0))
    if high - low < 1e-9:
        return 0.0
    for _ in range(rounds):
        cut = (low + high) / 2
        a, b = values[values <= cut], values[values > cut]
        low, high = float(a.mean()) if len(a) else low, float(b.mean()) if len(b) else high
    return (low + high) / 2


def sides(ratio: np.ndarray, border: float = BORDER) -> np.ndarray:
    """Log ratios of a page's lines as -1 to 1, above 0 where they are main content."""
    own = np.tanh((ratio - border) / WIDTH)
    return (1 - SMOOTH) * own + SMOOTH * smoothed(own, SIGMA)


def html_main(html: str, border: float = BORDER) -> tuple[list[str], list[bool]]:
    """The lines of an HTML page, and whether each is main content."""
    rows = html_lines(html)
    return [r[0] for r in rows], (sides(tag_ratio(rows), border) > 0).tolist() if rows else []


_WORD = re.compile(r"[㐀-鿿]|\d+|[^\W\d_㐀-鿿]+|[^\w\s]")
_DIGITS = re.compile(r"\d+")
_LETTER = re.compile(r"[^\W\d_]+")


def _hash(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) & (BUCKETS - 1)


def line_features(line: str) -> list[str]:
    """Features of one line: words, word pairs, shape, and the line as a whole with figures made equal."""
    s = line.strip()
    low = _WORD.findall(_DIGITS.sub("0", s.lower())) or [""]
    n = len(low)
    size = min(n, 4) if n < 5 else 5 if n < 8 else 6 if n < 13 else 7 if n < 21 else 8
    letters = _LETTER.findall(s)
    upper = sum(w[0].isupper() for w in letters)
    shape = [
        f"#n{size}",
        f"#end{s[-1] if not s[-1].isalnum() else 'w'}{size}",
        f"#start{s[0] if not s[0].isalnum() else 'w'}{min(size, 6)}",
        f"#case{'U' if s.isupper() else 'T' if letters and upper == len(letters) else 'S' if letters and letters[0][0].isupper() else 'l'}{min(size, 6)}",
        f"#caps{min(3, 4 * upper // max(1, len(letters)))}{size}",
        "#gap" if "  " in s else "#nogap",
        f"={' '.join(low)}",
        f"^{' '.join(low[:2])}",
        f"${' '.join(low[-2:])}",
    ]
    pairs = list(dict.fromkeys(map(" ".join, zip(low, low[1:], strict=False))))
    return shape + list(dict.fromkeys(low)) + pairs


class Weights(dict):
    """The weight of a feature, remembered."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, feature: str) -> float:
        if len(self) > 500_000:
            self.clear()
        w = self[feature] = float(self.weights[_hash(feature)])
        return w


class LineModel:
    """Logistic weights for lines, and for lines in their context."""

    REMEMBERED = 300_000

    def __init__(self, weights: np.ndarray, bias: float, mean: np.ndarray, scale: np.ndarray, layers: list[np.ndarray], cut: float, border: float = BORDER):
        self.weights, self.bias, self.mean, self.scale, self.layers, self.cut, self.border = weights, bias, mean, scale, layers, cut, border
        self.seen: dict[str, float] = {}
        self.known = Weights(weights)

    def save(self, spark, path: str) -> None:
        layers = {f"layer{n}": x for n, x in enumerate(self.layers)}
        models.save(spark, path, weights=self.weights, bias=self.bias, mean=self.mean, scale=self.scale, cut=self.cut, border=self.border, **layers)

    @staticmethod
    def load(spark, path: str) -> LineModel:
        a = models.load(spark, path)
        layers = [a[f"layer{n}"] for n in range(sum(k.startswith("layer") for k in a))]
        return LineModel(a["weights"], float(a["bias"]), a["mean"], a["scale"], layers, float(a["cut"]), float(a["border"]))

    def __getstate__(self):
        return self.weights, self.bias, self.mean, self.scale, self.layers, self.cut, self.border

    def __setstate__(self, state):
        self.__init__(*state)

    def ratio(self, lines: list[str]) -> np.ndarray:
        """Predicted log ratio of each line by itself; long lines that recur nowhere are not remembered."""
        seen, known, out = self.seen, self.known, []
        if len(seen) > self.REMEMBERED:
            seen.clear()
        for line in lines:
            v = seen.get(line)
            if v is None:
                f = line_features(line)
                v = min(12.0, max(-12.0, sum(map(known.__getitem__, f)) / math.sqrt(len(f)) + self.bias))
                if len(line) < 120:
                    seen[line] = v
            out.append(v)
        return np.array(out)

    def in_context(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.scale) @ self.layers[0] + self.layers[1])
        return h @ self.layers[2] + self.layers[3][0]


def context(ratio: np.ndarray, size: np.ndarray, starts: np.ndarray, page: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Per line of some pages: its own ratio and size, both of its neighbours, and what is before and behind it,
    Gaussian-smoothed from either side."""
    n = len(ratio)
    first = starts[page]
    last = np.r_[starts[1:], n][page] - 1
    at = np.arange(n)
    columns = [ratio, size, kind]
    for k in (1, 2, 3):
        for d in (-k, k):
            to = at + d
            ok = (to >= first) & (to <= last)
            to = np.clip(to, 0, max(0, n - 1))
            columns += [np.where(ok, ratio[to], -3.0), np.where(ok, size[to], -1.0)] + ([np.where(ok, kind[to], -1.0)] if k == 1 else [])
    for sigma in SIGMAS:
        reach = int(3 * sigma) + 1
        for side in (-1, 1):
            total, weight = np.zeros(n), np.full(n, 1e-9)
            for k in range(1, reach + 1):
                to = at + side * k
                ok = (to >= first) & (to <= last)
                w = np.exp(-0.5 * (k / sigma) ** 2) * ok
                total += w * ratio[np.clip(to, 0, max(0, n - 1))]
                weight += w
            columns.append(np.where(weight > 1e-6, total / weight, -3.0))
    columns += [np.minimum(at - first, 12), np.minimum(last - at, 12), np.log1p(last - first)]
    long = (size > 2.3) & (ratio > 0)
    seen = np.r_[0, np.cumsum(long)]
    columns += [np.minimum(seen[at] - seen[first], 2), np.minimum(seen[last + 1] - seen[at + 1], 2)]
    return np.stack(columns, 1)


def _page_arrays(model: LineModel, pages: list[list[str]]):
    """All non-blank lines of the pages, with each page's start and the features of lines in context."""
    lines = [x for p in pages for x in p]
    return _line_arrays(model.ratio(lines), lines, np.array([len(p) for p in pages]))


def _line_arrays(ratio: np.ndarray, lines: list[str], counts: np.ndarray) -> np.ndarray:
    """The features in context of pages' lines, of which the ratios are known; ``counts`` has the lines of each page."""
    starts = np.r_[0, counts.cumsum()[:-1]].astype(int)
    page = np.repeat(np.arange(len(counts)), counts)
    size = np.log1p(np.array([x.count(" ") + 1 if x.isascii() else max(x.count(" ") + 1, len(x) // 5) for x in lines], float))
    kind = np.array([2.0 if x.rstrip()[-1] in ".!?。？！:" else 1.0 if x.lstrip()[0] in "-*•·–" else 0.0 for x in lines])
    return context(ratio, size, starts, page, kind)


HIDDEN = 24
#: Context features of a line, and where in a row of all parameters the bias, the layers and the cut stand behind the buckets.
FEATURES = 28
SHAPES = ((FEATURES, HIDDEN), (HIDDEN,), (HIDDEN,), (1,))
LAYERS_AT = BUCKETS + 1
CUT_AT = LAYERS_AT + sum(math.prod(x) for x in SHAPES)
#: Parameters are added up as whole numbers of this part of one, so the order of the parts cannot matter.
UNIT = 1 << 24


def _lexical(lines: list[np.ndarray], y: np.ndarray, rng, epochs: int) -> tuple[np.ndarray, float]:
    """Logistic weights of the buckets and their bias, from lines' buckets and whether each is main content."""
    w, bias, rate = np.zeros(BUCKETS), 0.0, 0.5
    g2, touched = np.full(BUCKETS, 1e-2), np.zeros(BUCKETS, bool)
    for _ in range(epochs):
        for idx in np.array_split(rng.permutation(len(lines)), max(1, len(lines) // 64)):
            some = [lines[i] for i in idx]
            sizes = np.array([len(x) for x in some])
            flat = np.concatenate(some)
            norm = np.repeat(1 / np.sqrt(sizes), sizes)
            z = np.add.reduceat(w[flat], np.r_[0, sizes.cumsum()[:-1]]) / np.sqrt(sizes) + bias
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[idx]
            bias -= 0.02 * err.mean()
            touched[flat] = True
            hit = np.flatnonzero(touched)
            touched[hit] = False
            g = np.bincount(flat, weights=np.repeat(err, sizes) * norm, minlength=BUCKETS)[hit] + 1e-4 * w[hit]
            g2[hit] += g * g
            w[hit] -= rate * g / np.sqrt(g2[hit])
    return w, bias


def _layers(x: np.ndarray, y: np.ndarray, rng) -> list[np.ndarray]:
    """The layers for features as they are; every part starts from the same."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-3, scale, 1.0)
    z = (x - mean) / scale
    start = np.random.default_rng(0)
    ws = [start.normal(0, 0.3, SHAPES[0]), np.zeros(HIDDEN), start.normal(0, 0.3, HIDDEN), np.zeros(1)]
    ms, vs, step = [np.zeros_like(v) for v in ws], [np.zeros_like(v) for v in ws], 0
    for epoch in range(12):
        for idx in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
            h = np.tanh(z[idx] @ ws[0] + ws[1])
            err = (1 / (1 + np.exp(-np.clip(h @ ws[2] + ws[3], -30, 30))) - y[idx]) / len(idx)
            back = np.outer(err, ws[2]) * (1 - h * h)
            grads = [z[idx].T @ back + 1e-5 * ws[0], back.sum(0), h.T @ err, np.array([err.sum()])]
            step += 1
            for k, g in enumerate(grads):
                ms[k] = 0.9 * ms[k] + 0.1 * g
                vs[k] = 0.99 * vs[k] + 0.01 * g * g
                ws[k] -= 0.01 * 0.8**epoch * (ms[k] / (1 - 0.9**step)) / (np.sqrt(vs[k] / (1 - 0.99**step)) + 1e-8)
    first = ws[0] / scale[:, None]
    return [first, ws[1] - mean @ first, ws[2], ws[3]]


def fit_part(pages: list[tuple[list[str], list[bool]]], seed: int = 5, epochs: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Of one part of the pages each parameter times its weight, in UNIT, and its weight: the lines that tell of it.

    The context stage learns from ratios of lines that the first stage hasn't seen: each half's by the other half.
    """
    total, weight = np.zeros(CUT_AT + 1, np.int64), np.zeros(CUT_AT + 1, np.int64)
    pages = [(x, y) for x, y in pages if x]
    rng = np.random.default_rng(seed)
    half = rng.permutation(len(pages))
    known: dict[str, np.ndarray] = {}
    for x, _ in pages:
        for line in x:
            if line not in known:
                known[line] = np.array([_hash(f) for f in line_features(line)])
    parts = [[pages[i] for i in half[: len(half) // 2]], [pages[i] for i in half[len(half) // 2 :]]]
    feats = [[known[line] for x, _ in p for line in x] for p in parts]
    truth = [np.array([v for _, y in p for v in y], float) for p in parts]
    xs, ys = [], []
    for own, other in ((0, 1), (1, 0)):
        if not feats[own]:
            continue
        w, bias = _lexical(feats[own], truth[own], rng, epochs)
        n = np.bincount(np.concatenate(feats[own]), minlength=BUCKETS)
        n, w = np.r_[n, len(feats[own])], np.r_[w, bias]
        total[:LAYERS_AT] += np.rint(w * UNIT).astype(np.int64) * n
        weight[:LAYERS_AT] += n
        if feats[other]:
            sizes = np.array([len(f) for f in feats[other]])
            z = np.add.reduceat(w[np.concatenate(feats[other])], np.r_[0, sizes.cumsum()[:-1]]) / np.sqrt(sizes) + bias
            xs.append(_line_arrays(np.clip(z, -12, 12), [line for x, _ in parts[other] for line in x], np.array([len(x) for x, _ in parts[other]])))
            ys.append(truth[other])
    if xs:
        x = np.concatenate(xs)
        ws = _layers(x, np.concatenate(ys), rng)
        cut = threshold(np.clip(np.tanh(x @ ws[0] + ws[1]) @ ws[2] + ws[3][0], -4, 4))
        rest = np.concatenate([*(v.ravel() for v in ws), [min(max(cut, -0.5), 0.5)]])
        total[LAYERS_AT:], weight[LAYERS_AT:] = np.rint(rest * UNIT).astype(np.int64) * len(x), len(x)
    return total, weight


def _parts(border: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each parameter the sum over the parts in these batches, and the sum of its weights."""
    parts: dict[int, list] = {}
    for batch in batches:
        for part, *page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts.setdefault(part, []).append(page)
    if parts:
        sums = [fit_part([(lines, (sides(np.array(ratio), border) > 0).tolist()) for k, lines, ratio in sorted(parts.pop(p), key=_place)]) for p in sorted(parts)]
        total, weight = (sum(x) for x in zip(*sums, strict=True))
        at = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, total[at], weight[at])], names=["at", "total", "weight"])


def _place(page: list) -> tuple:
    """Pages of a part stand in this order, those without a key first."""
    k, lines, ratio = page
    return k is not None, k or 0, lines, ratio


def fit(pages: list[tuple[list[str], list[bool]]] | DataFrame, border: float = BORDER) -> LineModel:
    """Fits both stages on (lines, whether main content) of pages, or on a frame of :func:`training_pages`."""
    if isinstance(pages, DataFrame):
        n = max(1, -(-pages.count() // PART_PAGES))
        spread = pages.select(F.pmod(F.xxhash64("k"), F.lit(n)).alias("part"), "k", "lines", "ratio").repartition(n, "part")
        sums = spread.mapInArrow(partial(_parts, border), "at BIGINT, total BIGINT, weight BIGINT").groupBy("at").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).toArrow()
        pages.unpersist()
        total, weight = np.zeros(CUT_AT + 1, np.int64), np.zeros(CUT_AT + 1, np.int64)
        at = sums.column("at").to_numpy()
        total[at], weight[at] = sums.column("total").to_numpy(), sums.column("weight").to_numpy()
    else:
        total, weight = fit_part(pages)
    every = total / np.maximum(weight, 1) / UNIT
    layers = []
    if weight[CUT_AT]:
        ends = np.cumsum([math.prod(x) for x in SHAPES])
        layers = [x.reshape(s) for x, s in zip(np.split(every[LAYERS_AT:CUT_AT], ends[:-1]), SHAPES, strict=True)]
    return LineModel(every[:BUCKETS].astype(np.float32), float(every[BUCKETS]), np.zeros(1), np.ones(1), layers, float(every[CUT_AT]), border)


def _key(line: str) -> int:
    """A line without regard to its white space."""
    return xxhash.xxh32_intdigest("".join(line.split()))


def aligned(lines: list[str], keys: list[int], values: list[float]) -> np.ndarray:
    """The values of a page's lines for the lines of its payload, in order; NaN for lines that the page hasn't."""
    out, at = np.full(len(lines), np.nan), 0
    places: dict[int, list[int]] = {}
    for n, k in enumerate(keys):
        places.setdefault(k, []).append(n)
    for n, line in enumerate(lines):
        found = places.get(_key(line))
        if found:
            later = bisect_left(found, at)
            to = found[later] if later < len(found) else found[-1]
            out[n], at = values[to], max(at, to + 1)
    return out


def main_lines(model: LineModel, payloads: list[str | None], page_keys=None, page_sides=None) -> list[tuple[list[str], list[int]]]:
    """Per payload its lines and the numbers of the lines outside the main text.

    ``page_keys`` and ``page_sides``: per payload None, or what :func:`page_ratios` found on its page.
    """
    split = [(p or "").split("\n") for p in payloads]
    numbers = [[n for n, x in enumerate(ls) if x.strip()] for ls in split]
    pages = [[ls[n] for n in ns] for ls, ns in zip(split, numbers, strict=True)]
    if not any(pages):
        return [(ls, []) for ls in split]
    x = _page_arrays(model, pages)
    predicted = np.tanh((model.in_context(x) - model.cut) / 2) if model.layers else np.where(x[:, 1] < np.log1p(8), -1.0, 1.0)
    out, at = [], 0
    for n, (ls, ns) in enumerate(zip(split, numbers, strict=True)):
        z = predicted[at : at + len(ns)]
        if page_keys is not None and page_keys[n]:
            own = aligned(pages[n], page_keys[n], page_sides[n])
            z = np.where(np.isnan(own), z, np.where(np.abs(own) >= CLEAR, own, own + z))
        out.append((ls, [k for k, v in zip(ns, z.tolist(), strict=True) if v <= 0]))
        at += len(ns)
    return out


def training_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> tuple[DataFrame, float]:
    """``k, lines, ratio`` of all pages with HTML, kept until :func:`fit` has read them, and the border between the two
    clusters of all their ratios."""
    some = pages.where(F.col(html).isNotNull() & (F.length(F.trim(html)) > 0)).select(F.col(key).cast("bigint").alias("k"), F.col(html).alias("c0"))
    rows = map_rows(some, "k BIGINT, lines ARRAY<STRING>, ratio ARRAY<DOUBLE>", _html_rows).persist(StorageLevel.MEMORY_AND_DISK)
    return rows, _border(rows)


def _border(rows: DataFrame) -> float:
    """The border between two clusters of the ratios of all lines, by 2-means in Spark until it stays where it is."""
    v, n = F.col("v"), F.col("n")
    values = rows.select(F.explode("ratio").alias("v")).groupBy("v").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    low, high = values.agg(F.min(v), F.max(v)).first()
    if low is None or high - low < 1e-9:
        values.unpersist()
        return BORDER
    whole = F.round(v * UNIT).cast("bigint") * n
    while True:
        below = v <= (low + high) / 2
        sums = values.agg(*[F.sum(F.when(side, x)) for side in (below, ~below) for x in (whole, n)]).first()
        means = sums[0] / sums[1] / UNIT if sums[1] else low, sums[2] / sums[3] / UNIT if sums[3] else high
        if means == (low, high):
            values.unpersist()
            return (low + high) / 2
        low, high = means


def _html_rows():
    def work(keys, htmls):
        for k, h in zip(keys, htmls, strict=True):
            rows = html_lines(h) if h else []
            yield k, [r[0] for r in rows], tag_ratio(rows).tolist()

    return work


def html_content(pages: DataFrame, key: str = "page_id", html: str = "html", border: float = BORDER) -> DataFrame:
    """``key, main``: the main text of HTML pages, by their text-to-tag ratios alone."""

    def make():
        def work(keys, htmls):
            for k, h in zip(keys, htmls, strict=True):
                lines, main = html_main(h, border) if h else ([], [])
                yield k, None if h is None else "\n".join(x for x, m in zip(lines, main, strict=True) if m)

        return work

    return map_rows(pick(pages, key, html), f"`{key}` BIGINT, main STRING", make)


def page_ratios(pages: DataFrame, border: float = BORDER, key: str = "page_id", record: str = "record_id", html: str = "html") -> DataFrame:
    """``r, keys, sides``: for each record with a page its lines, hashed, and the side of the border each stands on."""

    def make():
        def work(records, htmls, pages_):
            for r, h, p in zip(records, htmls, pages_, strict=True):
                rows = html_lines(h)
                yield r, p, [_key(x[0]) for x in rows], sides(tag_ratio(rows), border).tolist()

        return work

    rows = map_rows(pick(pages, record, html, key).where("k is not null and c0 is not null"), "r BIGINT, page BIGINT, keys ARRAY<BIGINT>, sides ARRAY<FLOAT>", make)
    return rows.groupBy("r").agg(F.min(F.struct("page", "keys", "sides")).alias("one")).select("r", "one.keys", "one.sides")


def _with_pages(records: DataFrame, pages: DataFrame | None, model: LineModel, key: str, payload: str) -> DataFrame:
    """The records and, where there is one, what their page says; both sides are shuffled by the record's key."""
    base = pick(records, key, payload)
    if pages is None:
        return base.select("k", "c0", F.lit(None).cast("array<bigint>").alias("keys"), F.lit(None).cast("array<float>").alias("sides"))
    return base.join(page_ratios(pages, model.border), F.col("k") == F.col("r"), "left").select("k", "c0", "keys", "sides")


def _boiler(model: LineModel):
    def work(keys, payloads, page_keys, page_sides):
        for k, (_, bad) in zip(keys, main_lines(model, payloads, page_keys, page_sides), strict=True):
            if bad:
                yield k, bad

    return work


def boilerplate_lines(records: DataFrame, model: LineModel, key: str = "record_id", payload: str = "payload", pages: DataFrame | None = None) -> DataFrame:
    """``key, line_no``: the non-blank lines outside the main text, once each.

    A record delivered again with the same payload gives the same lines, so duplicates go before lines are unfolded.
    """
    found = map_rows(_with_pages(records, pages, model, key, payload), f"`{key}` BIGINT, lines ARRAY<INT>", partial(_boiler, model))
    return found.distinct().select(key, F.explode("lines").alias("line_no")).select(key, F.col("line_no").cast("bigint").alias("line_no"))


def _main(model: LineModel):
    def work(keys, payloads, page_keys, page_sides):
        for k, p, (lines, bad) in zip(keys, payloads, main_lines(model, payloads, page_keys, page_sides), strict=True):
            drop = set(bad)
            yield k, None if p is None else "\n".join(x for n, x in enumerate(lines) if n not in drop)

    return work


def main_text(records: DataFrame, model: LineModel, key: str = "record_id", payload: str = "payload", pages: DataFrame | None = None) -> DataFrame:
    """``key, main``: every record's payload without the lines outside its main text."""
    return map_rows(_with_pages(records, pages, model, key, payload), f"`{key}` BIGINT, main STRING", partial(_main, model))
