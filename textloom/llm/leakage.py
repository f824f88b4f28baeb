"""Problem 7: evaluation texts inside training texts.

A generalised suffix automaton of the normalised evaluation items is built once
(the items are a fixed, bounded table) and every document is streamed through
it, token by token.  The state reached gives the longest run of item words that
ends at the token; where that run has at least ``least`` words, the ancestor
that stands for its last ``least`` words tells the item, unless several items
share them.

Normalisation ignores letter case, punctuation, spacing, line breaks and
invisible characters; apostrophes vanish, other marks separate words.  A stock
instruction, words that at least ``STOCK_ITEMS`` items share at their beginning
or end, is cut off the items first.

Defined results: null, blank and short texts and items give no rows; copies of
a document give their own rows; equal items share all their words and so give
none, but an item delivered again is one item.  Other columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_rows, pick

LEAST = 8
STOCK_ITEMS = 3
STOCK_WORDS = 5
#: Words in one automaton; more items than that go to further automata of the same pass.
BLOCK_WORDS = 500_000

#: Apostrophes and invisible characters.
_DROP = re.compile("['\u2018\u2019\u02bc`\u00b4\uff07\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(_DROP.sub("", text).lower())


def own_words(items: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """The words of each item outside its stock instruction.

    A prefix shared by several items is stock as far as a sentence end; a shared suffix from its first capital on, as an
    item may break off before its instruction without a mark.
    """
    raw = [(key, [m.group() for m in _WORD.finditer(_DROP.sub("", text))], _sentence_ends(text)) for key, text in items]
    low = [[w.lower() for w in ws] for _, ws, _ in raw]
    heads, tails = _Shared(), _Shared()
    starts = [heads.add(key, ws) for (key, _, _), ws in zip(raw, low, strict=True)]
    stops = [tails.add(key, ws[::-1]) for (key, _, _), ws in zip(raw, low, strict=True)]
    out = []
    for (key, ws, ends), lw, first, last in zip(raw, low, starts, stops, strict=True):
        start, end = 0, len(ws)
        for n in range(len(lw) - 1, STOCK_WORDS - 1, -1):
            if n in ends and heads.count[first[n - 1]] >= STOCK_ITEMS:
                start = n
                break
        for n in range(len(lw) - start, STOCK_WORDS - 1, -1):
            if tails.count[last[n - 1]] >= STOCK_ITEMS:
                at = next((k for k in range(len(ws) - n, len(ws)) if ws[k][0].isupper()), None)
                if at is not None and len(ws) - at >= STOCK_WORDS:
                    end = at
                break
        out.append((key, lw[start:end]))
    return out


class _Shared:
    """A prefix tree: for each prefix of the sequences how many items begin with it, however often one is delivered."""

    def __init__(self):
        self.to: dict[tuple[int, str], int] = {}
        self.count: Counter = Counter()
        self.seen: set[tuple[int, int]] = set()

    def add(self, key: int, words_: list[str]) -> list[int]:
        at, path = 0, []
        for w in words_:
            at = self.to.setdefault((at, w), len(self.to) + 1)
            if (at, key) not in self.seen:
                self.seen.add((at, key))
                self.count[at] += 1
            path.append(at)
        return path


def _sentence_ends(text: str) -> set[int]:
    """Numbers of words after which a sentence ends; figures as 3.5 or 12:30 and initials as U.S. don't end one."""
    clean, out, n, last, before, initials = _DROP.sub("", text), set(), 0, 0, "", False
    for m in _WORD.finditer(clean):
        gap, word = clean[last : m.start()], m.group()
        joined = gap in (".", ":") and (before[-1:].isdigit() and word[0].isdigit() or gap == "." and len(before) == 1 and len(word) == 1)
        if n and not joined and not (initials and gap == ". ") and re.search(r"[.!?:;。？！\n]", gap):
            out.add(n)
        initials = joined and not word[0].isdigit()
        n, last, before = n + 1, m.end(), word
    return out


class Automaton:
    """Suffix automaton over the words of many items, with suffix links."""

    def __init__(self, items: list[list[int]], least: int, shared: dict[tuple, int | None]):
        self.least = least
        nxt: list[dict[int, int]] = [{}]
        link, length, first = [-1], [0], [(0, 0)]
        for which, seq in enumerate(items):
            last = 0
            for at, w in enumerate(seq):
                last = self._extend(nxt, link, length, first, last, w, (which, at))
        self.next, self.link, self.length = nxt, link, length
        #: For each state whose run has `least` words: the item that alone holds the run's last `least` words, or -1.
        self.item = [-1] * len(nxt)
        for s in range(1, len(nxt)):
            if length[s] >= least:
                which, at = first[s]
                found = shared.get(tuple(items[which][at + 1 - least : at + 1]))
                self.item[s] = -1 if found is None else found

    @staticmethod
    def _extend(nxt, link, length, first, last, w, where) -> int:
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            c = Automaton._clone(nxt, link, length, first, q, length[last] + 1)
            p = last
            while p != -1 and nxt[p].get(w) == q:
                nxt[p][w] = c
                p = link[p]
            link[q] = c
            return c
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(where)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                c = Automaton._clone(nxt, link, length, first, q, length[p] + 1)
                while p != -1 and nxt[p].get(w) == q:
                    nxt[p][w] = c
                    p = link[p]
                link[q] = link[cur] = c
        return cur

    @staticmethod
    def _clone(nxt, link, length, first, q, size) -> int:
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(size)
        first.append(first[q])
        return c

    def spans(self, ids: list[int | None]):
        """(item, first word, words): runs of the text that match, each as long as it goes."""
        nxt, link, length, item, least = self.next, self.link, self.length, self.item, self.least
        state = size = 0
        open_item, open_start, open_end = -1, 0, 0
        for at, w in enumerate(ids):
            if w is None:
                state = size = 0
                continue
            while state and w not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(w)
            if to is None:
                continue
            state, size = to, size + 1
            if size >= least:
                s = state
                while length[link[s]] >= least:
                    s = link[s]
                i = item[s]
                if i >= 0:
                    start = at + 1 - size
                    if i == open_item and start <= open_end:
                        open_start, open_end = min(open_start, start), at + 1
                    else:
                        if open_item >= 0:
                            yield open_item, open_start, open_end - open_start
                        open_item, open_start, open_end = i, start, at + 1
        if open_item >= 0:
            yield open_item, open_start, open_end - open_start


def _build(items: list[tuple[int, str]], least: int):
    own = own_words(items)
    vocab: dict[str, int] = {}
    coded = [(key, [vocab.setdefault(w, len(vocab)) for w in ws]) for key, ws in own]
    shared: dict[tuple, int | None] = {}
    for n, (_, seq) in enumerate(coded):
        for k in {tuple(seq[a : a + least]) for a in range(len(seq) - least + 1)}:
            other = shared.setdefault(k, n)
            if other is not None and coded[other][0] != coded[n][0]:
                shared[k] = None
    blocks, block, size = [], [], 0
    for _, seq in coded:
        block.append(seq)
        size += len(seq)
        if size >= BLOCK_WORDS:
            blocks.append(block)
            block, size = [], 0
    blocks.append(block)
    return vocab, [Automaton(b, least, shared) for b in blocks], [k for k, _ in coded], [len(s) for _, s in coded]


def leaks(documents: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """``item_id, doc_id, start_word, n_words, coverage``: every run of at least ``least`` item words in a document.

    ``coverage`` is the share of the item's own words in the run.  The benchmark is read to the driver: it is the
    bounded set of held-out items, and its automaton is what every task needs.
    """
    items = [(r[0], r[1]) for r in benchmark.select(F.col(item).cast("bigint"), F.col(item_text)).where(F.col(item_text).isNotNull() & F.col(item).isNotNull()).distinct().orderBy(item, item_text).collect()]
    built = _build(items, least)
    shared = documents.sparkSession.sparkContext.broadcast(built)

    def make():
        vocab, automata, keys, sizes = shared.value
        get = vocab.get

        def work(docs, texts):
            for d, t in zip(docs, texts, strict=True):
                if not t:
                    continue
                ids = [get(w) for w in words(t)]
                if len(ids) < least:
                    continue
                for a in automata:
                    for i, start, n in a.spans(ids):
                        yield keys[i], d, start, n, min(1.0, n / max(1, sizes[i]))

        return work

    return map_rows(pick(documents, doc, text), f"`{item}` BIGINT, `{doc}` BIGINT, start_word INT, n_words INT, coverage DOUBLE", make)


def leaked_pairs(documents: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """``item_id, doc_id``, once each."""
    found = leaks(documents, benchmark, **names)
    return found.select(*found.columns[:2]).distinct()


def decontaminated(documents: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", longest: int = 13, coverage: float = 0.5, least: int = LEAST, **names) -> DataFrame:
    """``doc_id, clean``: each text without the leaked runs of more than ``longest`` words or ``coverage`` of an item.

    Rows are joined back by key; a text without such runs stays as it is, a null text stays null.
    """
    found = leaks(documents, benchmark, doc=doc, text=text, least=least, **names)
    cut = found.where((F.col("n_words") > longest) | (F.col("coverage") >= coverage)).groupBy(doc).agg(F.sort_array(F.collect_set(F.struct("start_word", "n_words"))).alias("runs"))
    base = pick(documents, doc, text).join(cut.withColumnRenamed(doc, "kk"), F.col("k") == F.col("kk"), "left").select("k", "c0", "runs")

    def make():
        def work(docs, texts, runs):
            for d, t, rs in zip(docs, texts, runs, strict=True):
                yield d, t if not rs or t is None else _without(t, rs)

        return work

    return map_rows(base, f"`{doc}` BIGINT, clean STRING", make)


def _without(text: str, runs: list[dict]) -> str:
    """The text without the given runs of words; positions are those of :func:`words`."""
    keep = [n for n, ch in enumerate(text) if not _DROP.match(ch)]
    clean = "".join(text[n] for n in keep)
    at = [(m.start(), m.end()) for m in _WORD.finditer(clean)]
    out, last = [], 0
    for r in runs:
        a, b = keep[at[r["start_word"]][0]], keep[at[r["start_word"] + r["n_words"] - 1][1] - 1] + 1
        if b > last:
            out.append(text[last : max(a, last)])
            last = b
    return "".join((*out, text[last:]))
