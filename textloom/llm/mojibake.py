"""Problem 2: text that was decoded with the wrong character encoding.

Round-trip repair.  A line is re-encoded under each candidate legacy encoding
and strictly decoded as the encoding it may have been written in; the attempt
is repeated on its result for nested layers.  A candidate is accepted when the
garbling cost drops by a margin.  The cost of a line adds up, per character,
what clean text of the sample languages does not contain: control and
replacement characters, symbols inside words, mixed scripts in a word, odd
case changes and letter pairs that are rare in the samples.

Defined results: a null or blank payload has no garbled lines and stays as it
is; a line with U+FFFD counts as garbled but not restorable; rows delivered
twice give one row per key in :func:`garbled_records`; other columns of the
input are ignored whatever their names.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (encoding the text was read with, encoding it was written in)
PAIRS = (
    ("cp1252x", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("mac_roman", "utf-8"), ("cp1251x", "utf-8"),
    ("cp1250x", "utf-8"), ("cp1254x", "utf-8"), ("koi8-r", "utf-8"), ("cp866", "utf-8"), ("iso8859-15", "utf-8"),
    ("gbk", "utf-8"), ("shift_jis", "utf-8"), ("big5", "utf-8"), ("euc_kr", "utf-8"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"),
    ("cp1251x", "cp1252"), ("cp1250x", "cp1252"), ("koi8-r", "cp1252"), ("gbk", "cp1252"),
    ("cp1251x", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252x", "cp1251"), ("cp1252x", "koi8-r"), ("cp1251x", "cp866"),
    ("cp866", "cp1251"), ("cp866", "koi8-r"), ("cp1252x", "cp866"), ("mac_cyrillic", "cp1251"), ("mac_roman", "cp1251"),
    ("cp437", "cp1251"), ("cp1252x", "gbk"), ("gbk", "cp1251"), ("cp1252x", "mac_roman"),
    ("cp1252x", "cp437"), ("cp1252x", "cp850"),
)
LAYERS = 3

_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")


def _encoder(enc: str):
    """Strict; where bytes of a Windows code page are undefined, the C1 control of that number stands for them."""
    if not enc.endswith("x"):
        return lambda text: text.encode(enc)
    table = {}
    for byte in range(256):
        try:
            table[ord(bytes([byte]).decode(enc[:-1]))] = byte
        except UnicodeDecodeError:
            table[byte] = byte
    if enc == "cp1252x":  # covers Latin-1, whose C1 controls are plain characters of that number
        table.update({byte: byte for byte in range(0x80, 0xA0)})
    return lambda text: codecs.charmap_encode(text, "strict", table)[0]


ENCODERS = {enc: _encoder(enc) for enc in dict.fromkeys(p[0] for p in PAIRS)}


def _to_bytes(text: str, enc: str) -> bytes:
    return ENCODERS[enc](text)


def _kind(ch: str) -> str:
    """Script class of one character."""
    o = ord(ch)
    if o < 0x80:
        return "l" if ch.isalpha() else "d" if ch.isdigit() else "s" if ch.isspace() else "p"
    if _LATIN.match(ch) or ch in "ªº":
        return "l"
    if 0x400 <= o <= 0x52F:
        return "c"
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF:
        return "z"
    if 0x80 <= o <= 0x9F or o == 0xFFFD or 0xE000 <= o <= 0xF8FF:
        return "!"
    if 0x3000 <= o <= 0x303F or 0xFF00 <= o <= 0xFFEF:
        return "w"
    if ch in "‘’“”–—…¡¿":
        return "p"
    if ch.isalpha():
        return "o"
    return "y"


class CostModel:
    """Garbling cost from clean sample sentences: known characters and the letter pairs within words.

    White space separates words, so the cost of a line is the sum over its words; words are remembered.
    """

    #: Punctuation and currency that clean pages use besides what the samples show.
    PLAIN = frozenset("‘’“”„‚«»‹›–—…·•°©®™€£§¿¡×→←↑↓☰½¼¾№、。，！？：；（）《》「」")
    REMEMBERED = 200_000

    def __init__(self, samples: list[str]):
        self.chars = set(self.PLAIN) | set("àâäæçèéêëîïôöœùûüÿñßáíóúìòõãåøý")
        self.pairs: set[str] = set()
        for s in samples:
            low = s.lower()
            self.chars |= set(s) | set(low) | set(s.upper())
            self.pairs |= {a + b for a, b in zip(low, low[1:], strict=False) if ord(a) > 127 or ord(b) > 127}
        self.kinds: dict[str, str] = {}
        self.words: dict[str, float] = {}

    def __call__(self, text: str) -> float:
        words, total = self.words, 0.0
        for w in _WORD.findall(text):
            c = words.get(w)
            if c is None:
                if len(words) > self.REMEMBERED:
                    words.clear()
                c = words[w] = self.word(w)
            total += c
        return total

    def word(self, word: str) -> float:
        kinds, chars, pairs = self.kinds, self.chars, self.pairs
        cost, pk, pc = 1.5 * len(_LONE_HAN.findall(word)), "s", " "
        for ch in word:
            k = kinds.get(ch)
            if k is None:
                k = kinds[ch] = _kind(ch)
            if ch > "\x7f":
                if k == "!":
                    cost += 3.0
                elif k == "z":
                    cost += 0.0 if ch in chars or _common_han(ch) else 1.0
                elif ch not in chars:
                    cost += 1.5
                elif k == "y" and ch not in self.PLAIN:
                    cost += 0.5
            if ch > "\x7f" or pc > "\x7f":
                if k != pk and k in "lczoy" and pk in "lczoy":
                    if k == "z" or pk == "z":  # names stand in Chinese text without spaces, but only plain ones
                        cost += 0.0 if ch < "\x80" or pc < "\x80" else 1.0
                    else:
                        cost += 1.0 if (k == "y" or pk == "y") else 1.5  # symbol or other script in a word
                elif k == pk and k in "lc":
                    if ch.isupper() and pc.islower():
                        cost += 1.5
                    if (pc + ch).lower() not in pairs:
                        cost += 0.6 if k == "c" else 0.15
                elif k == pk == "y":
                    cost += 0.3
            pk, pc = k, ch
        return cost


def _common_han(ch: str) -> bool:
    """Whether a character is of the common level of the national standard's two levels."""
    try:
        return ch.encode("gb2312")[0] <= 0xD7
    except UnicodeEncodeError:
        return False


def _attempt(text: str, wrong: str, right: str) -> str | None:
    try:
        out = _to_bytes(text, wrong).decode(right)
    except (UnicodeError, ValueError):
        return _by_runs(text, wrong) if right == "utf-8" else None
    if right == "gbk":
        han = [_common_han(ch) for ch in out if _kind(ch) == "z"]
        if sum(han) < 0.8 * len(han):
            return None
    return out


#: Encodings whose wrong text is also restored in parts.
_PARTS = frozenset({"cp1252x", "cp437", "cp850", "mac_roman", "cp1251x", "cp1250x"})


def _fits(wide: str) -> set[str]:
    """The encodings that have all of these characters."""
    out = set()
    for enc, encode in ENCODERS.items():
        try:
            encode(wide)
            out.add(enc)
        except UnicodeError:
            pass
    return out


def _doubtful(line: str, c: float) -> bool:
    """Whether the cost per character outside ASCII is more than rare letter pairs of clean text bring."""
    return c >= 0.9 and c >= 0.11 * len(_WIDE.findall(line))


def repair_line(line: str, cost: CostModel, pairs=PAIRS, layers: int = LAYERS, first: tuple = ()) -> tuple[str, tuple]:
    """The repaired text and the encoding pairs undone, outermost first; () when no candidate lowers the cost enough.

    ``first`` holds pairs already found in the same record: they win ties and need a smaller gain.
    """
    best, best_cost, chain = line, cost(line), ()
    for _ in range(layers):
        if best_cost < (0.35 if first else 0.9):
            break
        found, found_cost, pair = None, 1e9, None
        fits = _fits("".join(set(_WIDE.findall(best))))
        for at, (wrong, right) in enumerate((*first, *pairs)):
            if wrong not in fits and (right != "utf-8" or wrong not in _PARTS):
                continue
            cand = _attempt(best, wrong, right)
            if cand is None or cand == best:
                continue
            c = cost(cand)
            if c <= best_cost - (0.35 if at < len(first) else 0.85 + 0.15 * best_cost) and c < found_cost:
                found, found_cost, pair = cand, c, (wrong, right)
                if c < 0.3:
                    break
        if found is None:
            break
        best, best_cost, chain = found, found_cost, (*chain, pair)
    return best, chain


def _lossy(line: str) -> bool:
    """Characters that only a wrong decoding leaves: replacement characters and C1 controls."""
    return bool(_LOST.search(line))


def repair_payload(payload: str, cost: CostModel) -> tuple[str, list[int]]:
    """The payload with garbled lines restored as far as they can be, and the 0-based numbers of garbled lines."""
    if payload.isascii():
        return payload, []
    lines = payload.split("\n")
    seen: Counter = Counter()
    out, bad = list(lines), set()
    costs = [0.0 if x.isascii() else cost(x) for x in lines]
    for strong in (True, False):  # lines with much evidence first; their encodings then settle the short ones
        first = tuple(p for p, _ in seen.most_common(2))
        for n, c in enumerate(costs):
            if (c >= 3.0) != strong or c < 0.35 or not (first or _doubtful(lines[n], c)):
                continue
            fixed, chain = repair_line(lines[n], cost, first=first)
            if chain:
                out[n] = fixed
                bad.add(n)
                if strong:
                    seen.update(dict.fromkeys(chain, 1))
    bad.update(n for n, x in enumerate(lines) if not x.isascii() and _lossy(x))
    return "\n".join(out), sorted(bad)


_WORD = re.compile(r"[\x21-\x7f]*[^\x00-\x7f]\S*")
#: One or two Chinese characters inside or behind a lower-case Latin word; names in Chinese text begin with a capital.
_LONE_HAN = re.compile("(?:(?<=[a-zà-ÿ])|(?<![\u3400-\u9fff]))[\u3400-\u9fff]{1,2}(?=[a-zà-ÿ])|(?<=[a-zà-ÿ])[\u3400-\u9fff]{1,2}(?![\u3000-\u9fff\uff00-\uffefA-Z])")
_LOST = re.compile("[\x80-\x84\x86-\x9f\ufffd]")
_RUN = re.compile("[^\x00-\x7f]{2,}")
_WIDE = re.compile("[^\x00-\x7f]")
_ESCAPED = re.compile("[\udc80-\udcff]")


def _by_runs(line: str, wrong: str) -> str | None:
    """Restores the parts that decode strictly as UTF-8 where the line as a whole does not; the rest stays as it stands."""
    if wrong not in _PARTS:
        return None
    hit = False

    def one(m: re.Match) -> str:
        nonlocal hit
        try:
            raw = _to_bytes(m.group(), wrong)
        except (UnicodeError, ValueError):
            return m.group()
        out = raw.decode("utf-8", "surrogateescape")
        lost = _ESCAPED.findall(out)
        if len(lost) * 2 > len(raw):
            return m.group()
        hit = True
        return _ESCAPED.sub(lambda x: bytes([ord(x.group()) - 0xDC00]).decode("cp1252" if wrong.endswith("x") else wrong, "replace"), out) if lost else out

    out = _RUN.sub(one, line)
    return out if hit else None


SCHEMA = pa.schema([("key", pa.int64()), ("garbled", pa.list_(pa.int32())), ("restored", pa.string())])


def _worker(samples: list[str], restored: bool, only_found: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = CostModel(samples)
        for batch in batches:
            keys, lines, texts = [], [], []
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text, bad = (payload, []) if payload is None else repair_payload(payload, cost)
                if bad or not only_found:
                    keys.append(key)
                    lines.append(bad)
                    texts.append(text if restored else None)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lines, pa.list_(pa.int32())), pa.array(texts, pa.string())], schema=SCHEMA)

    return run


def sample_texts(samples: DataFrame, text: str = "text") -> list[str]:
    """Clean sentences of a fixed table on the driver, in the order of their text."""
    return [r[0] for r in samples.select(F.col(text)).where(F.col(text).isNotNull()).distinct().orderBy(text).collect()]


def repair(records: DataFrame, samples: DataFrame, key: str = "record_id", payload: str = "payload", only_garbled: bool = False) -> DataFrame:
    """``key, garbled ARRAY<INT>, restored STRING``: garbled line numbers and the payload restored.

    For every row, or only for those with garbled lines; then payloads of ASCII alone stay in the JVM and no other
    payload comes back from Python.
    """
    schema = f"`{key}` BIGINT, garbled ARRAY<INT>, restored STRING"
    rows = records.select(F.col(key).cast("bigint").alias(key), F.col(payload).alias("payload"))
    if only_garbled:
        rows = rows.where(F.octet_length("payload") > F.char_length("payload"))
    return rows.mapInArrow(_renamed(_worker(sample_texts(samples), True, only_garbled), key), schema)


def garbled_records(records: DataFrame, samples: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """The keys with at least one garbled line, once each.  All-ASCII payloads cannot be garbled and stay in the JVM."""
    wide = records.select(F.col(key).cast("bigint").alias(key), F.col(payload).alias("payload")).where(F.octet_length("payload") > F.char_length("payload"))
    schema = f"`{key}` BIGINT, garbled ARRAY<INT>, restored STRING"
    return wide.mapInArrow(_renamed(_worker(sample_texts(samples), False, True), key), schema).select(key).distinct()


def _renamed(run, key: str):
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield b.rename_columns([key, "garbled", "restored"])

    return out
