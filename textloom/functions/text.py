"""Words, lines, normal forms and n-grams as built-in column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace() has it, for a character class of Java's and RE2's regular expressions.
SPACE = r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Line ends as str.splitlines() has them.
LINE_END = r"\r\n|[\n\x{B}\x{C}\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: Column) -> Column:
    """The words between white space; none for a blank text."""
    return F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without their ends; the end of the last line opens no further one."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean(text: Column) -> Column:
    """One line for a classifier: line feeds become spaces, the ends are stripped."""
    return strip(F.translate(text, "\n", " "))


@lru_cache(maxsize=1)
def _unaccented() -> tuple[str, str]:
    """Characters whose canonical decomposition without non-spacing marks is one other character, and that character."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if unicodedata.category(ch) in ("Cs", "Mn") or 0xAC00 <= code <= 0xD7A3:
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if base != ch and len(base) == 1:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


def unaccented(text: Column) -> Column:
    """Accents removed: decomposed, and non-spacing marks dropped.  ASCII texts skip both steps."""
    source, target = _unaccented()
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.regexp_replace(F.translate(text, source, target), r"\p{Mn}", ""))


def normalized(text: Column) -> Column:
    """Without accents, in lower case, without ASCII punctuation, words separated by single spaces."""
    bare = F.translate(F.lower(unaccented(text)), PUNCTUATION, "")
    return strip(F.regexp_replace(bare, f"[{SPACE}]+", " "))


def word_ngrams(ws: Column, n: int) -> Column:
    """All runs of n words of an array, joined by spaces; empty below n words.

    The array is cut n times with one word's shift and zipped: inside a lambda over positions it would be evaluated anew
    for every position.
    """
    size = F.greatest(F.size(ws) - (n - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(ws, k + 1, size).alias(f"w{k}") for k in range(n)])
    return F.transform(shifted, lambda z: F.concat_ws(" ", *[z[f"w{k}"] for k in range(n)]))
