"""Text of HTML pages: a chain of built-in replacements, and a parser in Arrow batches."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Replacements in order, for Java's and RE2's regular expressions alike.
CHAIN = (
    (r"(?is)<(script|style|noscript|template|head)[^>]*>.*?</(script|style|noscript|template|head)>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)<li[^>]*>", "\n  • "),
    (r"(?i)<br[^>]*>|</(p|div|h[1-6]|li|tr|nav|aside|footer|header|section|article|ul|ol|table|title)>", "\n"),
    (r"(?s)<[^>]*>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;|&apos;", "'"),
    (r"&amp;", "&"),
    (r"[ \t\r]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"^[ \n]+|[ \n]+$", ""),
)


def html_to_text_sql(html: Column) -> Column:
    """Visible text by replacements alone, inside the JVM."""
    for pattern, by in CHAIN:
        html = F.regexp_replace(html, pattern, by)
    return html


_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_HIDDEN = frozenset("script style noscript template head".split())


class _Text(HTMLParser):
    """Blocks of visible text; list items get a bullet."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.parts: list[str] = []
        self.hidden = 0
        self.item = False

    def _close(self):
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if text:
            self.blocks.append(f"  • {text}" if self.item else text)
            self.item = False
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BLOCK:
            self._close()
            self.item = tag == "li"

    def handle_endtag(self, tag):
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in _BLOCK:
            self._close()
            self.item = False

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def extract(html: str) -> str:
    """Blocks of visible text, a blank line between them; items of one list follow each other."""
    p = _Text()
    p.feed(html)
    p.close()
    p._close()
    out: list[str] = []
    for n, b in enumerate(p.blocks):
        if n:
            out.append("\n" if b.startswith("  • ") and p.blocks[n - 1].startswith("  • ") else "\n\n")
        out.append(b)
    return "".join(out)


def decode(raw: bytes | None) -> str | None:
    """UTF-8, else by byte order mark or declared charset, else Windows-1252; None where nothing fits."""
    if raw is None:
        return None
    for mark, enc in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            try:
                return raw.decode(enc)
            except UnicodeDecodeError:
                break
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    declared = re.search(rb"charset=[\"']?([A-Za-z0-9_\-]+)", raw[:2048])
    for enc in ([declared.group(1).decode("ascii")] if declared else []) + ["cp1252"]:
        try:
            return raw.decode(enc)
        except (LookupError, UnicodeDecodeError):
            continue
    return None


@F.pandas_udf(StringType())
def html_to_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of HTML given as string or bytes; null stays null, undecodable bytes become null."""
    for batch in pages:
        texts = [decode(bytes(x)) if isinstance(x, (bytes, bytearray, memoryview)) else x for x in batch]
        yield pd.Series([None if t is None else extract(t) for t in texts], dtype=object)
