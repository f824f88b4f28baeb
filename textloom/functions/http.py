"""HTTP responses as archives keep them: head, transfer and content encodings, HTML body to text."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .html import decode, extract


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, names in lower case, and the body with chunks joined and compression undone; what can't be undone stays."""
    cut = min((n for n in (raw.find(b"\r\n\r\n"), raw.find(b"\n\n")) if n >= 0), default=-1)
    if not raw.startswith(b"HTTP/") or cut < 0:
        return {}, raw
    head, body = raw[:cut], raw[cut + (4 if raw[cut : cut + 4] == b"\r\n\r\n" else 2) :]
    headers = {}
    for line in head.splitlines()[1:]:
        name, _, value = line.decode("latin-1").partition(":")
        headers[name.strip().lower()] = value.strip()
    if "chunked" in headers.get("transfer-encoding", "").lower():
        body = _joined(body)
    kind = headers.get("content-encoding", "").lower()
    try:
        if "gzip" in kind:
            body = gzip.decompress(body)
        elif "deflate" in kind:
            body = zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return headers, body


def _joined(body: bytes) -> bytes:
    """The chunks of a body; as it stands where it has none, as archives often join them."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return b"".join(out) if out else body
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def html_text(raw: bytes | None) -> str | None:
    """The text of a response whose content type names HTML; None for others."""
    if raw is None:
        return None
    headers, body = parsed(bytes(raw))
    if "html" not in headers.get("content-type", "").lower():
        return None
    page = decode(body)
    return None if page is None else extract(page)


@F.pandas_udf(StringType())
def response_text(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of the HTML in HTTP responses; null where there is none."""
    for batch in payloads:
        yield pd.Series([html_text(x) for x in batch], dtype=object)
