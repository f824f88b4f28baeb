"""A Python data source for web archive files (WARC, WET), plain or gzipped: ``spark.read.format("warc")``.

What can't be read becomes a record of type ``broken`` with the reason in
``error``, and the rest of the data goes on: a record with a bad length is
skipped as far as the next one, a file that breaks off keeps what came before.
"""

from __future__ import annotations

import gzip
import io
import zlib
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ..functions.http import response_text
from . import storage

SCHEMA = "file STRING, record_type STRING, target_uri STRING, date TIMESTAMP, content_type STRING, headers MAP<STRING, STRING>, payload BINARY, error STRING"


def _broken(error: str, uri: str | None = None, payload: bytes | None = None) -> tuple:
    return "broken", uri, None, None, {}, payload, error


def records(stream, wanted: str | None = None) -> Iterator[tuple]:
    """Record by record; payloads of other types than ``wanted`` are skipped."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        for line in iter(stream.readline, b""):
            line = line.rstrip(b"\r\n")
            if not line:
                break
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        low = {k.lower(): v for k, v in headers.items()}
        uri, kind = low.get("warc-target-uri"), low.get("warc-type", "")
        try:
            size = int(low["content-length"])
        except (KeyError, ValueError):
            yield _broken("no content length", uri)
            continue
        payload = stream.read(size) if size > 0 else b""
        if len(payload) < size:
            yield _broken(f"cut off at {len(payload)} of {size} bytes", uri, payload)
            return
        if wanted is None or kind == wanted:
            try:
                date = datetime.fromisoformat(low["warc-date"].replace("Z", "+00:00")).replace(tzinfo=None)
            except (KeyError, ValueError):
                date = None
            yield kind, uri, date, low.get("content-type"), headers, payload, None


def file_records(path: str, wanted: str | None = None) -> Iterator[tuple]:
    """The records of one file, with its path."""
    system, inner = storage.opened(path)
    try:
        with system.open_input_file(inner) as f:
            zipped = f.read(2) == b"\x1f\x8b"
            f.seek(0)
            stream = io.BufferedReader(gzip.GzipFile(fileobj=f)) if zipped else io.BufferedReader(f)
            for row in records(stream, wanted):
                yield (path, *row)
    except (EOFError, OSError, zlib.error) as e:
        yield (path, *_broken(f"{type(e).__name__}: {e}"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options, self.wanted = options, options.get("record_type")

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("record_type",) and self.wanted in (None, f.value):
                self.wanted = f.value
            yield f  # broken records come whatever is wanted

    def partitions(self):
        return [_File(p) for p in storage.found(self.options["path"])] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.path:
            yield from file_records(partition.path, self.wanted)


class WarcSource(DataSource):
    """One partition per file, in the order of the paths, as gzip can't be split; an equality on ``record_type`` is pushed into the reader."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        from ..sinks.committed import WarcWriter

        return WarcWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def conversions(archive: DataFrame) -> DataFrame:
    """The text records of an archive with ``text``, malformed bytes replaced."""
    return archive.where(F.col("record_type") == "conversion").withColumn("text", F.make_valid_utf8(F.col("payload").cast("string"))).drop("payload")


def response_texts(archive: DataFrame, least: int = 100, limit: int | None = None) -> DataFrame:
    """``file, target_uri, date, text``: the texts of HTML responses, and of text records, of at least ``least`` characters; at most ``limit`` of them."""
    kinds = archive.where(F.col("record_type").isin("response", "conversion"))
    text = F.when(F.col("record_type") == "response", response_text("payload")).otherwise(F.make_valid_utf8(F.col("payload").cast("string")))
    rows = kinds.select("file", "target_uri", "date", text.alias("text")).where(F.char_length("text") >= least)
    return rows if limit is None else rows.limit(limit)
