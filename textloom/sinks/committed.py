"""Writers that commit: every task writes under a temporary name, the driver moves what succeeded into place.

Files go to whatever file system their URI names; a failed or repeated task
leaves nothing behind.
"""

from __future__ import annotations

import gzip
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..sources import storage


@dataclass
class Written(WriterCommitMessage):
    """(temporary name, name, what the manifest says of it)"""

    files: list[tuple[str, str, dict]]


class FileWriter(DataSourceWriter):
    """Subclasses turn rows into pieces of named files."""

    suffix = ""
    manifest = False

    def __init__(self, options, schema, overwrite: bool):
        self.path, self.overwrite, self.names = options["path"], overwrite, schema.fieldNames()
        self.options, self.job = dict(options), uuid.uuid4().hex

    def pieces(self, rows: Iterator[Row], part: int) -> Iterator[tuple[str, bytes, dict]]:
        """(file name, bytes, additions to its entry in the manifest)"""
        raise NotImplementedError

    def _folder(self):
        system, root = storage.opened(self.path)
        return system, root, posixpath.join(root, f"_temporary-{self.job}")

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _, folder = self._folder()
        system.create_dir(folder, recursive=True)
        task = TaskContext.get()
        streams, said = {}, {}
        for name, data, entry in self.pieces(iterator, task.partitionId()):
            if name not in streams:
                at = posixpath.join(folder, f"{task.taskAttemptId()}-{len(streams)}")
                streams[name] = (at, system.open_output_stream(at, compression=None))
                said[name] = entry
            elif entry:
                said[name] = self.merged(said[name], entry)
            streams[name][1].write(data)
        for _, stream in streams.values():
            stream.close()
        return Written([(at, name, said[name]) for name, (at, _) in streams.items()])

    def merged(self, a: dict, b: dict) -> dict:
        return a

    def commit(self, messages) -> None:
        system, root, folder = self._folder()
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for e in system.get_file_info(fs.FileSelector(root)):
                if e.type == fs.FileType.File and (e.base_name.endswith(self.suffix) or e.base_name == "manifest.json"):
                    system.delete_file(e.path)
        done = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f[1])
        for at, name, _ in done:
            system.move(at, posixpath.join(root, name))
        if self.manifest:
            with system.open_output_stream(posixpath.join(root, "manifest.json"), compression=None) as out:
                out.write("".join(json.dumps({"part": name, **entry}) + "\n" for _, name, entry in done).encode())
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)

    def abort(self, messages) -> None:
        system, _, folder = self._folder()
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class TokenWriter(FileWriter):
    """``key, ids``: little-endian 16-bit ids, a file per partition and a manifest; an id outside 16 bits fails the job."""

    suffix, manifest = ".u16", True

    def pieces(self, rows, part):
        key = self.options.get("key", self.names[0])
        for row in rows:
            ids = np.asarray(row["ids"], np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() > 0xFFFF):
                raise ValueError(f"token id outside 16 bits in document {row[key]}")
            yield f"part-{part:06d}.u16", ids.astype("<u2").tobytes(), {"key_from": row[key], "key_to": row[key], "n_tokens": len(ids)}

    def merged(self, a, b):
        return {"key_from": a["key_from"], "key_to": b["key_to"], "n_tokens": a["n_tokens"] + b["n_tokens"]}


class TextWriter(FileWriter):
    """``file, text``: a text file for each ``file``, every document followed by ``sep``, a blank line unless it is given; rows of one file stand together."""

    suffix = ".txt"

    def pieces(self, rows, part):
        sep = self.options.get("sep", "\n\n")
        for row in rows:
            yield row["file"], (row["text"] + sep).encode("utf-8", "replace"), {}


class WarcWriter(FileWriter):
    """``target_uri, date, payload`` (and ``record_type``, ``file``): gzipped records, one member each, in a file per ``file`` or partition."""

    suffix = ".warc.wet.gz"

    def pieces(self, rows, part):
        for row in rows:
            has = lambda c: c in self.names and row[c] is not None
            body = bytes(row["payload"]) if has("payload") else b""
            head = [f"WARC-Type: {row['record_type'] if has('record_type') else 'conversion'}"]
            head += [f"WARC-Target-URI: {row['target_uri']}"] if has("target_uri") else []
            head += [f"WARC-Date: {row['date']:%Y-%m-%dT%H:%M:%SZ}"] if has("date") else []
            head += ["Content-Type: text/plain", f"Content-Length: {len(body)}"]
            record = "\r\n".join(["WARC/1.0", *(h.replace("\r", " ").replace("\n", " ") for h in head), "", ""]).encode() + body + b"\r\n\r\n"
            yield row["file"] if has("file") else f"part-{part:06d}{self.suffix}", gzip.compress(record, mtime=0), {}


class _Sink(DataSource):
    made: type[FileWriter]

    def schema(self):
        return "file STRING"

    def writer(self, schema, overwrite):
        return self.made(self.options, schema, overwrite)


class TokenSink(_Sink):
    made = TokenWriter

    @classmethod
    def name(cls):
        return "tokens16"


class TextSink(_Sink):
    made = TextWriter

    @classmethod
    def name(cls):
        return "texts"


def register(spark) -> None:
    for sink in (TokenSink, TextSink):
        spark.dataSource.register(sink)
