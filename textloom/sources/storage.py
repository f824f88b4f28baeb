"""Files by URI on any file system that pyarrow opens (local, hdfs, s3, gcs): listed sorted, opened as streams."""

from __future__ import annotations

import fnmatch
import os
import posixpath

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme it is local."""
    if "://" in path or path.startswith("file:/"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def found(paths: str) -> list[str]:
    """The files of comma-separated paths, folders and patterns, sorted, each as it can be opened again; hidden ones left out."""
    out: set[str] = set()
    for path in filter(None, (p.strip() for p in paths.split(","))):
        system, inner = opened(path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        wild = next((n for n, ch in enumerate(inner) if ch in "*?["), None)
        if wild is not None:
            base = posixpath.dirname(inner[:wild])
            entries = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
            names = [e.path for e in entries if e.type == fs.FileType.File and _matches(e.path, inner)]
        else:
            info = system.get_file_info(inner)
            if info.type == fs.FileType.Directory:
                names = [e.path for e in system.get_file_info(fs.FileSelector(inner)) if e.type == fs.FileType.File and not e.base_name.startswith((".", "_"))]
            else:
                names = [inner] if info.type == fs.FileType.File else []
        out.update(prefix + n for n in names)
    return sorted(out)


def _matches(path: str, pattern: str) -> bool:
    a, b = path.split("/"), pattern.split("/")
    return len(a) == len(b) and all(map(fnmatch.fnmatchcase, a, b))
