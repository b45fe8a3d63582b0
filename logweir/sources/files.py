"""Files of a shared file system as executors see them, by URI."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyarrow import fs

from ..functions.cache import OpenResources


_SYSTEMS = OpenResources(64, lambda root: fs.FileSystem.from_uri(root)[0])


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark names it (file:, hdfs:, s3:) or of a plain path."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    system = _SYSTEMS.get(f"{parts.scheme.replace('s3a', 's3')}://{parts.netloc}/")
    return system, f"{parts.netloc}{parts.path}" if parts.scheme in ("s3", "s3a") else parts.path


def open_input(uri: str):
    system, path = resolve(uri)
    return system.open_input_file(path)
