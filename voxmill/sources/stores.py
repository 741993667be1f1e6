"""The file systems of stores, by URI, for what Python workers read and write themselves."""

from __future__ import annotations

import importlib
import re

from pyarrow import fs


def store_of(uri: str, resolver: str = "") -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it. Local paths, file:, hdfs:, viewfs:, s3:, gs: and abfs: are known; for
    other schemes `resolver` names a function (module:name) that gives both for a URI, in every worker."""
    if resolver:
        module, _, name = resolver.partition(":")
        return getattr(importlib.import_module(module), name)(uri)
    if match := re.match(r"(?:file:/*)?(/.*)", re.sub(r"^file:/+", "/", uri)):
        return fs.LocalFileSystem(), match[1].rstrip("/") or "/"
    store, path = fs.FileSystem.from_uri(uri)
    return store, path.rstrip("/")


def replace(store: fs.FileSystem, source: str, target: str) -> None:
    """Moves a file to its place, over one that is there."""
    store.create_dir(target.rpartition("/")[0], recursive=True)
    try:
        store.move(source, target)
    except OSError:  # stores that don't overwrite
        if store.get_file_info(source).type == fs.FileType.NotFound:
            raise
        store.delete_file(target)
        store.move(source, target)
