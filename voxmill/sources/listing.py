"""Files below a folder, or of a pattern, that tasks list and read: neither names nor sizes of them pass through the driver.

A folder with a star behind it is listed in one task, what it holds is dealt to tasks that go on from there, and so for each
star. Spark's own sources hold all names of a scan on the driver, several times over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import store_of

BATCH_FILES, BATCH_BYTES = 1000, 8 << 20
PATHS, KINDS = pa.schema([("path", pa.string())]), pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


def visible(path: str) -> bool:
    return path.rpartition("/")[2][:1] not in "._"


def known(pattern: str, resolver: str = "") -> bool:
    """Whether tasks can list it: a store that pyarrow reaches, stars as the only wildcards, no compressed documents."""
    try:
        store_of(pattern.partition("*")[0].rpartition("/")[0] or "/", resolver)
    except (OSError, ValueError):  # ArrowInvalid is a ValueError
        return False
    return not re.search(r"[?\[\]{}\\]|\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd)$", pattern)


def held(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    try:
        return store.get_file_info(fs.FileSelector(folder))
    except (FileNotFoundError, NotADirectoryError):
        return []


def walked(store: fs.FileSystem, info: fs.FileInfo, deep: bool) -> Iterator[fs.FileInfo]:
    """The file, or the visible files of the folder; empty ones are none. deep: with those of all folders below."""
    todo, first = [info] if visible(info.path) or not deep else [], True
    while todo:
        now = todo.pop()
        if now.type == fs.FileType.File and now.size and visible(now.path):
            yield now
        elif now.type == fs.FileType.Directory and (deep or first):
            todo += [x for x in held(store, now.path) if visible(x.path)]
        first = False


def found_files(spark: SparkSession, pattern: str, deep: bool = False, names: tuple[str, ...] = (), content: bool = True, resolver: str = "") -> DataFrame:
    """path (in its store), size and content of the files that a pattern with stars stands for, or of those in the folders
    that it stands for. deep: and of all below these; names: only files of these names; content: else null. The folder
    before the first star must be there."""
    head, *tail = pattern.rstrip("/").split("*", 1)
    fixed, _, begun = head.rpartition("/") if tail else (head, "", "")
    steps = f"{begun}*{tail[0]}".split("/") if tail else []
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = frozenset(names)
    store, at = store_of(fixed or "/", resolver)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        raise FileNotFoundError(f"Path does not exist: {fixed}")

    def top(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"path": [store_of(fixed or "/", resolver)[1]]}, schema=PATHS)

    def matching(step: str):
        like = re.compile(".*".join(map(re.escape, step.split("*"))), re.DOTALL)

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, _ = store_of(fixed or "/", resolver)
            for b in batches:
                for folder in b.column("path").to_pylist():
                    inside = [x.path for x in held(store, folder) if like.fullmatch(x.path.rpartition("/")[2])]
                    for k in range(0, len(inside), BATCH_FILES):
                        yield pa.RecordBatch.from_pydict({"path": inside[k : k + BATCH_FILES]}, schema=PATHS)

        return go

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(fixed or "/", resolver)
        rows, room = [], BATCH_BYTES
        for b in batches:
            for info in store.get_file_info(b.column("path").to_pylist()):
                for x in walked(store, info, deep):
                    if wanted and x.path.rpartition("/")[2] not in wanted:
                        continue
                    row = {"path": x.path, "size": x.size}
                    if content:
                        with store.open_input_stream(x.path) as f:
                            row["content"] = f.read()
                        room -= x.size
                    rows.append(row)
                    if len(rows) >= BATCH_FILES or room <= 0:
                        yield pa.RecordBatch.from_pylist(rows, schema=KINDS)
                        rows, room = [], BATCH_BYTES
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=KINDS)

    rows = spark.range(1, numPartitions=1).mapInArrow(top, "path string")
    for step in steps:
        if "*" in step:
            rows = rows.mapInArrow(matching(step), "path string").repartition(n, "path")
        else:
            rows = rows.select(F.concat("path", F.lit(f"/{step}")).alias("path"))
    return rows.mapInArrow(files, "path string, size long, content binary")
