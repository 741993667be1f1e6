"""Members of zip archives as rows, without unpacking the archives.

The source `voxmill_zips` reads the central directory of each archive below a folder once, when the scan is planned, and
deals the members into partitions by their stored bytes; tasks go straight to their members' bytes. Members are told by
the option `members` (paths, one a line) or, with spark.sql.python.filterPushdown.enabled, by filters on job_id and path
(equality, IN, starts with, ends with): what isn't asked for isn't read.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .stores import store_of

SCHEMA = "job_id string, path string, size long, content binary"
KINDS = pa.schema([("job_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
PARTITION_BYTES, PUSH = 64 << 20, "spark.sql.python.filterPushdown.enabled"


class Members(InputPartition):
    """(archive, job_id, member, where its header is, stored bytes, size, how it is stored, checksum)"""

    def __init__(self, members: list[tuple]):
        super().__init__(0)
        self.members = members


class ZipSource(DataSource):
    """Options: path, members, names (true: no contents), partitionBytes, resolver (see stores), push."""

    @classmethod
    def name(cls) -> str:
        return "voxmill_zips"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ZipReader:
        return (PushedZipReader if self.options.get("push") == "true" else ZipReader)(self.options)


class ZipReader(DataSourceReader):
    def __init__(self, options: Mapping):
        self.root, self.resolver = options["path"], options.get("resolver", "")
        self.names, self.most = options.get("names") == "true", int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, Callable[[str], bool]]] = []
        if wanted := options.get("members"):
            self.tests.append(("path", frozenset(wanted.split("\n")).__contains__))

    def wanted(self, job: str, path: str) -> bool:
        return all(test({"job_id": job, "path": path}[column]) for column, test in self.tests)

    def directory(self, store: fs.FileSystem, path: str) -> list[tuple]:
        job = path.rpartition("/")[2].removesuffix(".zip")
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            return [(path, job, x.filename, x.header_offset, x.compress_size, x.file_size, x.compress_type, x.CRC) for x in z.infolist() if not x.is_dir() and self.wanted(job, x.filename)]

    def partitions(self) -> list[Members]:
        store, top = store_of(self.root, self.resolver)
        archives = [x.path for x in store.get_file_info(fs.FileSelector(top, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(".zip") and not any(p[0] in "._" for p in x.path[len(top) :].strip("/").split("/"))]
        out, own, room = [], [], self.most
        with ThreadPoolExecutor(16) as pool:
            for members in pool.map(lambda p: self.directory(store, p), archives):
                for m in members:
                    own.append(m)
                    room -= m[4] if not self.names else 1 << 10
                    if room <= 0:
                        out.append(Members(own))
                        own, room = [], self.most
        return [*out, Members(own)] if own or not out else out

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.root, self.resolver)
        now, f = None, None
        try:
            for archive, job, path, at, stored, size, kind, crc in partition.members:
                content = None
                if not self.names:
                    if archive != now:
                        if f is not None:
                            f.close()
                        now, f = archive, store.open_input_file(archive)
                    content = member(f, at, stored, kind)
                    if zlib.crc32(content) != crc:
                        raise ValueError(f"{archive}: {path} doesn't match its checksum.")
                yield pa.RecordBatch.from_pylist([{"job_id": job, "path": path, "size": size, "content": content}], schema=KINDS)
        finally:
            if f is not None:
                f.close()


def member(f, at: int, stored: int, kind: int) -> bytes:
    """A member's content, by the place of its header in the archive."""
    f.seek(at)
    name, extra = struct.unpack("<26xHH", f.read(30))
    f.seek(at + 30 + name + extra)
    raw = f.read(stored)
    if kind == zipfile.ZIP_STORED:
        return raw
    if kind == zipfile.ZIP_DEFLATED:
        return zlib.decompress(raw, -15)
    raise ValueError(f"compression {kind} isn't known")


class PushedZipReader(ZipReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) == 1 and column[0] in ("job_id", "path") and (test := tested(f)):
                self.tests.append((column[0], test))
            else:
                yield f


def tested(f: Filter) -> Callable[[str], bool] | None:
    if isinstance(f, EqualTo):
        return lambda x: x == f.value
    if isinstance(f, In):
        return lambda x: x in f.value
    if isinstance(f, StringStartsWith):
        return lambda x: x.startswith(f.value)
    if isinstance(f, StringEndsWith):
        return lambda x: x.endswith(f.value)
    return None


def read_zips(spark: SparkSession, root: str, members: tuple[str, ...] = (), names: bool = False, resolver: str = "", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """job_id (the archive's name), path, size, content of the members of all archives below root. names: without content."""
    spark.dataSource.register(ZipSource)
    push = (spark.conf.get(PUSH, "false") or "false").lower()
    options = {"path": root, "members": "\n".join(members), "names": str(names).lower(), "resolver": resolver, "push": push, "partitionBytes": str(partition_bytes)}
    return spark.read.format(ZipSource.name()).options(**options).load()
