"""A sink for files: rows (job_id, path, content) become root/job_id/path in any store, all of them or none.

Tasks write below root/_staging-ID, each attempt in a folder of its own, and beside it a list (Parquet) of what it wrote;
they report the folder alone, so that the driver's share grows with the tasks, not with the files. When all tasks are done,
tasks move the listed files to their places (a rename each), and a list whose files are in place goes to root/_written-ID;
readers skip names with an underscore. A task that fails leaves nothing in sight, one that is repeated nothing twice, and a run
that fails has its staging folder removed (but for what a task that is still being stopped writes there, out of sight).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .stores import replace, store_of

MOVES, LISTED = 16, 10_000
TASKS = "_tasks"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class FileSink(DataSource):
    """Options: path (the root), run (an id), resolver (see stores), staged (true: the commit moves nothing, place_files does)."""

    @classmethod
    def name(cls) -> str:
        return "voxmill_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options), "piece" in schema.fieldNames())


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, pieces: bool):
        self.root, self.run, self.resolver, self.pieces = options["path"], options["run"], options.get("resolver", ""), pieces
        self.staged = options.get("staged") == "true"

    def _places(self):
        store, top = store_of(self.root, self.resolver)
        return store, top, f"{top}/_staging-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, staging = self._places()
        own = f"{staging}/{uuid.uuid4().hex}"
        files: dict[tuple, dict] = {}
        now, out, kinds = None, None, None
        try:
            for batch in iterator:
                if kinds is None:
                    more = [x for x in batch.schema if x.name not in ("job_id", "path", "content", "piece")]
                    kinds = pa.schema([("job_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("own", pa.string()), *more])
                    store.create_dir(own, recursive=True)
                told = batch.select([x for x in kinds.names if x not in ("size", "own")]).to_pylist()
                for k, row in enumerate(told):
                    job, path = row["job_id"], row["path"]
                    key = (job, path) if path is not None else (len(files), None)
                    if path is None or path.endswith("/"):
                        files[key] = row | {"size": None if path is None else 0, "own": None}
                        continue
                    content = batch.column("content")[k].as_py() or b""
                    if out is None or key != now or not self.pieces:
                        if out is not None:
                            out.close()
                        if self.pieces and key in files:
                            raise ValueError(f"Pieces of {job}/{path} don't follow each other.")
                        at = files[key]["own"] if key in files else str(len(files))
                        now, out, files[key] = key, store.open_output_stream(f"{own}/{at}"), row | {"size": 0, "own": at}
                    out.write(content)
                    files[key]["size"] += len(content)
        finally:
            if out is not None:
                out.close()
        if files:
            rows = list(files.values())
            with store.open_output_stream(f"{own}.parquet") as f, pq.ParquetWriter(f, kinds) as w:
                for k in range(0, len(rows), LISTED):
                    w.write_table(pa.Table.from_pylist(rows[k : k + LISTED], schema=kinds))
        return Written(own, len(files))

    def commit(self, messages: list[Written | None]) -> None:
        store, top, staging = self._places()
        store.create_dir(top, recursive=True)
        tasks = [m.folder.rpartition("/")[2] for m in messages if m and m.files]
        if self.staged:
            store.create_dir(staging, recursive=True)
            with store.open_output_stream(f"{staging}/{TASKS}") as f:
                f.write("\n".join(tasks).encode())
            return
        with store.open_output_stream(f"{top}/_written-{self.run}.jsonl") as log:
            for task in tasks:
                for batch in placed(store, top, self.run, task):
                    for row in batch.select(["job_id", "path", "size"]).to_pylist():
                        log.write((json.dumps(row) + "\n").encode())
        clear(store, staging)

    def abort(self, messages: list[Written | None]) -> None:
        store, _, staging = self._places()
        clear(store, staging)


def clear(store: fs.FileSystem, staging: str) -> None:
    try:
        store.delete_dir(staging)
    except FileNotFoundError:
        pass


def listed(store: fs.FileSystem, top: str, run: str, task: str) -> Iterator[pa.RecordBatch]:
    """A task's list, from where it is now."""
    places = (f"{top}/_written-{run}/{task}.parquet", f"{top}/_staging-{run}/{task}.parquet")
    at = next((p for p, x in zip(places, store.get_file_info(list(places)), strict=True) if x.type == fs.FileType.File), places[0])
    with store.open_input_file(at) as f:
        yield from pq.ParquetFile(f).iter_batches(LISTED)


def placed(store: fs.FileSystem, top: str, run: str, task: str) -> Iterator[pa.RecordBatch]:
    """Moves a task's files to their places; what an attempt before has moved stays there. Gives the list meanwhile."""
    staging = f"{top}/_staging-{run}/{task}"

    def place(item: tuple) -> None:
        job, path, own = item
        if path is None:
            return
        if own is None:
            store.create_dir(f"{top}/{job}/{path.rstrip('/')}", recursive=True)
            return
        try:
            replace(store, f"{staging}/{own}", f"{top}/{job}/{path}")
        except OSError:
            there = [x.type for x in store.get_file_info([f"{staging}/{own}", f"{top}/{job}/{path}"])]
            if there != [fs.FileType.NotFound, fs.FileType.File]:
                raise

    with ThreadPoolExecutor(MOVES) as pool:
        for batch in listed(store, top, run, task):
            list(pool.map(place, zip(*(batch.column(c).to_pylist() for c in ("job_id", "path", "own")), strict=True)))
            yield batch


@dataclass
class Staged:
    """Files that are written, but not in their places yet."""

    spark: SparkSession
    root: str
    resolver: str
    run: str
    tasks: list[str]
    schema: StructType

    def by_task(self) -> DataFrame:
        tasks = self.spark.createDataFrame([(x,) for x in self.tasks], "task string")
        return tasks.repartition(max(1, len(self.tasks)), "task")

    def rows(self) -> DataFrame:
        """What was written: job_id, path, size and all columns beside the content; where path is null, nothing was."""
        root, resolver, run, schema = self.root, self.resolver, self.run, self.schema

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, top = store_of(root, resolver)
            for b in batches:
                for task in b.column("task").to_pylist():
                    for rows in listed(store, top, run, task):
                        yield rows.select(schema.fieldNames())

        return self.by_task().mapInArrow(go, schema)


def stage_files(files: DataFrame, root: str, resolver: str = "") -> Staged:
    """Writes files (job_id, path, content) below root, out of sight until place_files moves them. Rows without a path are
    only listed, other columns are kept in the lists."""
    spark, run = files.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(FileSink)
    pieces = "piece" in files.columns
    rows = files.select("job_id", "path", "content", *(c for c in files.columns if c not in ("job_id", "path", "content")))
    if pieces:
        rows = rows.repartition("job_id", "path").sortWithinPartitions("job_id", "path", "piece")
    rows.write.format(FileSink.name()).mode("append").options(path=root, run=run, resolver=resolver, staged="true").save()
    store, top = store_of(root, resolver)
    with store.open_input_stream(f"{top}/_staging-{run}/{TASKS}") as f:
        tasks = f.read().decode().split()
    schema = StructType().add("job_id", "string").add("path", "string").add("size", "long")
    for c in rows.schema:
        if c.name not in ("job_id", "path", "content", "piece"):
            schema = schema.add(c.name, c.dataType)
    return Staged(spark, root, resolver, run, tasks, schema)


def place_files(*staged: Staged) -> None:
    """Moves what was staged to its places, by tasks. Nothing is moved before all is there."""
    try:
        for own in staged:
            root, resolver, run = own.root, own.resolver, own.run

            def go(batches: Iterator[pa.RecordBatch], root=root, resolver=resolver, run=run) -> Iterator[pa.RecordBatch]:
                store, top = store_of(root, resolver)
                for b in batches:
                    for task in b.column("task").to_pylist():
                        n = sum(x.num_rows for x in placed(store, top, run, task))
                        there = f"{top}/_staging-{run}/{task}.parquet"
                        if store.get_file_info(there).type == fs.FileType.File:
                            replace(store, there, f"{top}/_written-{run}/{task}.parquet")
                        yield pa.RecordBatch.from_pydict({"n": [n]})

            own.by_task().mapInArrow(go, "n long").agg({"n": "sum"}).collect()
    finally:
        drop_staged(*staged)


def drop_staged(*staged: Staged) -> None:
    for own in staged:
        store, top = store_of(own.root, own.resolver)
        clear(store, f"{top}/_staging-{own.run}")


def write_files(files: DataFrame, root: str, resolver: str = "") -> DataFrame:
    """Writes files (job_id, path, content) to root/job_id/path, all or none. A path that ends with / is a folder. With a
    column `piece`, a file is its pieces in order: its rows meet in one task, which streams them. Returns what was written
    (job_id, path, size), from the run's lists."""
    names = ["job_id", "path", "content", *(["piece"] if "piece" in files.columns else [])]
    own = stage_files(files.select(*names), root, resolver)
    place_files(own)
    return own.rows().select("job_id", "path", "size")
