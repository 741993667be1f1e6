"""Recordings of any length, as ranges: no row and no task holds a whole one.

The source `voxmill_recordings` reads PCM WAV files below a folder in ranges of about `rangeBytes`, with as many frames
on either side as the conversion needs, so that a range's converted samples are those of the whole recording. With the
samples come numbers about silence: how long the range is quiet at its start and its end, and the long silences within.
These summaries merge in order (merged()), whatever the ranges; silences and segments come from them alone, and the
samples are read again only for the chunks, each from the ranges that it touches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.text import chunk_name
from ..operators.segments import MIN_SILENCE, NOISE_DB, bind, interval, segments_or_windows
from ..operators.validation import INVALID, is_valid_media, stage_result
from .media import kernel_of, low_passed, quiet_runs, samples_of
from .shared import written_once
from .stores import store_of

RANGE_BYTES, PARTITION_BYTES = 4 << 20, 64 << 20
RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
FIELDS = [
    ("job_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("seq", pa.int64()), ("start", pa.int64()), ("frames", pa.int64()), ("total", pa.int64()), ("per_range", pa.int64()),
    ("source_rate", pa.int64()), ("lead", pa.int64()), ("trail", pa.int64()), ("runs", RUNS), ("pcm", pa.binary()), ("error", pa.string()),
]
SCHEMA = "job_id string, path string, size long, seq long, start long, frames long, total long, per_range long, source_rate long, lead long, trail long, runs array<struct<a:long,b:long>>, pcm binary, error string"


@dataclass
class Header:
    rate: int
    channels: int
    width: int
    data: int
    frames: int

    @property
    def frame(self) -> int:
        return self.channels * self.width


def header_of(file, size: int) -> Header:
    """The header of a PCM WAV file; the data's length is bounded by the file's, as streamed files state none."""
    if file.read(4) != b"RIFF" or file.seek(8) != 8 or file.read(4) != b"WAVE":
        raise ValueError("not a WAV file")
    at, own = 12, None
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            if kind not in (1, 0xFFFE) or bits not in (8, 16, 24, 32) or not channels or not rate:
                raise ValueError("not PCM of 8 to 32 bits")
            own = (rate, channels, bits // 8)
        elif name == b"data" and own:
            there = size - at - 8
            return Header(*own, at + 8, (there if length in (0, 0xFFFFFFFF) else min(length, there)) // (own[1] * own[2]))
        at += 8 + length + length % 2
    raise ValueError("no PCM data")


class Ranges:
    """The ranges of one file, converted to `rate` and `channels`."""

    def __init__(self, file, header: Header, options: Options):
        self.file, self.h, self.o = file, header, options
        self.per = max(1, options.range_bytes // header.frame)
        self.kernel = kernel_of(0.5 * options.rate / header.rate) if options.rate < header.rate else None
        self.total = header.frames if options.rate == header.rate else round(header.frames * options.rate / header.rate)
        self.count = max(1, -(-header.frames // self.per))

    def samples(self, a: int, b: int) -> np.ndarray:
        self.file.seek(self.h.data + a * self.h.frame)
        x = samples_of(self.file.read((b - a) * self.h.frame), self.h.width, self.h.channels)
        return x if x.shape[1] == self.o.channels else np.repeat(x.mean(axis=1, keepdims=True), self.o.channels, axis=1)

    def converted(self, k: int) -> tuple[int, np.ndarray]:
        """The first frame of range k after conversion, and its samples."""
        h, rate = self.h, self.o.rate
        a, b = k * self.per, min((k + 1) * self.per, h.frames)
        if rate == h.rate:
            return a, self.samples(a, b)
        first, last = -(-a * rate // h.rate), self.total if b == h.frames else min(self.total, -(-b * rate // h.rate))
        half = 0 if self.kernel is None else len(self.kernel) // 2
        low, high = max(0, a - half), min(h.frames, b + half + 1)
        x = self.samples(low, high)
        if self.kernel is not None:
            x = low_passed(x, self.kernel)  # what it repeats at a cut end is beyond a and b, or the recording's own end
            low, x = max(low, a), x[max(low, a) - low : min(h.frames, b + 1) - low]
        at = np.minimum(np.arange(first, last) * h.rate / rate, h.frames - 1) - low
        return first, np.stack([np.interp(at, np.arange(len(x)), x[:, c]) for c in range(x.shape[1])], axis=1)


@dataclass
class Options:
    root: str
    resolver: str
    rate: int
    channels: int
    range_bytes: int
    partition_bytes: int
    least: int
    noise_db: float

    @classmethod
    def of(cls, given: Mapping) -> Options:
        rate = int(given.get("rate", 16000))
        least = max(1, round(float(given.get("silence", MIN_SILENCE)) * rate))
        return cls(given["path"], given.get("resolver", ""), rate, int(given.get("channels", 1)), int(given.get("rangeBytes", RANGE_BYTES)), int(given.get("partitionBytes", PARTITION_BYTES)), least, float(given.get("noiseDb", NOISE_DB)))


class Part(InputPartition):
    """Of some files: the ranges from the first to the one before the last; -1 for all that are left."""

    def __init__(self, files: list[tuple[str, int, int, int]]):
        super().__init__(0)
        self.files = files


class RecordingSource(DataSource):
    """Options: path, rate, channels, rangeBytes, partitionBytes, silence (seconds), noiseDb, resolver (see stores)."""

    @classmethod
    def name(cls) -> str:
        return "voxmill_recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordingReader:
        return RecordingReader(Options.of(self.options))


class RecordingReader(DataSourceReader):
    def __init__(self, options: Options):
        self.o = options

    def partitions(self) -> list[Part]:
        """Ranges by the files' sizes alone: headers are read by the tasks."""
        store, top = store_of(self.o.root, self.o.resolver)
        out, own, room = [], [], self.o.partition_bytes
        for info in store.get_file_info(fs.FileSelector(top, recursive=True)):
            inner = info.path[len(top) :].strip("/").split("/")
            if info.type != fs.FileType.File or any(x[0] in "._" for x in inner):
                continue
            at, ranges = 0, max(1, -(-info.size // self.o.range_bytes))
            while at < ranges:
                n = max(1, min(ranges - at, room // self.o.range_bytes))
                own.append((info.path, info.size, at, -1 if at + n == ranges else at + n))
                at, room = at + n, room - n * self.o.range_bytes
                if room < self.o.range_bytes:
                    out.append(Part(own))
                    own, room = [], self.o.partition_bytes
        return [*out, Part(own)] if own or not out else out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.o.root, self.o.resolver)
        for path, size, first, end in partition.files:
            yield from self.ranges(store, path, size, first, end)

    def ranges(self, store: fs.FileSystem, path: str, size: int, first: int, end: int) -> Iterator[pa.RecordBatch]:
        row = {"job_id": path.split("/")[-2] if "/" in path else None, "path": path, "size": size}
        k = first
        try:
            with store.open_input_file(path) as file:
                own = Ranges(file, header_of(file, size), self.o)
                for k in range(first, own.count if end < 0 else min(end, own.count)):  # noqa: B020
                    start, x = own.converted(k)
                    x = np.clip(np.rint(x), -32768, 32767).astype("<i2")
                    runs, n = quiet_runs(x[:, 0].astype(np.float64), self.o.noise_db), len(x)
                    lead = int(runs[0, 1]) if len(runs) and runs[0, 0] == 0 else 0
                    trail = n - int(runs[-1, 0]) if len(runs) and runs[-1, 1] == n else 0
                    inner = [(a, b) for a, b in runs.tolist() if a > 0 and b < n and b - a >= self.o.least]
                    told = {"seq": k, "start": start, "frames": n, "total": own.total, "per_range": own.per, "source_rate": own.h.rate, "lead": lead, "trail": trail, "pcm": x.tobytes()}
                    yield batch(row | told | {"runs": [{"a": a + start, "b": b + start} for a, b in inner]})
        except Exception as e:  # this file's failure, not the run's
            yield batch(row | {"seq": k, "error": f"{type(e).__name__}: {e}"})


def batch(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=pa.schema(FIELDS))


def read_ranges(spark: SparkSession, root: str, **options) -> DataFrame:
    """The ranges of all recordings below root (see SCHEMA); a file that can't be read is a row with its error."""
    spark.dataSource.register(RecordingSource)
    return spark.read.format(RecordingSource.name()).options(path=root, **{k: str(v) for k, v in options.items()}).load()


def joined(a: Column, b: Column, least: int) -> Column:
    """The summary of two stretches that follow each other: start, n, lead, trail, runs."""
    quiet_a, quiet_b = a.lead == a.n, b.lead == b.n
    between = F.struct((a.start + a.n - a.trail).alias("a"), (a.start + a.n + b.lead).alias("b"))
    inner = F.when(~quiet_a & ~quiet_b & (a.trail + b.lead >= least), F.array(between)).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    return F.struct(a.start.alias("start"), (a.n + b.n).alias("n"), F.when(quiet_a, a.n + b.lead).otherwise(a.lead).alias("lead"), F.when(quiet_b, b.n + a.trail).otherwise(b.trail).alias("trail"), F.concat(a.runs, inner, b.runs).alias("runs"))


def merged(summaries: DataFrame, keys: list[str], least: int) -> DataFrame:
    """One summary (column s) per key, from those of stretches that follow each other: joined in order, left to right."""
    rows = summaries.groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("all"))
    return rows.select(*keys, F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda a, b: joined(a, b, least)).alias("s"))


def recording_silences(ranges: DataFrame, rate: int, silence: float = MIN_SILENCE, block: int = 1024) -> DataFrame:
    """job_id, path, size, total, silences (seconds), error: of each recording, from its ranges' summaries, first those of
    `block` ranges and then of all blocks."""
    least = max(1, round(silence * rate))
    s = F.struct("start", F.col("frames").alias("n"), "lead", "trail", "runs").alias("s")
    parts = ranges.where("error is null").select("job_id", "path", F.expr(f"seq div {block}").alias("block"), s)
    whole = merged(merged(parts, ["job_id", "path", "block"], least), ["job_id", "path"], least)

    def silences(s: Column) -> Column:
        first, last = F.struct(F.lit(0).cast("long").alias("a"), s.lead.alias("b")), F.struct((s.n - s.trail).alias("a"), s.n.alias("b"))
        found = F.when(s.lead == s.n, F.array(first)).otherwise(F.concat(F.array(first), s.runs, F.array(last)))
        return F.transform(F.filter(found, lambda r: r.b - r.a >= least), lambda r: interval(r.a / rate, r.b / rate))

    told = ranges.groupBy("job_id", "path").agg(F.max("size").alias("size"), F.max("total").alias("total"), F.max("source_rate").alias("source_rate"), F.max("per_range").alias("per_range"), F.min("error").alias("error"))
    own = whole.select(F.col("job_id").alias("of_job"), F.col("path").alias("of_path"), bind(F.col("s"), silences).alias("silences"))
    both = told.join(own, F.col("job_id").eqNullSafe(F.col("of_job")) & (F.col("path") == F.col("of_path")), "left")
    return both.select(*told.columns, "silences")


def little_endian(n: Column, size: int = 4) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(size)))))


def wav_header(frames: Column, rate: int, channels: int) -> Column:
    size, number = frames * (2 * channels), lambda n, size=4: F.lit(n.to_bytes(size, "little"))
    fixed = (number(16), number(1, 2), number(channels, 2), number(rate), number(rate * 2 * channels), number(2 * channels, 2), number(16, 2))
    return F.concat(F.lit(b"RIFF"), little_endian(size + 36), F.lit(b"WAVEfmt "), *fixed, F.lit(b"data"), little_endian(size))


def cut_ranges(ranges: DataFrame, cuts: DataFrame, rate: int, channels: int = 1) -> DataFrame:
    """From the ranges, and job_id, path, source_rate, per_range, segments: job_id, chunk_id, chunk_path, start_ts, end_ts,
    piece, content: each chunk's WAV in pieces, one a range that it touches, the first with the header."""
    rows = cuts.select("job_id", "path", "source_rate", "per_range", F.posexplode("segments").alias("chunk_id", "s"))
    rows = rows.select(F.col("job_id").alias("of_job"), F.col("path").alias("of_path"), "source_rate", "per_range", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("s.start").alias("start_ts"), F.col("s.end").alias("end_ts"), F.rint(F.col("s.start") * rate).cast("long").alias("a"), F.rint(F.col("s.end") * rate).cast("long").alias("b"))
    in_range = lambda frame: F.expr(f"({frame}) * source_rate div {rate} div per_range")
    rows = rows.where("b > a").withColumn("of_seq", F.explode(F.sequence(in_range("a"), in_range("b - 1")))).drop("source_rate", "per_range")
    own = ranges.where("error is null").select("job_id", "path", "seq", "start", "frames", "pcm")
    both = own.join(rows, F.col("job_id").eqNullSafe(F.col("of_job")) & (F.col("path") == F.col("of_path")) & (F.col("seq") == F.col("of_seq")))
    first, last = F.greatest("a", "start"), F.least("b", F.col("start") + F.col("frames"))
    piece = F.substring("pcm", ((first - F.col("start")) * (2 * channels) + 1).cast("int"), ((last - first) * (2 * channels)).cast("int"))
    content = F.when(F.col("a") >= F.col("start"), F.concat(wav_header(F.col("b") - F.col("a"), rate, channels), piece)).otherwise(piece)
    return both.where(last > first).select("job_id", "chunk_id", chunk_name(F.col("chunk_id")).alias("chunk_path"), "start_ts", "end_ts", F.col("seq").alias("piece"), content.alias("content"))


def whole_chunks(pieces: DataFrame) -> DataFrame:
    """The pieces of each chunk as one row, for chunks that fit in one."""
    keys = ["job_id", "chunk_id", "chunk_path", "start_ts", "end_ts"]
    return pieces.groupBy(*keys).agg(F.expr("listagg(content, X'') WITHIN GROUP (ORDER BY piece)").alias("content"))


def preprocess_recordings(spark: SparkSession, root: str, rate: int = 16000, channels: int = 1, silence: float = MIN_SILENCE, noise_db: float = NOISE_DB, **options) -> tuple[DataFrame, DataFrame]:
    """The preprocessing stage for the recordings below root, of any length: pieces of chunks, and a stage result per
    recording. Files that can't be read, or hold no sound, fail; the others go on."""
    ranges = written_once(read_ranges(spark, root, rate=rate, channels=channels, silence=silence, noiseDb=noise_db, **options), "ranges")
    jobs = recording_silences(ranges, rate, silence).withColumn("seconds", F.col("total") / rate)
    sound = F.when(F.col("error").isNull(), F.array(F.struct(F.lit("audio").alias("codec_type"))))
    valid = is_valid_media(F.col("size"), sound, F.col("seconds"))
    cuts = jobs.where(valid).withColumn("segments", segments_or_windows(F.col("silences"), F.col("seconds")))
    measures = {"sample_rate": F.lit(float(rate)), "channels": F.lit(float(channels)), "num_segments": F.size("segments").cast("double")}
    done = cuts.select("job_id", *stage_result("preprocess", "done", metrics=F.create_map(*(x for k, v in measures.items() for x in (F.lit(k), v)))))
    failed = jobs.where(~valid).select("job_id", *stage_result("preprocess", "failed", error=F.coalesce("error", F.lit(INVALID))))
    return cut_ranges(ranges, cuts, rate, channels), done.unionByName(failed)
