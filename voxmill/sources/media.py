"""Media files: listing, probing, decoding, PCM audio in and out. PCM WAV is read here; other formats go through the
programs ffprobe and ffmpeg where they are installed (FfmpegProber, FfmpegDecoder), or another prober and decoder."""

from __future__ import annotations

import io
import json
import shutil
import subprocess
import time
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.segments import MIN_SILENCE, NOISE_DB

PROBE = "streams array<struct<codec_type:string>>, duration double, sample_rate int, channels int"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder: path, file, job_id (the folder that holds the file), size and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("job_id"), F.col("length").alias("size"), "content")


def probe_wav(content: bytes) -> dict | None:
    """Streams, duration, rate and channels of a WAV file; None if it isn't one."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            return {"streams": [{"codec_type": "audio"}], "duration": w.getnframes() / w.getframerate(), "sample_rate": w.getframerate(), "channels": w.getnchannels()}
    except (wave.Error, EOFError, ValueError, ZeroDivisionError):
        return None


class FfmpegProber:
    """What ffprobe tells of a file of any format, by a pipe; None for a file it can't read."""

    def __init__(self, program: str = "ffprobe"):
        self.program = program

    def __call__(self, content: bytes) -> dict | None:
        if not shutil.which(self.program):
            raise RuntimeError(f"{self.program} is not installed.")
        done = subprocess.run([self.program, "-v", "error", "-show_streams", "-show_format", "-of", "json", "-i", "pipe:0"], input=content, capture_output=True)
        if done.returncode:
            return None
        told = json.loads(done.stdout or b"{}")
        streams = [{"codec_type": x.get("codec_type")} for x in told.get("streams", [])]
        audio = next((x for x in told.get("streams", []) if x.get("codec_type") == "audio"), {})
        return {"streams": streams, "duration": float(told.get("format", {}).get("duration") or 0), "sample_rate": int(audio.get("sample_rate") or 0), "channels": int(audio.get("channels") or 0)}


class FfmpegDecoder:
    """Samples and rate of a file of any format, by ffmpeg and a pipe."""

    def __init__(self, program: str = "ffmpeg"):
        self.program = program

    def __call__(self, content: bytes) -> tuple[np.ndarray, int]:
        if not shutil.which(self.program):
            raise RuntimeError(f"{self.program} is not installed.")
        done = subprocess.run([self.program, "-v", "error", "-i", "pipe:0", "-vn", "-acodec", "pcm_s16le", "-f", "wav", "pipe:1"], input=content, capture_output=True)
        if done.returncode:
            raise ValueError(done.stderr.decode(errors="replace").strip()[-500:] or "ffmpeg failed")
        head = done.stdout.index(b"data") + 8  # a pipe can't be sought, so the header's lengths may be wrong
        with wave.open(io.BytesIO(done.stdout[: head - 4] + (0).to_bytes(4, "little"))) as w:
            return np.frombuffer(done.stdout[head:], "<i2").astype(np.float64).reshape(-1, w.getnchannels()), w.getframerate()


def probe(files: DataFrame, prober: Callable[[bytes], dict | None] = probe_wav) -> DataFrame:
    """Adds what the prober finds; nulls where it fails. Empty files are not probed."""
    keep = [c for c in files.columns if c not in ("streams", "duration", "sample_rate", "channels")]
    src = files.select(*keep)
    names = ("streams", "duration", "sample_rate", "channels")
    kinds = (pa.list_(pa.struct([("codec_type", pa.string())])), pa.float64(), pa.int32(), pa.int32())

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a file at a time
                row = b.slice(k, 1)
                found = probed(row.column("content")[0].as_py(), prober)
                yield pa.RecordBatch.from_arrays([*row.columns, *(pa.array([found.get(n)], t) for n, t in zip(names, kinds, strict=True))], names=[*row.schema.names, *names])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
    return src.mapInArrow(go, f"{ddl}, {PROBE}")


def probed(content: bytes | None, prober: Callable[[bytes], dict | None]) -> dict:
    try:
        return (prober(content) if content else None) or {}
    except Exception:  # whatever a file makes a prober do, it is that file's failure
        return {}


def samples_of(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples (frames x channels, int16 scale) of PCM data of 8, 16, 24 or 32 bits; what is no whole frame goes."""
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) * 256
    elif width == 3:  # three bytes, the last with the sign, below a byte of zeros
        x = np.zeros((len(raw) // 3, 4), np.uint8)
        x[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = x.view("<i4")[:, 0] / 65536
    else:
        x = np.frombuffer(raw, "<i2").astype(np.float64) if width == 2 else np.frombuffer(raw, "<i4") / 65536
    return x.reshape(-1, channels)


def read_pcm(content: bytes) -> tuple[np.ndarray, int]:
    """Samples (frames x channels, int16 scale) and rate of a PCM WAV file."""
    with wave.open(io.BytesIO(content)) as w:
        return samples_of(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()), w.getframerate()


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    x = np.clip(np.rint(samples), -32768, 32767).astype("<i2")
    x = x[:, None] if x.ndim == 1 else x
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1] or 1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(x.tobytes())
    return out.getvalue()


def kernel_of(cutoff: float, half: int = 32) -> np.ndarray:
    """A windowed sinc that takes away what lies above `cutoff` (a share of the sampling rate); of odd length."""
    half = int(np.ceil(half * 0.5 / cutoff))
    k = np.arange(-half, half + 1)
    kernel = 2 * cutoff * np.sinc(2 * cutoff * k) * np.hanning(len(k) + 2)[1:-1]
    return kernel / kernel.sum()


def low_passed(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    half = len(kernel) // 2
    padded = np.pad(x, ((half, half), (0, 0)), mode="edge")
    return np.stack([np.convolve(padded[:, c], kernel, "valid") for c in range(x.shape[1])], axis=1)


def convert(content: bytes, rate: int = 16000, channels: int = 1, decoder: Callable[[bytes], tuple[np.ndarray, int]] = read_pcm) -> bytes:
    """Down-mixed (or repeated) to `channels` and resampled to `rate`: linearly, behind a low pass where the rate falls."""
    x, old = decoder(content)
    if x.shape[1] != channels:
        x = np.repeat(x.mean(axis=1, keepdims=True), channels, axis=1)
    if old != rate and len(x):
        if old > rate:
            x = low_passed(x, kernel_of(0.5 * rate / old))
        at = np.arange(round(len(x) * rate / old)) * old / rate
        x = np.stack([np.interp(at, np.arange(len(x)), x[:, c]) for c in range(channels)], axis=1)
    return wav_bytes(x, rate)


def quiet_runs(x: np.ndarray, noise_db: float = NOISE_DB, full_scale: float = 32768.0) -> np.ndarray:
    """All runs (start, end) of samples of one channel that are quieter than noise_db."""
    quiet = np.abs(x) < full_scale * 10 ** (noise_db / 20)
    return np.flatnonzero(np.diff(quiet.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)


def silences_of(x: np.ndarray, rate: int, noise_db: float = NOISE_DB, seconds: float = MIN_SILENCE, full_scale: float = 32768.0) -> list[dict]:
    """Silences, in seconds, of one channel: quieter than noise_db for at least `seconds`."""
    edges = quiet_runs(x, noise_db, full_scale)
    edges = edges[edges[:, 1] - edges[:, 0] >= max(1, round(seconds * rate))]
    return [{"start": a / rate, "end": b / rate} for a, b in edges.tolist()]


PREPARED = "job_id string, size long, streams array<struct<codec_type:string>>, duration double, audio binary, silences array<struct<start:double,end:double>>, total_duration double, error string, seconds double"


def prepare_audio(files: DataFrame, rate: int = 16000, channels: int = 1, prober: Callable[[bytes], dict | None] = probe_wav, decoder: Callable[[bytes], tuple[np.ndarray, int]] = read_pcm, noise_db: float = NOISE_DB, silence: float = MIN_SILENCE) -> DataFrame:
    """From job_id, size, content: what was probed, and where that is a file with sound, its audio (WAV of the wanted rate
    and channels), silences and total_duration; error says why a file can't be converted, seconds how long it took. A
    file at a time, its samples never leaving the worker; a bad file is a row like others."""
    src = files.select(F.col("job_id").cast("string").alias("job_id"), F.col("size").cast("long").alias("size"), "content")
    kinds = pa.schema([("job_id", pa.string()), ("size", pa.int64()), ("streams", pa.list_(pa.struct([("codec_type", pa.string())]))), ("duration", pa.float64()), ("audio", pa.binary()), ("silences", pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))), ("total_duration", pa.float64()), ("error", pa.string()), ("seconds", pa.float64())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                began, content = time.perf_counter(), b.column("content")[k].as_py()
                found = probed(content, prober)
                row = {"job_id": b.column("job_id")[k].as_py(), "size": b.column("size")[k].as_py(), "streams": found.get("streams"), "duration": found.get("duration")}
                if any(x.get("codec_type") == "audio" for x in found.get("streams") or []) and (found.get("duration") or 0) > 0:
                    try:
                        row["audio"] = convert(content, rate, channels, decoder)
                        x, _ = read_pcm(row["audio"])
                        row |= {"silences": silences_of(x[:, 0], rate, noise_db, silence), "total_duration": len(x) / rate}
                    except Exception as e:  # this file's failure, not the run's
                        row |= {"audio": None, "error": f"{type(e).__name__}: {e}"}
                row["seconds"] = time.perf_counter() - began
                yield pa.RecordBatch.from_pylist([row], schema=kinds)

    return src.mapInArrow(go, PREPARED)


def cut_chunks(jobs: DataFrame) -> DataFrame:
    """From job_id, audio, segments: a row per chunk with its WAV (job_id, chunk_id, chunk_path, start_ts, end_ts, content)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x, rate = read_pcm(b.column("audio")[k].as_py())
                for i, s in enumerate(b.column("segments")[k].as_py() or []):
                    content = wav_bytes(x[round(s["start"] * rate) : round(s["end"] * rate)], rate)
                    yield pa.RecordBatch.from_pydict({"job_id": [b.column("job_id")[k].as_py()], "chunk_id": [i], "chunk_path": [f"chunk_{i:04d}.wav"], "start_ts": [s["start"]], "end_ts": [s["end"]], "content": [content]})

    return jobs.select("job_id", "audio", "segments").mapInArrow(go, "job_id string, chunk_id long, chunk_path string, start_ts double, end_ts double, content binary")
