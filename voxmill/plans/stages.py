"""Stages over DataFrames of jobs, their configuration and the checks before a run."""

from __future__ import annotations

import importlib
import platform
import sys
from dataclasses import dataclass, fields
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_name
from ..operators.segments import segments_or_windows
from ..operators.validation import INVALID, is_valid_media, stage_result
from ..sources.bundles import manifest_documents
from ..sources.filesink import write_files
from ..sources.media import cut_chunks, prepare_audio, probe, probe_wav, read_pcm
from ..sources.shared import written_once


@dataclass(frozen=True)
class Config:
    """Settings by section; the audio's are the ones that preprocessing reads."""

    # The defaults of the pipeline's configuration.

    asr_model: str = "large-v3"
    asr_device: str = "cpu"
    asr_compute_type: str = "int8"
    asr_vad_filter: bool = True
    asr_language: str = "en"
    translate_model: str = "ai4bharat/indictrans2-en-indic-1B"
    translate_device: str = "cpu"
    tts_model: str = "coqui/xtts_v2"
    tts_device: str = "cuda"
    audio_sample_rate: int = 16000
    audio_channels: int = 1

    @classmethod
    def read(cls, text: str) -> Config:
        """From YAML of two levels: sections, and names with plain values."""
        section, found, kinds = "", {}, {f.name: type(f.default) for f in fields(cls)}
        for line in text.splitlines():
            name, _, value = line.split("#")[0].partition(":")
            value = value.strip().strip("\"'")
            if not name.strip():
                continue
            if not name.startswith(" "):
                section = name.strip()
            elif (key := f"{section}_{name.strip()}") in kinds:
                found[key] = value.lower() == "true" if kinds[key] is bool else kinds[key](value)
        return cls(**found)


class Stage(Protocol):
    """A stage validates cheaply, then turns jobs into rows and one result row per job."""

    def validate(self, jobs: DataFrame) -> DataFrame: ...
    def run(self, jobs: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]: ...


class Preprocess:
    """Media files to chunks: probe, validate, convert, find silences, cut. jobs: job_id, size, content. prober and decoder
    read other formats than PCM WAV (see sources.media)."""

    def __init__(self, prober=probe_wav, decoder=read_pcm):
        self.prober, self.decoder = prober, decoder

    def validate(self, jobs: DataFrame) -> DataFrame:
        probed = probe(jobs, self.prober)
        return probed.withColumn("valid", is_valid_media(F.col("size"), F.col("streams"), F.col("duration")))

    def run(self, jobs: DataFrame, config: Config | None = None, expected: DataFrame | None = None, artifacts: str = "") -> tuple[DataFrame, DataFrame]:
        """Chunks with their audio, and a stage result per job with its latency. Refused jobs and those whose audio can't be
        read fail, the others go on; each file is probed and converted once. expected: job_id of all jobs, so that those
        without a file (or with an empty one, which Spark doesn't list) fail, too. artifacts: a folder of any store for the
        chunks and each job's manifest, all written or none, which the results then name."""
        config = config or Config()
        jobs = jobs if expected is None else expected.select("job_id").distinct().join(jobs, "job_id", "left")
        rate = config.audio_sample_rate
        made = written_once(prepare_audio(jobs, rate, config.audio_channels, self.prober, self.decoder), "prepared")
        valid = is_valid_media(F.col("size"), F.col("streams"), F.col("duration"))
        cuts = made.where(valid & F.col("error").isNull()).withColumn("segments", segments_or_windows(F.col("silences"), F.col("total_duration")))
        measures = {"sample_rate": F.lit(float(rate)), "channels": F.lit(float(config.audio_channels)), "num_segments": F.size("segments").cast("double"), "latency_ms": F.col("seconds") * 1000}
        measures = F.create_map(*(x for k, v in measures.items() for x in (F.lit(k), v)))
        done = cuts.select("job_id", *stage_result("preprocess", "done", output=F.concat(F.lit(f"{artifacts}/"), "job_id", F.lit("/manifest.json")) if artifacts else None, metrics=measures))
        latency = F.create_map(F.lit("latency_ms"), F.col("seconds") * 1000)
        failed = made.where(~valid | F.col("error").isNotNull()).select("job_id", *stage_result("preprocess", "failed", metrics=latency, error=F.when(valid, F.col("error")).otherwise(INVALID)))
        chunks = cut_chunks(cuts)
        if artifacts:
            manifests = manifest_documents(cuts.select("job_id", F.posexplode("segments").alias("chunk_id", "s")).select("job_id", "chunk_id", chunk_name(F.col("chunk_id")).alias("chunk_path"), F.col("s.start").alias("start_ts"), F.col("s.end").alias("end_ts")))
            documents = manifests.select("job_id", F.lit("manifest.json").alias("path"), F.col("json").cast("binary").alias("content"))
            write_files(documents.unionByName(chunks.select("job_id", F.concat(F.lit("chunks/"), "chunk_path").alias("path"), "content")), artifacts)
        return chunks, done.unionByName(failed)


def latest_attempt(results: DataFrame) -> DataFrame:
    """The result of the last attempt of each job and stage."""
    whole = F.struct(*[c for c in results.columns if c != "metrics"], "metrics")
    return results.groupBy("job_id", "stage_name").agg(F.max_by(whole, "attempt").alias("r")).select("r.*")


def preflight(spark: SparkSession, modules: tuple[str, ...] = ("torch", "TTS"), gpu: bool = True) -> DataFrame:
    """Diagnostics of the driver as one row; a missing module or GPU raises, before any model is loaded."""
    found = {"python": sys.version.split()[0], "platform": platform.platform()}
    for name in modules:
        try:
            found[name.lower()] = str(getattr(importlib.import_module(name), "__version__", "unknown"))
        except ImportError as e:
            raise RuntimeError(f"{name} is not installed.") from e
    if gpu:
        torch = importlib.import_module("torch")
        if not torch.cuda.is_available():
            raise RuntimeError("CUDA is not available.")
        found |= {"gpu": torch.cuda.get_device_name(0), "gpu_memory_gb": str(torch.cuda.get_device_properties(0).total_memory / 1024**3)}
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} string" for k in found))
