"""Plug-in points for models. A backend is loaded once per Python worker and serves batches of rows."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import ASR_OUTPUT, ASR_SEGMENT
from ..operators.validation import stage_result
from ..sources.bundles import load_bundles, read_results, request_documents, result_documents
from ..sources.filesink import drop_staged, place_files, stage_files, write_files
from ..sources.media import probe_wav, wav_bytes
from ..sources.shared import written_once


class InferenceBackend(Protocol):
    """Speech recognition: transcribe() gives segments (start, end, text, ...) and (language, probability)."""

    def load(self) -> None: ...
    def transcribe(self, audio: bytes) -> tuple[list[dict], tuple[str, float]]: ...


class Translator(Protocol):
    def load(self) -> None: ...
    def translate(self, prompts: list[str], texts: list[str], source: list[str], target: list[str]) -> list[str]: ...


class Synthesiser(Protocol):
    def load(self) -> None: ...
    def speaker(self, reference: bytes) -> object: ...
    def synthesise(self, text: str, speaker: object, language: str) -> np.ndarray: ...


class ExternalSynthesis(Protocol):
    """A synthesiser that runs elsewhere: requests go out, results come back."""

    def export_requests(self, requests: DataFrame) -> DataFrame: ...
    def import_results(self, spark: SparkSession) -> DataFrame: ...


_loaded: dict[str, object] = {}


def settings(backend) -> str:
    """What tells a backend's model from others: its class and all of its settings."""
    return repr((type(backend).__qualname__, sorted((k, v) for k, v in vars(backend).items() if k != "ready")))


def loaded(backend):
    """The backend, loaded: the same one for all tasks of a worker."""
    key = settings(backend)
    if key not in _loaded:
        backend.load()
        _loaded[key] = backend
    return _loaded[key]


class StubRecogniser:
    """Deterministic: one segment per `step` seconds of audio, numbered words."""

    def __init__(self, language: str = "en", step: float = 1.0):
        self.language, self.step, self.ready = language, step, False

    def load(self) -> None:
        self.ready = True

    def transcribe(self, audio: bytes) -> tuple[list[dict], tuple[str, float]]:
        if not self.ready:
            raise RuntimeError("Model not loaded.")
        seconds = (probe_wav(audio) or {"duration": 0.0})["duration"]
        n = int(seconds // self.step)
        found = [{"start": k * self.step, "end": (k + 1) * self.step, "text": f" word{k} ", "avg_logprob": -0.1 * (k + 1), "no_speech_prob": 0.0, "compression_ratio": 1.0} for k in range(n)]
        return found, (self.language, 0.9)


class WhisperRecogniser:
    """Adapter for the optional faster_whisper package; language "auto" gives no hint."""

    def __init__(self, model: str = "large-v3", device: str = "cpu", compute_type: str = "int8", language: str = "auto"):
        self.model, self.device, self.compute_type, self.language = model, device, compute_type, language

    def load(self) -> None:
        from faster_whisper import WhisperModel  # optional

        _loaded[f"model of {settings(self)}"] = WhisperModel(self.model, device=self.device, compute_type=self.compute_type)

    def transcribe(self, audio: bytes) -> tuple[list[dict], tuple[str, float]]:
        import io

        model = _loaded.get(f"model of {settings(self)}")
        if model is None:
            raise RuntimeError("Model not loaded.")
        segments, info = model.transcribe(io.BytesIO(audio), language=None if self.language == "auto" else self.language)
        names = ("start", "end", "text", "avg_logprob", "no_speech_prob", "compression_ratio")
        return [{n: getattr(s, n) for n in names} for s in segments], (info.language, info.language_probability)


def recognise(chunks: DataFrame, backend: InferenceBackend) -> DataFrame:
    """From job_id, chunk_id, start_ts, content: what the backend hears in each chunk; a chunk that it can't read is a row
    with its error and without segments."""
    segment = pa.struct([(n, pa.string() if t == "string" else pa.float64()) for n, t in (x.split(":") for x in ASR_SEGMENT[len("struct<") : -1].split(","))])
    kinds = pa.schema([("job_id", pa.string()), ("chunk_id", pa.int64()), ("chunk_start", pa.float64()), ("language", pa.string()), ("language_probability", pa.float64()), ("segments", pa.list_(segment)), ("error", pa.string())])

    def heard(own: InferenceBackend, audio: bytes) -> dict:
        try:
            segments, (language, probability) = own.transcribe(audio)
            return {"language": language, "language_probability": probability, "segments": segments, "error": None}
        except Exception as e:  # this chunk's failure, not the others'
            return {"segments": [], "error": f"{type(e).__name__}: {e}"}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(backend)
        for b in batches:
            keys = b.select(["job_id", "chunk_id", "start_ts"]).rename_columns(["job_id", "chunk_id", "chunk_start"]).to_pylist()
            yield pa.RecordBatch.from_pylist([k | heard(own, c.as_py()) for k, c in zip(keys, b.column("content"), strict=True)], schema=kinds)

    return chunks.select(F.col("job_id").cast("string"), F.col("chunk_id").cast("long"), F.col("start_ts").cast("double"), "content").mapInArrow(go, ASR_OUTPUT)


def recognition_results(heard: DataFrame) -> DataFrame:
    """A stage result per job: failed where a chunk is, with counts."""
    totals = heard.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad"), F.min("error").alias("why"))
    metrics = F.create_map(F.lit("num_chunks"), F.col("n").cast("double"), F.lit("failed_chunks"), F.col("bad").cast("double"))
    done = totals.where("bad = 0").select("job_id", *stage_result("asr", "done", metrics=metrics))
    return done.unionByName(totals.where("bad > 0").select("job_id", *stage_result("asr", "failed", metrics=metrics, error=F.col("why"))))


class TranslationBackend:
    """Turns a Translator into a column: one call per batch of rows."""

    def __init__(self, translator: Translator):
        self.translator = translator

    def column(self, prompt: Column, text: Column, source: Column, target: Column) -> Column:
        translator = self.translator

        @F.pandas_udf("string")
        def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            own = loaded(translator)
            for p, t, a, b in batches:
                yield pd.Series(own.translate(p.tolist(), t.tolist(), a.tolist(), b.tolist()))

        return run(prompt, text, source, target)


class StubTranslator:
    def __init__(self):
        self.ready = False

    def load(self) -> None:
        self.ready = True

    def translate(self, prompts: list[str], texts: list[str], source: list[str], target: list[str]) -> list[str]:
        if not self.ready:
            raise RuntimeError("Model not loaded.")
        return [f"[{b}] {t}" for t, b in zip(texts, target, strict=True)]


class SequenceTranslator:
    """Adapter for an optional sequence-to-sequence model of the transformers package."""

    def __init__(self, model: str, device: str = "cpu", max_tokens: int = 256, beams: int = 5):
        self.model, self.device, self.max_tokens, self.beams = model, device, max_tokens, beams

    def load(self) -> None:
        from transformers import AutoModelForSeq2SeqLM, AutoTokenizer  # optional

        _loaded[f"model of {settings(self)}"] = (AutoTokenizer.from_pretrained(self.model, trust_remote_code=True), AutoModelForSeq2SeqLM.from_pretrained(self.model, trust_remote_code=True).to(self.device).eval())

    def translate(self, prompts: list[str], texts: list[str], source: list[str], target: list[str]) -> list[str]:
        if f"model of {settings(self)}" not in _loaded:
            raise RuntimeError("Model not loaded.")
        tokenizer, model = _loaded[f"model of {settings(self)}"]
        known = getattr(tokenizer, "lang_code_to_id", {})
        out: list[str] = [""] * len(prompts)
        for tag in set(target):  # the first token is forced per target language
            at = [k for k, b in enumerate(target) if b == tag]
            coded = tokenizer([prompts[k] for k in at], return_tensors="pt", padding=True, truncation=True, max_length=self.max_tokens).to(model.device)
            forced = {"forced_bos_token_id": known[tag]} if tag in known else {}
            for k, x in zip(at, tokenizer.batch_decode(model.generate(**coded, max_length=self.max_tokens, num_beams=self.beams, **forced), skip_special_tokens=True), strict=True):
                out[k] = x
        return out


class ToneSynthesiser:
    """Deterministic: a tone of 50 ms per character; temperature bends it, so that a test can see it arrive."""

    def __init__(self, rate: int = 24000, temperature: float = 0.7):
        self.rate, self.temperature = rate, temperature

    def load(self) -> None:
        pass

    def speaker(self, reference: bytes) -> object:
        return 200.0 + len(reference) % 200

    def synthesise(self, text: str, speaker: object, language: str) -> np.ndarray:
        n = max(1, len(text)) * self.rate // 20
        return 8000 * np.sin(2 * np.pi * (float(speaker) + self.temperature) * np.arange(n) / self.rate)


class VoiceCloner:
    """Adapter for an optional voice-cloning model of the TTS package."""

    def __init__(self, model: str = "tts_models/multilingual/multi-dataset/xtts_v2", device: str = "cuda", temperature: float = 0.7):
        self.model, self.device, self.temperature = model, device, temperature

    def load(self) -> None:
        from TTS.api import TTS  # optional

        _loaded[f"model of {settings(self)}"] = TTS(self.model).to(self.device)

    def _own(self):
        if (model := _loaded.get(f"model of {settings(self)}")) is None:
            raise RuntimeError("Model not loaded.")
        return model.synthesizer.tts_model

    def speaker(self, reference: bytes) -> object:
        import tempfile

        with tempfile.NamedTemporaryFile(suffix=".wav") as f:  # the model reads a path; gone when it has been read
            f.write(reference)
            f.flush()
            return self._own().get_conditioning_latents(audio_path=[f.name])

    def synthesise(self, text: str, speaker: object, language: str) -> np.ndarray:
        import torch

        latent, embedding = speaker
        with torch.no_grad():
            out = self._own().inference(text=text, language=language, gpt_cond_latent=latent, speaker_embedding=embedding, temperature=self.temperature)
        return np.asarray(out["wav"], np.float64) * 32767


SPOKEN = "job_id string, segment_id long, chunk_id long, audio_path string, duration double, content binary, error string, seconds double"


def voice_of(backend: Synthesiser, reference: bytes) -> tuple[object, Exception | None]:
    """The speaker of a voice sample, or why there is none."""
    try:
        return backend.speaker(reference), None
    except Exception as e:  # this job's failure, not the others'
        return None, e


def synthesise(requests: DataFrame, references: DataFrame, backend: Synthesiser, at_once: int = 64) -> DataFrame:
    """A row per requested segment: job_id, segment_id, chunk_id, audio_path, duration, content, error, seconds. Names hold
    chunk and segment, so segments of a chunk don't overwrite each other. A job's segments go in groups of `at_once`, each
    with the job's voice, which is worked out once per group; a segment that fails is a row with its error, and so are all
    segments of a job whose voice can't be read."""
    groups = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("segments") / at_once).cast("int") - 1, F.lit(0)))
    rows = requests.select("job_id", "language", F.col("output_sample_rate").alias("rate"), "segments", F.explode(groups).alias("k"))
    rows = rows.select("job_id", "language", "rate", "k", F.slice("segments", F.col("k") * at_once + 1, F.lit(at_once)).alias("segments"))
    rows = rows.join(references.select("job_id", F.col("content").alias("voice")), "job_id").repartition("job_id", "k")
    names = [x.split()[0] for x in SPOKEN.split(", ")]
    kinds = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.binary(), pa.string(), pa.float64()), strict=True)))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(backend)
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                speaker, broken = voice_of(own, r["voice"])
                for x in r["segments"] or []:
                    began = time.perf_counter()
                    row = {"job_id": r["job_id"], "segment_id": x["segment_id"], "chunk_id": x["chunk_id"], "audio_path": f"output/chunk_{x['chunk_id']:04d}_seg_{x['segment_id']:06d}.wav"}
                    try:
                        if broken:
                            raise broken
                        made = own.synthesise(x["text"], speaker, r["language"])
                        row |= {"duration": len(made) / r["rate"], "content": wav_bytes(made, r["rate"])}
                    except Exception as e:  # this segment's failure, not the job's others'
                        row["error"] = f"{type(e).__name__}: {e}"
                    yield pa.RecordBatch.from_pylist([row | {"seconds": time.perf_counter() - began}], schema=kinds)

    return rows.select("job_id", "language", "rate", "segments", "voice").mapInArrow(go, SPOKEN)


def results_of(synthesised: DataFrame, sample_rate: int = 24000) -> DataFrame:
    """Synthesis results, one row per job, of the segments that could be synthesised."""
    segment = F.struct("segment_id", "chunk_id", "audio_path", "duration")
    done = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), segment)))
    return synthesised.groupBy("job_id").agg(done.alias("segments")).select("job_id", F.lit(sample_rate).cast("long").alias("sample_rate"), "segments")


def stage_results_of(synthesised: DataFrame) -> DataFrame:
    """A stage result per job: failed where a segment is, with counts and the time taken."""
    totals = synthesised.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad"), F.min("error").alias("why"), F.sum("seconds").alias("seconds"))
    metrics = F.create_map(F.lit("num_segments"), F.col("n").cast("double"), F.lit("failed_segments"), F.col("bad").cast("double"), F.lit("latency_ms"), F.col("seconds") * 1000)
    path = F.concat("job_id", F.lit("/output/synthesis_result.json"))
    done = totals.where("bad = 0").select("job_id", *stage_result("tts", "done", output=path, metrics=metrics))
    return done.unionByName(totals.where("bad > 0").select("job_id", *stage_result("tts", "failed", metrics=metrics, error=F.col("why"))))


def run_bundles(spark: SparkSession, root: str, backend: Synthesiser) -> DataFrame:
    """The worker: loads and checks the bundles below root, synthesises their segments, writes the audio and a result
    document into each bundle's output folder, and returns a stage result per job. Audio is written once, where it belongs."""
    bundles = written_once(load_bundles(spark, root, audio=True), "bundles")
    spoken = synthesise(bundles, bundles.select("job_id", F.col("reference_audio").alias("content")), backend)
    audio = stage_files(spoken.withColumn("path", F.when(F.col("content").isNotNull(), F.col("audio_path"))), root)
    try:
        made = audio.rows()
        rate = bundles.select("job_id", F.col("output_sample_rate").alias("rate"))
        results = results_of(made).join(rate, "job_id").withColumn("sample_rate", F.col("rate"))
        documents = stage_files(result_documents(results).select("job_id", F.lit("output/synthesis_result.json").alias("path"), F.col("json").cast("binary").alias("content")), root)
    except BaseException:
        drop_staged(audio)
        raise
    place_files(audio, documents)
    return stage_results_of(made)


class FolderExchange:
    """Requests and results as documents below a folder of any store: job_id/synthesis_request.json out,
    job_id/synthesis_result.json in."""

    def __init__(self, root: str):
        self.root = root

    def export_requests(self, requests: DataFrame) -> DataFrame:
        """Writes the requests; a pending stage result per job until its result is there."""
        files = request_documents(requests).select("job_id", F.lit("synthesis_request.json").alias("path"), F.col("json").cast("binary").alias("content"))
        write_files(files, self.root)
        return submitted(requests)

    def import_results(self, spark: SparkSession) -> DataFrame:
        return read_results(spark, f"{self.root}/*/synthesis_result.json")


def submitted(requests: DataFrame) -> DataFrame:
    """What an external synthesiser leaves behind: a pending row per job, until its result comes back."""
    return requests.select("job_id", *stage_result("tts", "pending"))
