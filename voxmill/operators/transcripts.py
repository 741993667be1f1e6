"""Recognised chunks to transcripts, translations and synthesis requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_name, language_tag, prompt

SAMPLE_RATE = 24000


def assemble(recognised: DataFrame) -> DataFrame:
    """Transcript segments of recognised chunks (job_id, chunk_id, chunk_start, segments): times count from the start of
    the media, segment_id runs densely through a job, in order of chunk and place; texts stay as they are."""
    rows = recognised.select("job_id", "chunk_id", "chunk_start", F.posexplode("segments").alias("pos", "s"))
    own = Window.partitionBy("job_id").orderBy("chunk_id", "pos")
    fields = set(recognised.schema["segments"].dataType.elementType.fieldNames())
    extra = [F.col(f"s.{n}").cast("double").alias(n) if n in fields else F.lit(None).cast("double").alias(n) for n in ("avg_logprob", "no_speech_prob", "compression_ratio")]
    return rows.select("job_id", (F.row_number().over(own) - 1).cast("long").alias("segment_id"), F.col("chunk_id").cast("long").alias("chunk_id"), (F.col("chunk_start") + F.col("s.start")).alias("start_ts"), (F.col("chunk_start") + F.col("s.end")).alias("end_ts"), F.col("s.text").alias("text"), *extra)


def job_languages(chunks: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """Language and probability of each job's first chunk that could be heard; "unknown" and 0.0 where there is none."""
    heard = F.col("error").isNull() if "error" in chunks.columns else F.lit(True)
    first = chunks.groupBy("job_id").agg(F.min_by(F.struct("language", "language_probability"), F.when(heard, F.col("chunk_id"))).alias("f"))
    out = first if jobs is None else jobs.select("job_id").distinct().join(first, "job_id", "left")
    return out.select("job_id", F.coalesce("f.language", F.lit("unknown")).alias("language"), F.coalesce("f.language_probability", F.lit(0.0)).alias("language_probability"))


def translate(segments: DataFrame, languages: DataFrame, target: str, backend) -> DataFrame:
    """Translated segments; the source language is the one that was detected. backend: a TranslationBackend."""
    rows = segments.join(languages.select("job_id", F.col("language").alias("source_language")), "job_id").withColumn("target_language", F.lit(target))
    rows = rows.withColumn("translated_text", backend.column(prompt(F.col("source_language"), F.col("target_language"), F.col("text")), F.col("text"), language_tag(F.col("source_language")), language_tag(F.col("target_language"))))
    return rows.select("job_id", "segment_id", "chunk_id", "start_ts", "end_ts", F.col("text").alias("source_text"), "translated_text", "source_language", "target_language")


def synthesis_requests(translated: DataFrame, reference_audio: str, sample_rate: int = SAMPLE_RATE) -> DataFrame:
    """One request per job: language is the target's, segments in order."""
    segment = F.struct("segment_id", "chunk_id", "start_ts", "end_ts", F.col("translated_text").alias("text"), F.lit(reference_audio).alias("reference_audio"))
    out = translated.groupBy("job_id").agg(F.first("target_language", ignorenulls=True).alias("language"), F.array_sort(F.collect_list(segment)).alias("segments"))
    return out.select("job_id", "language", F.lit(sample_rate).cast("long").alias("output_sample_rate"), "segments")


def output_names(segments: DataFrame, by_segment: bool = True) -> DataFrame:
    """Names of synthesised files. Chunk names alone collide where a chunk has several segments; segment names don't."""
    name = F.format_string("chunk_%04d_seg_%06d.wav", "chunk_id", "segment_id") if by_segment else chunk_name(F.col("chunk_id"))
    return segments.withColumn("audio_name", name)


def colliding_outputs(segments: DataFrame) -> DataFrame:
    """Chunks whose segments would overwrite each other's file under chunk names."""
    named = output_names(segments, by_segment=False)
    return named.groupBy("job_id", "chunk_id", "audio_name").agg(F.count(F.lit(1)).alias("n_segments")).where("n_segments > 1")


def missing_outputs(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Segments that were requested and haven't come back: (job_id, segment_id)."""
    asked = requests.select("job_id", F.explode("segments").alias("s")).select("job_id", "s.segment_id")
    got = results.select("job_id", F.explode("segments").alias("s")).select("job_id", "s.segment_id")
    return asked.join(got, ["job_id", "segment_id"], "left_anti")
