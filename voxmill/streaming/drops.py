"""Streams (an extension): rows that arrive in a drop folder, aggregated with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import TRANSLATED_SEGMENT, schema


def translated_drops(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Translated segments from JSON-lines files as they are dropped into a folder."""
    return spark.readStream.schema(schema(TRANSLATED_SEGMENT)).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def running_translation_metrics(rows: DataFrame) -> DataFrame:
    """Counts and length ratio per job so far (output mode update or complete); state is one row per job."""
    source, target = F.sum(F.char_length("source_text")), F.sum(F.char_length("translated_text"))
    out = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("num_segments"), source.alias("source_chars"), target.alias("target_chars"))
    return out.withColumn("expansion_ratio", F.coalesce(F.col("target_chars") / F.nullif(F.col("source_chars"), F.lit(0)), F.lit(1.0)))


def activity_sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Stretches of activity with less than `gap` between events, the streaming cousin of speech between silences."""
    window = F.session_window(F.col(time), gap)
    out = events.withWatermark(time, late).groupBy(F.col(key), window).agg(F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "events")
