"""Quality metrics per job: one aggregation each, partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import character_error_rate, strip, word_error_rate


def mean_or_zero(x: Column) -> Column:
    """Mean of what isn't null or NaN; 0.0 of nothing."""
    return F.coalesce(F.avg(F.when(~F.isnan(x), x)), F.lit(0.0))


def hypothesis(segment_id: Column, text: Column) -> Column:
    """Stripped texts joined by spaces, in order of segments (an aggregate)."""
    rows = F.array_sort(F.collect_list(F.struct(segment_id.alias("i"), F.coalesce(text, F.lit("")).alias("t"))))
    return F.array_join(F.transform(rows, lambda s: strip(s.t)), " ")


def evaluate_transcripts(segments: DataFrame, references: DataFrame) -> DataFrame:
    """job_id, wer, cer, avg_logprob, avg_segment_duration, for every job that has a reference."""
    own = segments.groupBy("job_id").agg(hypothesis(F.col("segment_id"), F.col("text")).alias("hypothesis"), mean_or_zero(F.col("avg_logprob")).alias("avg_logprob"), mean_or_zero(F.col("end_ts") - F.col("start_ts")).alias("avg_segment_duration"))
    both = references.select("job_id", "reference").join(own, "job_id", "left").withColumn("hypothesis", F.coalesce("hypothesis", F.lit("")))
    return both.select("job_id", word_error_rate(F.col("reference"), F.col("hypothesis")).alias("wer"), character_error_rate(F.col("reference"), F.col("hypothesis")).alias("cer"), F.coalesce("avg_logprob", F.lit(0.0)).alias("avg_logprob"), F.coalesce("avg_segment_duration", F.lit(0.0)).alias("avg_segment_duration"))


def evaluate_translations(translated: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """job_id, num_segments, lengths in code points in all and in the mean, and the ratio of their sums (1.0 if there is no
    source text)."""
    s, t = F.char_length("source_text"), F.char_length("translated_text")
    own = translated.groupBy("job_id").agg(F.count(F.lit(1)).alias("num_segments"), F.sum(s).alias("total_source_chars"), F.sum(t).alias("total_target_chars"), F.avg(s).alias("avg_source_length"), F.avg(t).alias("avg_target_length"), F.expr("try_divide(sum(char_length(translated_text)), nullif(sum(char_length(source_text)), 0))").alias("expansion_ratio"))
    if jobs is not None:
        own = jobs.select("job_id").distinct().join(own, "job_id", "left")
    return own.select("job_id", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("num_segments", 0), ("total_source_chars", 0), ("total_target_chars", 0), ("avg_source_length", 0.0), ("avg_target_length", 0.0), ("expansion_ratio", 1.0))))


def stage_metrics(chunks: DataFrame, sample_rate: int = 16000, channels: int = 1) -> DataFrame:
    """Counts of chunks per job with the audio settings; time taken is measured outside of queries."""
    return chunks.groupBy("job_id").agg(F.count(F.lit(1)).alias("num_segments")).select("job_id", F.lit(sample_rate).alias("sample_rate"), F.lit(channels).alias("channels"), "num_segments")


def waveform_seconds(samples: Column, rate: int = 24000) -> Column:
    return F.size(samples) / rate


def quality_rollup(metrics: DataFrame, *keys: str, values: tuple[str, ...]) -> DataFrame:
    """Means of metrics by keys, with subtotals (an extension)."""
    return metrics.rollup(*keys).agg(F.count(F.lit(1)).alias("jobs"), *(F.avg(v).alias(v) for v in values))
