"""Which inputs go on, and which are refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schemas import valid_status


INVALID = "Input validation failed."


def audio_streams(streams: Column) -> Column:
    return F.filter(streams, lambda s: s.codec_type == "audio")


def is_valid_media(size: Column, streams: Column, duration: Column) -> Column:
    """Present and not empty, with an audio stream and a duration above 0. A null size is a missing file, null streams
    a failed probe; a duration that is missing or no number counts as 0."""
    has_audio = F.coalesce(F.exists(streams, lambda s: s.codec_type == "audio"), F.lit(False))
    return (F.coalesce(size, F.lit(0)) > 0) & has_audio & (F.coalesce(duration.try_cast("double"), F.lit(0.0)) > 0)


def split_valid(probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and a FAILED stage result for each of the others."""
    ok = is_valid_media(F.col("size"), F.col("streams"), F.col("duration"))
    refused = probes.where(~ok).select("job_id", *stage_result("preprocess", "failed", error=F.lit(INVALID)))
    return probes.where(ok), refused


def stage_result(stage: str, status: Column | str, output: Column | None = None, metrics: Column | None = None, error: Column | None = None, attempt: Column | int = 1) -> list[Column]:
    """Columns of a stage result."""
    none = F.lit(None)
    return [
        F.lit(stage).alias("stage_name"), valid_status(F.lit(status)).alias("status"), (none if output is None else output).cast("string").alias("output_path"),
        (F.create_map().cast("map<string,double>") if metrics is None else metrics.cast("map<string,double>")).alias("metrics"), (none if error is None else error).cast("string").alias("error"),
        (F.lit(attempt) if isinstance(attempt, int) else attempt).cast("int").alias("attempt"),
    ]


def missing_files(bundles: DataFrame, files: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(job_id, file) for each required file that a job's bundle lacks. files: job_id, file."""
    wanted = bundles.select("job_id").distinct().select("job_id", F.explode(F.array(*map(F.lit, required))).alias("file"))
    return wanted.join(files.select("job_id", "file").distinct(), ["job_id", "file"], "left_anti")


def is_version(version: Column, wanted: str = "1.0") -> Column:
    """Whether the version is the wanted one; a missing one isn't."""
    return F.coalesce(version == wanted, F.lit(False))


def unsupported(version: Column) -> Column:
    """What is said of a version that isn't the wanted one."""
    return F.concat(F.lit("Unsupported bundle version: "), F.coalesce(version, F.lit("None")))


def version_checked(version: Column, wanted: str = "1.0") -> Column:
    """The version, or an error if it isn't the wanted one or is missing."""
    return F.when(is_version(version, wanted), version).otherwise(F.raise_error(unsupported(version)))
