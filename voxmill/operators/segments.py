"""Intervals of speech and silence.

Nested forms take one row per job with its silences as an array and need no shuffle; flat forms take one row per
silence and shuffle once, on the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_name

MIN_SEGMENT, WINDOW_SECONDS, OVERLAP_SECONDS = 0.25, 30.0, 1.0
NOISE_DB, MIN_SILENCE = -30.0, 0.5


def bind(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def interval(start: Column, end: Column) -> Column:
    return F.struct(start.cast("double").alias("start"), end.cast("double").alias("end"))


def speech_between(silences: Column, total: Column, least: float = MIN_SEGMENT) -> Column:
    """What is left between silences, taken in their given order: each stretch from the end of the silence before, if
    it lasts `least` seconds. silences: array of (start, end); null means none."""
    silences = F.coalesce(silences, F.array().cast("array<struct<start:double,end:double>>"))
    starts = F.concat(F.array(F.lit(0.0)), F.transform(silences, lambda s: s.end))
    ends = F.concat(F.transform(silences, lambda s: s.start), F.array(total.cast("double")))
    return F.filter(F.zip_with(starts, ends, interval), lambda s: s.end - s.start >= least)


def speech_between_rows(rows: DataFrame, job: str, start: str, end: str, order: list[str], total) -> DataFrame:
    """The flat form: from a row per silence, a row (job, start_ts, end_ts) per stretch. total: a function of
    the job's window. A job's rows are sorted and spilled, never gathered into one value."""
    own = Window.partitionBy(job).orderBy(*order)
    whole = Window.partitionBy(job)
    rows = rows.select(job, *dict.fromkeys([start, end, *order]), total(whole).alias("_total"))
    rows = rows.select(job, F.lag(end, 1, 0.0).over(own).alias("_from"), start, end, "_total", F.lead(F.lit(1)).over(own).isNull().alias("_last"))
    gap, tail = interval(F.col("_from"), F.col(start)), interval(F.col(end), F.col("_total"))
    found = F.filter(F.when(F.col("_last"), F.array(gap, tail)).otherwise(F.array(gap)), lambda s: s.end - s.start >= MIN_SEGMENT)
    return rows.select(job, F.explode(found).alias("s")).select(job, F.col("s.start").alias("start_ts"), F.col("s.end").alias("end_ts"))


def fixed_windows(total: Column, size: float = WINDOW_SECONDS, overlap: float = OVERLAP_SECONDS) -> Column:
    """Windows of `size` seconds that overlap, up to the first that reaches the total; none for a total of 0 or less."""
    hop, total = size - overlap, total.cast("double")
    count = F.greatest(F.ceil((total - size) / hop), F.lit(0)) + 1
    every = F.transform(F.sequence(F.lit(0).cast("long"), count), lambda i: interval(i * hop, F.least(i * hop + size, total)))
    kept = F.filter(every, lambda s, i: (i == 0) | ((i - 1) * hop + size < total))
    return F.when(total > 0, kept).otherwise(F.array().cast("array<struct<start:double,end:double>>"))


def segments_or_windows(silences: Column, total: Column) -> Column:
    """Speech between silences, or fixed windows where there is none."""
    found = speech_between(silences, total)
    return F.when(F.size(found) > 0, found).otherwise(fixed_windows(total))


def silent_runs(rows: DataFrame, frame: str, samples: str, below: float, least: int) -> DataFrame:
    """Runs of at least `least` samples with an absolute value under `below`: (frame, start_pos, end_pos), the end
    exclusive. The run ends are found in the array itself: no shuffle."""
    x = F.col(samples)
    rows = rows.select(frame, F.transform(x, lambda v: F.coalesce(F.abs(v) < below, F.lit(False))).alias("q"))

    def runs_of(q: Column) -> Column:
        starts = F.filter(F.transform(q, lambda v, i: F.when(v & ~F.coalesce(F.get(q, i - 1), F.lit(False)), i)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(q, lambda v, i: F.when(v & ~F.coalesce(F.get(q, i + 1), F.lit(False)), i + 1)), lambda i: i.isNotNull())
        return F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start_pos"), b.alias("end_pos"))), lambda s: s.end_pos - s.start_pos >= least)

    return rows.select(frame, F.explode(bind(F.col("q"), runs_of)).alias("s")).select(frame, "s.start_pos", "s.end_pos")


def silences_from_samples(samples: Column, rate: int, noise_db: float = NOISE_DB, seconds: float = MIN_SILENCE, full_scale: float = 32768.0) -> Column:
    """Silences, in seconds, of an array of PCM samples: quieter than noise_db for at least `seconds`. Runs lie
    between the places where loud and quiet change."""
    limit, least = full_scale * 10 ** (noise_db / 20), max(1, round(seconds * rate))
    quiet = F.transform(samples, lambda v: F.abs(v.cast("double")) < limit)
    none = F.array(F.lit(False))

    def edges_of(q: Column) -> Column:
        changed = F.zip_with(F.concat(none, q), F.concat(q, none), lambda a, b: a != b)
        return F.filter(F.transform(changed, lambda e, i: F.when(e, i)), lambda i: i.isNotNull())

    def runs_of(e: Column) -> Column:
        count = (F.size(e) / 2).cast("int")
        every = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.struct(F.get(e, k * 2).alias("a"), F.get(e, k * 2 + 1).alias("b")))
        return F.transform(F.filter(every, lambda p: p.b - p.a >= least), lambda p: interval(p.a / rate, p.b / rate))

    return bind(bind(quiet, edges_of), runs_of)


def silences_from_log(log: Column) -> Column:
    """Silences that a detector's log reports. Starts and ends pair up by position, to the shorter list; a negative
    start, which the detector prints for silence at the very beginning, counts as 0."""
    number = r"(-?[0-9.]+)"
    starts = F.transform(F.regexp_extract_all(log, F.lit(r"silence_start:\s*" + number), F.lit(1)), lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    ends = F.transform(F.regexp_extract_all(log, F.lit(r"silence_end:\s*" + number), F.lit(1)), lambda x: x.cast("double"))
    n = F.least(F.size(starts), F.size(ends))
    return F.zip_with(F.slice(starts, F.lit(1), n), F.slice(ends, F.lit(1), n), interval)


def manifest_rows(segments: DataFrame, job: str = "job_id") -> DataFrame:
    """Numbers a job's segments from 0 by time and names their chunks."""
    own = Window.partitionBy(job).orderBy("start_ts", "end_ts")
    rows = segments.select(job, "start_ts", "end_ts", (F.row_number().over(own) - 1).cast("long").alias("chunk_id"))
    return rows.select(job, "chunk_id", chunk_name(F.col("chunk_id")).alias("chunk_path"), "start_ts", "end_ts")


def paired(paths: Column, segments: Column) -> Column:
    """Manifest entries of chunk paths and intervals, by position, to the shorter list."""
    n = F.least(F.size(paths), F.size(segments))
    return F.zip_with(F.slice(paths, F.lit(1), n), F.slice(segments, F.lit(1), n), lambda p, s: F.struct(p.alias("chunk_path"), s.start.alias("start_ts"), s.end.alias("end_ts")))
