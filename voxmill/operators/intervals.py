"""Joins of intervals by overlap, as an equi-join over bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels are powers of two. From TOP on, and for ends that are infinite, there is one bin for all.
TOP = 100
DIGITS = 52
MOST_SALTS = 256


def _level(start: Column, end: Column) -> Column:
    """The level whose bins are as wide as the interval at least, and wide enough for their numbers to be exact."""
    start, end = start.cast("double"), end.cast("double")
    largest = F.greatest(F.abs(start), F.abs(end))
    infinite = largest == float("inf")
    power = lambda x: F.when(x > 0, F.ceil(F.log2(x))).otherwise(-1000)
    finite = F.greatest(power(F.when(~infinite, end - start)), power(F.when(~infinite, largest)) - DIGITS)
    return F.when(infinite, TOP).otherwise(F.least(finite, F.lit(TOP))).cast("int")


def _bin(x: Column, level: Column) -> Column:
    return F.when(level < TOP, F.floor(x.cast("double") / F.pow(F.lit(2.0), level.cast("double")))).otherwise(0).cast("long")


def _rows(df: DataFrame, name: str, keys: list[str], interval: tuple[str, str]) -> DataFrame:
    start, end = interval
    numbers = F.col(start).isNotNull() & F.col(end).isNotNull() & ~F.isnan(F.col(start).cast("double")) & ~F.isnan(F.col(end).cast("double"))
    rows = df.where(numbers & (F.col(start) <= F.col(end)))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.select(F.struct(*df.columns).alias(name), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(start).alias("_start"), F.col(end).alias("_end"), _level(F.col(start), F.col(end)).alias("_own"))


def _levels(rows: DataFrame) -> dict[int, int]:
    """Rows by level: some 150 numbers at most, for any table."""
    return {r["_own"]: r["count"] for r in rows.groupBy("_own").count().collect()}


def _places(own: dict[int, int], other: dict[int, int], strictly: bool, partitions: int) -> dict[int, int]:
    """Salts of each level of `own`: as many as the other side's rows at and below the level are more than its own there, so
    that copies of the few wide intervals never outnumber the rows they meet."""
    below = lambda level: sum(n for k, n in other.items() if k < level or (k == level and not strictly))
    return {level: max(1, min(below(level) // n, partitions, MOST_SALTS)) for level, n in own.items()}


def _table(values: dict[int, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv)) if values else F.create_map().cast("map<int,int>")


def _dealt(rows: DataFrame, name: str, wide_side: int, own: dict[int, int], other: dict[int, int], strictly: bool) -> DataFrame:
    """A row per place where an interval may meet others: its own level's bins, copied to all salts; and the bins of all
    levels above (or at) its own that the other side's intervals have, in one salt."""
    salts, theirs = _table(own), _table(other)
    above = F.filter(F.array(*map(F.lit, sorted(other))).cast("array<int>"), lambda x: (x > F.col("_own")) if strictly else (x >= F.col("_own")))
    hashed = F.pmod(F.xxhash64(name), F.lit(2**31)).cast("int")
    wide = F.transform(F.sequence(F.lit(0), F.element_at(salts, F.col("_own")) - 1), lambda s: F.struct(F.lit(wide_side).alias("kind"), F.col("_own").alias("level"), s.alias("salt")))
    narrow = F.transform(above, lambda x: F.struct(F.lit(1 - wide_side).alias("kind"), x.alias("level"), F.pmod(hashed, F.element_at(theirs, x)).alias("salt")))
    keys = [c for c in rows.columns if c.startswith("_k")]
    out = rows.select(name, *keys, "_start", "_end", F.explode(F.concat(wide, narrow)).alias("_at"))
    bins = F.sequence(_bin(F.col("_start"), F.col("_at.level")), _bin(F.col("_end"), F.col("_at.level")))
    return out.select(name, *keys, "_start", "_end", "_at", F.explode(bins).alias("_bin"))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], left_interval: tuple[str, str] = ("start_ts", "end_ts"), right_interval: tuple[str, str] = ("start_ts", "end_ts")) -> DataFrame:
    """Pairs of rows (structs `left` and `right`) with equal keys whose intervals overlap: each starts before the other
    ends. Intervals are pairs of numbers, the end outside; a point overlaps what it lies inside of. Null keys, intervals
    with a null or NaN end, and ends before their starts overlap with nothing; infinite ends are allowed; equal rows
    each have their pairs.

    An interval has a level, the power of two that is as wide as it is, where it covers two bins at most (three by
    rounding). Two intervals meet at the higher of their levels, in the bin where their overlap starts, so each pair is
    found once and by an equi-join. A row is dealt once for each level of the other side above its own. A few wide
    intervals that meet many narrow ones are copied to salts, among which the narrow ones are dealt by a digest of the row.
    """
    a, b = _rows(left, "left", keys, left_interval), _rows(right, "right", keys, right_interval)
    na, nb = _levels(a), _levels(b)
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # kind 0: the left interval is the wider one, or as wide; kind 1: the right one is wider
    wide_a, wide_b = _places(na, nb, False, partitions), _places(nb, na, True, partitions)
    a = _dealt(a, "left", 0, wide_a, wide_b, strictly=True)
    b = _dealt(b, "right", 1, wide_b, wide_a, strictly=False)
    on = [*(c for c in a.columns if c.startswith("_k")), "_at", "_bin"]
    b = b.withColumnsRenamed({"_start": "_start2", "_end": "_end2"})
    late = F.greatest(F.col("_start").cast("double"), F.col("_start2").cast("double"))
    met = (F.col("_start") < F.col("_end2")) & (F.col("_start2") < F.col("_end")) & (F.col("_bin") == _bin(late, F.col("_at.level")))
    return a.join(b, on).where(met).select("left", "right")


def labelled(segments: DataFrame, chunks: DataFrame, labels: tuple[str, ...] = ("speaker", "language")) -> DataFrame:
    """Segments (job_id, segment_id, start_ts, end_ts, ...) with the labels of the chunk they overlap longest (of equals the
    earliest, then the one with the smallest chunk_id), null where there is none. job_id and segment_id name a segment."""
    own = ("job_id", "segment_id", "start_ts", "end_ts")
    pairs = overlap_join(segments.select(*own), chunks.select("job_id", "chunk_id", "start_ts", "end_ts", *labels), ["job_id"])
    shared = F.least("left.end_ts", "right.end_ts") - F.greatest("left.start_ts", "right.start_ts")
    rank = F.struct(-shared, F.col("right.start_ts"), F.col("right.chunk_id"))
    best = pairs.groupBy("left.job_id", "left.segment_id").agg(F.min_by(F.struct(*(f"right.{c}" for c in labels)), rank).alias("_best"))
    rows = segments.drop(*labels).join(best, ["job_id", "segment_id"], "left")
    return rows.select(*(c for c in segments.columns if c not in labels), *(F.col(f"_best.{c}").alias(c) for c in labels))
