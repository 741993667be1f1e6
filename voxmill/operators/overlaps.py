"""Words that overlapping windows hear twice.

Fixed windows overlap, so what is said in an overlap is recognised by both. Of two neighbours, the longest run of words
that ends the first and begins the second, within the time that they share, was heard twice; the second hearing goes.
A job's windows are sorted, each seeing the last words of the one before it only: one shuffle, no array of a whole job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, words
from .segments import bind

WORD = "array<struct<word:string,start:double,end:double>>"


def timed_words(text: Column, start: Column, end: Column) -> Column:
    """A segment's words with times spread evenly over it."""
    def spread(w: Column) -> Column:
        step = (end - start) / F.greatest(F.size(w), F.lit(1))
        return F.transform(w, lambda x, i: F.struct(x.alias("word"), (start + i * step).alias("start"), (start + (i + 1) * step).alias("end")))

    return bind(words(text), spread).cast(WORD)


def same_words(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same words, whatever their case and times."""
    of = lambda x: F.transform(x, lambda w: F.lower(strip(w.word)))
    return of(a) == of(b)


def repeated(tail: Column, head: Column) -> Column:
    """The length of the longest run that ends `tail` and begins `head`."""
    lengths = F.filter(F.sequence(F.lit(0), F.least(F.size(tail), F.size(head))), lambda k: k > 0)
    return F.aggregate(lengths, F.lit(0), lambda best, k: F.when(same_words(F.slice(tail, F.size(tail) - k + 1, k), F.slice(head, F.lit(1), k)), k).otherwise(best))


def heard_once(windows: DataFrame, job: str = "job_id", order: str = "chunk_id", tolerance: float = 0.0) -> DataFrame:
    """windows: job, order, start_ts, end_ts, words (see WORD, in order); the same with n_repeated, and without the words
    that the window before has. Words count as shared where they lie in both windows, give or take `tolerance` seconds.
    A window without words repeats nothing; one that doesn't overlap the one before keeps all."""
    own = Window.partitionBy(job).orderBy(order)
    heard = F.coalesce("words", F.array().cast(WORD))
    rows = windows.withColumns({"words": heard, "_until": F.lag("end_ts").over(own), "_next": F.lead("start_ts").over(own)})
    rows = rows.withColumn("_tail", F.filter("words", lambda w: w.start >= F.col("_next") - tolerance))
    rows = rows.withColumn("_before", F.coalesce(F.lag("_tail").over(own), F.array().cast(WORD)))
    head = F.filter("words", lambda w: w.end <= F.col("_until") + tolerance)
    rows = rows.withColumn("n_repeated", F.when(F.col("_until") > F.col("start_ts"), repeated(F.col("_before"), head)).otherwise(0))
    kept = F.slice("words", F.col("n_repeated") + 1, F.greatest(F.size("words"), F.lit(1)))
    return rows.withColumn("words", kept).drop("_until", "_next", "_tail", "_before")
