"""Operator 10, exact dedup by two passes of a Bloom filter, in DataFrame functions only.

Rows are written once without their texts: id, length, digest of the normalised text, and a hash of 64 bits. The hashes
are divided into segments of so many rows that a segment's filter has `filter_bits` bits at most, and each segment goes
through two passes, however many there are. Pass 1 puts each row's bits into one word of 64 (a blocked filter) and sums,
per task and then per word, which bits any row set and which an even number did; a word tells from these which bits two
or more rows set (all of its bits, where some bit was set three times). Pass 2 sends that filter to the rows of its
segment: a row with a bit that no other row set has no equal, and passes straight through without a shuffle. Only the
others are grouped by their digest.

A filter is a broadcast of filter_bits / 64 words at most (2**21 by default), whatever the table's size. Rows are written
by segment, so each of the rounds (16 bits a row by filter_bits) reads its own rows, and all rounds each row twice; a cluster with more memory for broadcasts sets filter_bits
higher and has fewer. A digest with many copies is summed per task before the shuffle; groups of at least a thousandth
of all rows (a thousand of them at most) come back by a broadcast, so no task gets all copies of a text.

Edge cases: a null text is empty; texts of white space only are equal to the empty text; a null id loses against any
other of the same length; of rows that agree in id and length exactly one is kept; other columns are not looked at;
an empty table gives no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, shared_path, text_of, written

FILTER_BITS, BITS_PER_ROW, HASHES, HOT = 1 << 27, 16, 2, 1000


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def bits_of(h: Column, hashes: int) -> Column:
    """The bits of its word that a hash sets: six bits of the hash name each."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return reduce(Column.bitwiseOR, [one(i) for i in range(hashes)])


def segment_of(h: Column, segments: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 40), F.lit(segments))


def word_of(h: Column, words: int) -> Column:
    """The word of a hash, between the bits that bits_of() and segment_of() use; words is a power of two."""
    return F.pmod(F.xxhash64(h), F.lit(words))


def repeated_bits(rows: DataFrame, hashes: int, words: int) -> DataFrame:
    """Pass 1, over the column h: each word with the bits that at least two rows set."""
    own = rows.select(word_of(F.col("h"), words).alias("word"), bits_of(F.col("h"), hashes).alias("bits"))
    sums = own.groupBy("word").agg(F.bit_or("bits").alias("any"), F.bit_xor("bits").alias("odd"), F.sum(F.bit_count("bits")).alias("n"))
    even = F.col("any").bitwiseAND(F.bitwise_not("odd"))
    thrice = F.col("n") > F.bit_count("odd") + 2 * F.bit_count(even)
    return sums.select("word", F.when(thrice, F.col("any")).otherwise(even).alias("twice")).where("twice <> 0")


def probe(rows: DataFrame, repeated: DataFrame, hashes: int, words: int) -> DataFrame:
    """Pass 2: adds `maybe`, false only where a bit of the row was set by no other row."""
    rows = rows.withColumn("own_word", word_of(F.col("h"), words)).join(F.broadcast(repeated), F.col("own_word") == F.col("word"), "left")
    bits = bits_of(F.col("h"), hashes)
    return rows.withColumn("maybe", F.coalesce(F.col("twice").bitwiseAND(bits) == bits, F.lit(False))).drop("own_word", "word", "twice")


def segmented(rows: DataFrame, segments: int) -> DataFrame:
    """The rows, written in a folder per segment of their hashes h, so that a segment's passes read its rows only. More than
    one segment meet by a shuffle of these numbers, dealt so that a segment is several tasks."""
    rows = rows.withColumn("segment", segment_of(F.col("h"), segments).cast("int"))
    at = shared_path(rows.sparkSession, "digests")
    dealt = rows.repartition("segment", F.pmod(F.spark_partition_id(), F.lit(8))) if segments > 1 else rows
    dealt.write.partitionBy("segment").parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def sift(rows: DataFrame, n: int, hashes: int = HASHES, bits_per_row: int = BITS_PER_ROW, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The n rows, written with `maybe`, a segment of their hashes h at a time."""
    segments = max(1, -(-n * bits_per_row // filter_bits))
    words = 1 << max(4, (-(-n * bits_per_row // segments // 64) - 1).bit_length())
    rows, at = segmented(rows, segments), shared_path(rows.sparkSession, "sifted")
    for k in range(segments):
        own = rows.where(F.col("segment") == k).drop("segment")
        probe(own, repeated_bits(own, hashes, words), hashes, words).drop("h").write.mode("append").partitionBy("maybe").parquet(at)
    schema = ", ".join(f"{c} {t}" for c, t in rows.drop("h", "segment").dtypes)
    return rows.sparkSession.read.schema(f"{schema}, maybe boolean").parquet(at)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, **options) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 and row_id (the row's number in the run)."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).alias("length"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"), F.monotonically_increasing_id().alias("row_id"))
    n = docs.count()
    seen = sift(rows.withColumn("h", F.xxhash64("digest")), n, **options)

    def told(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row_id")

    alone = seen.where(~F.col("maybe")).withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "keep_row": F.col("row_id")})
    some = seen.where("maybe")
    best = F.min(F.struct((-F.col("length")).alias("a"), F.isnull("doc_id").alias("b"), F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row")))
    groups = written(some.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("digest", "best.keep_id", "best.keep_row", "group_size"), "groups")
    large = F.col("group_size") >= max(hot, n // 1000)
    of_large = groups.where(large).select(F.col("digest").alias("hot_digest"), *(F.col(c).alias(f"hot_{c}") for c in ("keep_id", "keep_row", "group_size")))
    some = some.join(F.broadcast(of_large), F.col("digest") == F.col("hot_digest"), "left")
    of_hot = some.where("hot_digest is not null").select("doc_id", "digest", "row_id", *(F.col(f"hot_{c}").alias(c) for c in ("keep_id", "keep_row", "group_size")))
    of_rest = some.where("hot_digest is null").select("doc_id", "digest", "row_id").join(groups.where(~large), "digest")
    return told(alone).unionByName(told(of_hot)).unionByName(told(of_rest))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("row_id")


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size,
    row_number() OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST) AS rn
  FROM n)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM w
"""
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
SQL = {"op10_exact_dedup": OP10_SQL}
