"""Operator 5, line dedup, in DataFrame functions only.

Lines are normalised, exploded and hashed to 128 bits once, into a written table of numbers; documents are counted per
hash, summed per task before the shuffle, so a very common line costs one row per task. Lines of the hashes over the
threshold are joined back: those in at least a thousandth of all counts (a thousand hashes at most) by a broadcast, so
that no task gets all rows of a line, the others by a shuffle that the adaptive skew join can split. What they lose is
gathered per document as positions; the kept slices between the positions make the new text.

Edge cases: a null or empty text is one empty line; a line's key is the line without white space at both ends and
with A-Z lower-cased; repeated rows of one id are one document; a null id counts as one document, smaller than any
other; rows of one id may have different texts, each is cut by itself; empty tables give no row; columns besides id
and text are carried through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, documents, text_of, written

MIN_CHARS, MIN_DOCS, HOT = 20, 3, 1000


def line_keys(text: Column) -> Column:
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(SPACES)))


def hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(3), key).alias("h1"), F.xxhash64(F.lit(5), key).alias("h2"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Columns: row (all columns of docs as a struct), doc_id, text (the new one), n_lines, n_dropped."""
    src = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    at = F.filter(F.transform(line_keys(F.col("text")), lambda x, i: F.struct(i.alias("pos"), x.alias("key"))), lambda s: F.char_length(s.key) >= min_chars)
    at = F.transform(at, lambda s: F.struct(s.pos.alias("pos"), hashed(s.key).alias("k")))
    lines = src.select("doc_id", "text_key", F.explode(at).alias("s")).select("doc_id", "text_key", "s.pos", "s.k.h1", "s.k.h2")
    lines = written(lines, "lines")

    each = lines.select("doc_id", "h1", "h2").distinct()
    often = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs)
    often = written(often, "often")
    heavy = F.col("n") >= max(hot, (often.agg(F.sum("n")).first()[0] or 0) // 1000)
    lines = lines.join(F.broadcast(often.where(heavy).select(*(F.col(c).alias(f"hot_{c}") for c in ("h1", "h2", "last")))), (F.col("h1") == F.col("hot_h1")) & (F.col("h2") == F.col("hot_h2")), "left")
    known = lines.where("hot_h1 is not null").select("doc_id", "text_key", "pos", F.col("hot_last").alias("last"))
    rest = lines.where("hot_h1 is null").select("doc_id", "text_key", "pos", "h1", "h2").join(often.where(~heavy).select("h1", "h2", "last"), ["h1", "h2"]).select("doc_id", "text_key", "pos", "last")
    lost = known.unionByName(rest).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
    lost = lost.groupBy(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key")).agg(F.array_sort(F.collect_set("pos")).alias("lost"))

    both = src.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_key") == F.col("lost_key")), "left")
    both = both.withColumn("lines", F.split("text", "\n")).withColumn("lost", F.coalesce("lost", F.array().cast("array<int>")))
    before = F.concat(F.array(F.lit(-1)), F.col("lost"))
    after = F.concat(F.col("lost"), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(before, after, lambda a, b: F.slice("lines", a + 2, b - a - 1)))
    new = F.when(F.size("lost") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    return both.select("row", "doc_id", new.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: Lower-casing of A-Z alone, for DuckDB.
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_KEY = SQL_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")
OP5_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line, {SQL_KEY} AS key FROM l),
c AS (SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
j AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id < c.last AS lost FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
QUERIES = {"op5_line_dedup": op5_line_dedup}
SQL = {"op5_line_dedup": OP5_SQL}
