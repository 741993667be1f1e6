"""Operator 6, mixing sources to target weights, by Sainte-Lague apportionment of equal-token blocks.

The words of a source are a stream of its documents, dealt by a hash of id and text into shards (65,536 and one per
source at most, whatever the size; rows that share an id or have none are spread) and cut into blocks of equal numbers
of words, a 131,072nd of all words or, for small sources, a 128th of the source's target (16 words at least), so that each
comes within a hundredth of its target or 32 words of it, however many sources there are. Blocks are seats: highest quotients give
each source its quota, and again each shard of the source its own. In a shard, the blocks with the smallest seeded
hashes are taken once more than the others. The driver sees sources and shards; documents and blocks stay
distributed, and a source with a third of all rows is many shards. The tables of sources and of shards are broadcast up
to `SENT` rows, and joined by a shuffle beyond.

Edge cases: size is the number of words, a null text has none; documents without words are taken 0 times; sources are
ordered by code point, null last; a source without words has target 0; repeated rows are rows of their own; an empty
table gives no row; other columns are carried by mixed_documents() and ignored by the rest.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, shared_path, text_of, words_in

WEIGHTS, SHARE, MOST = (5, 2, 1), Fraction(3, 2), 2
BLOCKS, FINE, LEAST_BLOCK, SHARD_WORDS, SHARDS, SENT = 1 << 17, 128, 16, 1 << 18, 1 << 16, 200_000


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, most: int = MOST) -> list[float]:
    """Words for each source: by weight, at most `most` times its size, what is above going to the others by weight."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] >= most * sizes[i] * total}
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ -= above
        left = max(left, Fraction(0))
    return [float(x) for x in out]


def apportion(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Sainte-Lague: seats by the highest quotients votes / (2 s + 1), no one above its cap; ties go to the first."""
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    got = lambda d: np.where(votes > 0, np.minimum(caps, np.floor(votes / d + 0.5)), 0).astype(np.int64)
    if seats <= 0 or not (votes > 0).any():
        return np.zeros(len(votes), np.int64)
    low, high = votes[votes > 0].min() / (2 * caps.max() + 3), 2 * votes.max() + 1
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if got(mid).sum() > seats else (low, mid)
    out = got(high)
    heap = [(-votes[i] / (2 * out[i] + 1), i) for i in np.flatnonzero((out < caps) & (votes > 0))]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def mix_rows(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: int = 17, shard_words: int = SHARD_WORDS, sent: int = SENT) -> DataFrame:
    """From row_id, doc_id, source, size, h (a hash of the text): the first four with source_size, target, taken and pieces (from, to, times: word numbers in the document)."""
    spark = rows.sparkSession
    sources = sorted(((r.source, r.words) for r in rows.groupBy("source").agg(F.sum("size").alias("words")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [int(x[1] or 0) for x in sources]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    total = sum(sizes)
    per_shard = max(shard_words, total // SHARDS)
    block = np.array([max(LEAST_BLOCK, min(total // BLOCKS, int(g) // FINE)) for g in goal], np.int64)
    side = lambda df, n: F.broadcast(df) if n <= sent else df
    table = pa.table({"s_source": pa.array([x[0] for x in sources], pa.string()), "no": pa.array(range(len(sources)), pa.int32()), "source_size": pa.array(sizes, pa.int64()), "target": pa.array(goal, pa.float64()), "n_shards": pa.array([-(-s // per_shard) or 1 for s in sizes], pa.int64())})
    rows = rows.join(side(spark.createDataFrame(table), len(sources)), F.col("source").eqNullSafe(F.col("s_source")), "left").drop("s_source")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h"), F.col("n_shards")))

    shards = rows.groupBy("no", "shard").agg(F.sum("size").alias("words")).where("words > 0").collect()
    shards.sort(key=lambda r: (r.no, r.shard))
    no, words = np.array([r.no for r in shards], np.int64), np.array([r.words for r in shards], np.int64)
    blocks = np.maximum(1, np.rint(words / block[no]).astype(np.int64))
    of_source = np.bincount(no, blocks, len(sources)).astype(np.int64)
    votes = np.array([g * n / s if s else 0.0 for g, s, n in zip(goal, sizes, of_source, strict=True)])
    quota = apportion(votes, int(np.rint(votes.sum())), most * of_source)
    quotas = np.minimum(quota[no], most * blocks)
    for i in np.flatnonzero(np.bincount(no, minlength=len(sources)) > 1).tolist():
        at = slice(*np.searchsorted(no, [i, i + 1]))
        quotas[at] = apportion(blocks[at], int(quota[i]), most * blocks[at])

    plan = spark.createDataFrame(pa.table({"b_no": pa.array(no, pa.int32()), "b_shard": pa.array([r.shard for r in shards], pa.int64()), "words": words, "blocks": blocks, "quota": quotas}))
    each = plan.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rank = F.row_number().over(Window.partitionBy("b_no", "b_shard").orderBy(F.xxhash64(F.lit(seed), "b_no", "b_shard", "block"), "block"))
    times = F.expr("quota div blocks") + F.when(rank <= F.col("quota") % F.col("blocks"), 1).otherwise(0)
    each = each.select("b_no", "b_shard", "block", F.expr("block * words div blocks").alias("b_from"), F.expr("(block + 1) * words div blocks").alias("b_to"), times.alias("times"))

    upto = Window.partitionBy("no", "shard").orderBy("doc_id", "h", "row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum("size").over(upto)).withColumn("start", F.col("end") - F.col("size"))
    sized = side(plan.select(F.col("b_no").alias("p_no"), F.col("b_shard").alias("p_shard"), "words", "blocks"), len(shards))
    in_blocks = rows.where("size > 0").join(sized, (F.col("no") == F.col("p_no")) & (F.col("shard") == F.col("p_shard")))
    in_blocks = in_blocks.withColumn("block", F.explode(F.expr("sequence(((start + 1) * blocks - 1) div words, (end * blocks - 1) div words)")))
    cutting = in_blocks.drop("words", "blocks").join(each.withColumnRenamed("block", "b_block"), (F.col("no") == F.col("b_no")) & (F.col("shard") == F.col("b_shard")) & (F.col("block") == F.col("b_block")))
    piece = F.struct((F.greatest("start", "b_from") - F.col("start")).alias("from"), (F.least("end", "b_to") - F.col("start")).alias("to"), F.col("times").cast("int").alias("times"))
    keys = ["row_id", "doc_id", "source", "size", "source_size", "target"]
    told = cutting.withColumn("piece", piece).groupBy(*keys).agg(F.sum((F.col("piece.to") - F.col("piece.from")) * F.col("times")).cast("long").alias("taken"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    none = rows.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.expr("cast(array() as array<struct<from:bigint,to:bigint,times:int>>)").alias("pieces"))
    return told.unionByName(none)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """What the mix takes of each row of docs; see mix_rows()."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(text_of(text_col)).alias("size"), F.xxhash64(text_of(text_col)).alias("h")).withColumn("row_id", F.monotonically_increasing_id())
    return mix_rows(cut(rows), **options)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of docs: each document once for its words that are taken at least once and again
    for those taken twice. A text that is taken whole stays as it is; of others the taken words stay, each with the white
    space behind it. n_chars, where docs has it, is counted anew."""
    spark, at = docs.sparkSession, shared_path(docs.sparkSession, "mix")
    docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_id")).write.parquet(at)
    kept = spark.read.parquet(at)
    rows = kept.select("row_id", F.col(f"row.{id_col}").alias("doc_id"), F.col(f"row.{source_col}").alias("source"), words_in(text_of(F.col(f"row.{text_col}"))).alias("size"), F.xxhash64(text_of(F.col(f"row.{text_col}"))).alias("h"))
    took = mix_rows(cut(rows), **options).where("taken > 0").select(F.col("row_id").alias("t_id"), "size", "pieces")
    both = kept.join(took, F.col("row_id") == F.col("t_id"))
    most = F.array_max(F.transform("pieces", lambda p: p.times))
    both = both.withColumn("copy", F.explode(F.sequence(F.lit(1), most)))
    parts = F.filter("pieces", lambda p: p.times >= F.col("copy"))
    both = both.withColumn("parts", parts)
    words = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p.to - p["from"])
    units = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    both = both.withColumn("units", F.when(words < F.col("size"), units))
    cut_text = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice("units", (p["from"] + 1).cast("int"), (p.to - p["from"]).cast("int")))), "")
    both = both.withColumn("new", F.when(F.col("units").isNull(), F.col(f"row.{text_col}")).otherwise(cut_text))
    new = {text_col: F.col("new"), "n_chars": F.char_length("new").cast("long")}
    return both.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op6_mixing": op6_mixing}
SQL: dict[str, str] = {}
