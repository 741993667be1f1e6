"""Operator 11, ranked lexical search, as a blocked product of sparse matrices in integers.

The items are a matrix of item by term (how often), the documents one of term by document (impacts in 64 bits); the
scores are their product. Items are dealt by hash into blocks of about BLOCK_PAIRS entries, and each block, with its
terms, is broadcast. A block goes twice over the documents. The first pass reads whole texts, counts a document's terms
and writes, a row per document, those of the block with their tf: the documents' matrix by rows. Sums of it give N, L
and df. The second pass reads that table in blocks of documents, turns each into a matrix by terms and merges, for each
item, the rows of its terms into a sum per document (Gustavson). What can't be among the item's best `k` so far is left
out; a task sends back k rows an item, which are cut to k per group of tasks and then per item.

Bounds: a broadcast holds a block of items (BLOCK_PAIRS entries, or a single larger item); a task holds a piece of text
(4 MB), a block of documents and k rows for each item of the block. Rounds grow with the items by BLOCK_PAIRS; each reads
all documents. Every document that shares a term with an item is scored, however common the term.

Edge cases: a null or empty text has no terms and isn't found; without any term in the documents, or in an item, no
row; rows that share item_id (null is an id) are one item with the terms of all; rows that share doc_id are documents of
their own; equal scores go by ascending doc_id, null last; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, documents, remove_path, shared_path, text_of, written
from .tokens import inside, pieces, tokens, utf8

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OF_TERM = inside(*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))
BEST, BLOCK_PAIRS, BLOCK_DOCS, TASKS = 20, 1 << 20, 8192, 256
NO_ID = np.iinfo(np.int64).max


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term, n: how often each term stands in each item."""
    found = F.regexp_extract_all(F.translate(text_of(text_col), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col(item_col).alias("item_id"), F.explode(found).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("n"))


class Items:
    """A block of items by rows: the terms of item i are terms[ptr[i]:ptr[i + 1]], each `times` so often."""

    def __init__(self, table: pa.Table):
        ids, terms = (table.column(c).combine_chunks().dictionary_encode("encode") for c in ("item_id", "term"))
        row, self.ids, self.vocabulary = ids.indices.to_numpy(), ids.dictionary, terms.dictionary.cast(pa.binary())
        order = np.argsort(row, kind="stable")
        self.terms, self.times = terms.indices.to_numpy()[order], table.column("n").to_numpy()[order]
        self.ptr = np.searchsorted(row[order], np.arange(len(self.ids) + 1))


def by_documents(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array) -> Iterator[pa.RecordBatch]:
    """For each document that has terms: their number, and those of the vocabulary with their tf."""
    size = len(vocabulary)
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        n, keys, tfs = np.zeros(batch.num_rows, np.int64), [], []
        for row, own, ends in pieces(data, offsets, OF_TERM):
            words, at = tokens(own, ends, OF_TERM)
            n[row : row + len(ends) - 1] += np.bincount(at, minlength=len(ends) - 1)
            term = pc.index_in(words, value_set=vocabulary)
            known = term.is_valid().to_numpy(zero_copy_only=False)
            key, tf = np.unique((at[known] + row) * size + pc.drop_null(term).to_numpy(), return_counts=True)
            keys.append(key)
            tfs.append(tf)
        key, tf = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*tfs, np.zeros(0, np.int64)])
        key, where = np.unique(key, return_inverse=True)  # a long text is several pieces
        tf, total = tf.astype(np.int64), np.zeros(len(key), np.int64)
        np.add.at(total, where, tf)
        kept = np.flatnonzero(n)
        ends = np.append(0, np.searchsorted(key, (kept + 1) * size)).astype(np.int32)
        yield pa.record_batch({
            "doc_id": batch.column("doc_id").take(pa.array(kept)), "n": pa.array(n[kept]),
            "terms": pa.ListArray.from_arrays(ends, pa.array((key % size).astype(np.int32))), "tfs": pa.ListArray.from_arrays(ends, pa.array(total)),
        })


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def lengths(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of each document, 25 n N in more than 64 bits where it needs them."""
    if len(n) and 25 * int(n.max()) * docs >= 1 << 63:
        return np.array([75 + 25 * x * docs // total for x in n.tolist()], np.int64)
    return 75 + 25 * n * docs // total


def by_items(batches: Iterator[pa.RecordBatch], items: Items, weights: np.ndarray, docs: int, total: int, k: int, block: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of each item among these."""
    scores = [np.zeros(0, np.int64) for _ in items.ids]
    ids = [np.zeros(0, np.int64) for _ in items.ids]
    for batch in (b.slice(at, block) for b in batches for at in range(0, b.num_rows, block)):
        name = pc.fill_null(batch.column("doc_id"), NO_ID).to_numpy()
        m = lengths(batch.column("n").to_numpy(), docs, total)
        lists = batch.column("terms")
        term, tf = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
        doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
        order = np.argsort(term, kind="stable")
        term, tf, doc = term[order], tf[order], doc[order]
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        ptr = np.append(0, np.cumsum(np.bincount(term, minlength=len(weights))))
        for i in range(len(items.ids)):
            own = slice(items.ptr[i], items.ptr[i + 1])
            first = ptr[items.terms[own]]
            many = ptr[items.terms[own] + 1] - first
            ends = np.cumsum(many)
            at = np.repeat(first - ends + many, many) + np.arange(ends[-1])
            score = np.zeros(batch.num_rows, np.int64)
            np.add.at(score, doc[at], impact[at] * np.repeat(items.times[own], many))
            least = max(1, scores[i][-1] if len(scores[i]) == k else 1)
            found = np.flatnonzero(score >= least)
            if len(found) > k:
                found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
            if len(found):
                s, d = np.append(scores[i], score[found]), np.append(ids[i], name[found])
                best = np.lexsort((d, -s))[:k]
                scores[i], ids[i] = s[best], d[best]
    many = [len(x) for x in scores]
    doc = np.concatenate(ids)
    if sum(many):
        yield pa.record_batch({
            "item_id": items.ids.take(pa.array(np.repeat(np.arange(len(many)), many))), "doc_id": pa.array(doc, mask=doc == NO_ID),
            "score": pa.array(np.concatenate(scores)), "task": pa.array(np.full(len(doc), TaskContext.get().partitionId() // TASKS, np.int32)),
        })


def ranked_search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_pairs: int = BLOCK_PAIRS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest scores of each item."""
    spark = docs.sparkSession
    pairs = written(item_terms(items, item_col, item_text), "item-terms")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(pairs.dtypes)["item_id"]
    blocks = -(-pairs.count() // block_pairs)
    found, total = None, None
    top = shared_path(spark, "best")
    for block in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast(Items(own))
        matrix = texts.mapInArrow(lambda x, sent=sent: by_documents(x, sent.value.vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>")
        at = shared_path(spark, "matrix")
        matrix.write.parquet(at)
        matrix = spark.read.schema(matrix.schema).parquet(at)
        total = total or matrix.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not total[0]:
            break
        df = matrix.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        weights = np.zeros(len(sent.value.vocabulary), np.int64)
        weights[df.column("term").to_numpy()] = [weight(total[0], x) for x in df.column("df").to_pylist()]
        best = matrix.mapInArrow(lambda x, sent=sent, weights=weights, total=tuple(total): by_items(x, sent.value, weights, *total, k, block_docs), f"item_id {kind}, doc_id long, score long, task int")
        order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        for keys in (["item_id", "task"], ["item_id"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        best.select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(top)
        remove_path(spark, at)
        found = top
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    return spark.read.schema(schema).parquet(found) if found else spark.createDataFrame([], schema)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL_TERMS = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}'))"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
t AS (SELECT row, doc_id, term, count(*) AS tf FROM (SELECT row, doc_id, {SQL_TERMS} AS term FROM d) GROUP BY ALL),
docs AS (SELECT row, doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY ALL),
total AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM docs),
m AS (SELECT row, 100 - 25 + (25 * n * nd) // l AS m FROM docs, total),
df AS (SELECT term, count(*) AS df FROM t GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {SQL_TERMS} AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, row, t.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM i JOIN t USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item_id, row, t.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {BEST}
"""
QUERIES = {"op11_lexical_search": op11_lexical_search}
SQL = {"op11_lexical_search": OP11_SQL}
