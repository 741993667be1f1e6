"""The corpus pipeline: documents go through five of the operators, each stage on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and
reads again. All but the last return the columns of documents: toxicity removes the documents it rejects; line dedup
removes repeated lines from texts (n_chars is counted anew); near-dedup keeps one document of each group; mixing gives
each source's words as often as its target asks, a document that is taken twice being two rows; encoding ends with
the ids of each row's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm.bpe import digests, encode_documents
from voxmill.llm.common import remove_path, shared_path
from voxmill.llm.line_dedup import dedup_lines
from voxmill.llm.minhash_dedup import drop_near_duplicates
from voxmill.llm.mixing import mixed_documents
from voxmill.llm.toxicity import clean_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a network trained on the labels of documents that aren't held out."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share, except in the last that holds them."""
    out = dedup_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("text")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles), and all without words."""
    return drop_near_duplicates(docs, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each source by its target weight."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, and the digests of the ids and of the bytes decoded from them."""
    encoded = encode_documents(docs, keep=("doc_id", "source"))
    return digests(encoded, more=("source", "ids"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("mixing", mixing), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        at = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(at), at
    return docs


#: No SQL can express the trained network or the seeded blocks. tests/llm holds each stage against brute force on the rows
#: that the stage before it wrote.
ORACLE_SQL = None
