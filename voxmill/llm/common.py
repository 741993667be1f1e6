"""What the operators of this subpackage share: word and space rules, lineage cuts and shared folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one where it is unset (tests)."""
    sc = spark.sparkContext
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    have = sc.getCheckpointDir()
    if not have:
        if not wanted and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not wanted:
            delete_at_end(spark, own := tempfile.mkdtemp(prefix="voxmill-checkpoints-"))
        sc.setCheckpointDir(wanted or own)
        have = sc.getCheckpointDir()
    return wanted or have


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and goes on from there, so a lost executor repeats one step only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_roots: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder in the shared one, which goes when the application ends."""
    key = spark.sparkContext.applicationId
    if key not in _roots:
        _roots[key] = f"{shared_dir(spark).rstrip('/')}/voxmill-{uuid.uuid4().hex}"
        delete_at_end(spark, _roots[key])
    return f"{_roots[key]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, of which later steps read the columns they need."""
    at = shared_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Makes the folder, in whatever store it is, and has it deleted when the driver's JVM ends."""
    fs, at = _file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else: lower() where the text is ASCII, else one pass of translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_of(column: Column | str) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_in(text: Column) -> Column:
    """Number of runs without white space."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def small_batches(spark: SparkSession) -> None:
    """Rows of texts are large: Arrow batches of 2,000 of them for the session, unless it has a size of its own."""
    if spark.conf.get(BATCH_KEY) == "10000":  # the default
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
