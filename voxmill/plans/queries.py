"""Queries over the test tables, one or more for each operation, and the same in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.schemas import SYNTHESIS_REQUEST, parsed
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators import overlaps as O
from ..operators import segments as S
from ..operators import transcripts as R
from ..operators import validation as V
from ..sources import bundles as D
from ..sources import recordings as G
from ..sources.filesink import write_files
from ..sources.media import read_pcm, wav_bytes
from ..sources.shared import work_folder
from ..streaming import attempts as A
from . import backends as B
from . import chain as C
from . import stages as P

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}|{SPACE}$', '', 'g')"


# -- tables as jobs -----------------------------------------------------------------------------------------------

START = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) / 1000000"
SQL_EVENTS = "SELECT user_id AS job_id, event_id, (epoch_us(ts::TIMESTAMP) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000 AS s, (epoch_us(ts::TIMESTAMP) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000 + value AS e FROM events"


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as silences of their users' recordings."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS job_id", "event_id", f"{START} AS s", f"{START} + value AS e")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("chunk_id"), "role", F.coalesce("text", F.lit("")).alias("text"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next of its conversation."""
    own = Window.partitionBy("job_id").orderBy("chunk_id", "role", "text")
    return turns(spark, sf_dir).withColumn("next_text", F.lead("text").over(own)).where("next_text is not null")


SQL_PAIRS = "SELECT conv_id AS job_id, turn AS chunk_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) AS next_text FROM conversations"


# -- validation ---------------------------------------------------------------------------------------------------


@query("""
SELECT conv_id AS job_id, count(*) FILTER (role = 'assistant') AS n_audio_streams, round(sum(length(coalesce(text, ''))) / 15.0, 6) AS duration,
  count(*) FILTER (role = 'assistant') > 0 AND sum(length(coalesce(text, ''))) > 0 AND conv_id % 7 <> 0 AS valid
FROM conversations GROUP BY conv_id""")
def media_validation(spark, sf_dir):
    stream = F.struct(F.when(F.col("role") == "assistant", "audio").otherwise("video").alias("codec_type"))
    probes = turns(spark, sf_dir).groupBy("job_id").agg(F.collect_list(stream).alias("streams"), (F.sum(F.char_length("text")) / 15.0).alias("duration"))
    probes = probes.withColumn("size", F.when(F.col("job_id") % 7 != 0, 1).otherwise(0))  # every seventh file is empty
    return probes.select("job_id", F.size(V.audio_streams(F.col("streams"))).cast("long").alias("n_audio_streams"), F.round("duration", 6).alias("duration"), V.is_valid_media(F.col("size"), F.col("streams"), F.col("duration")).alias("valid"))


@query("""
WITH j AS (SELECT conv_id, count(*) FILTER (role = 'system') AS n FROM conversations GROUP BY conv_id)
SELECT conv_id AS job_id, 'preprocess' AS stage_name, 'failed' AS status, 'Input validation failed.' AS error, 1 AS attempt FROM j WHERE n = 0""")
def refused_media(spark, sf_dir):
    stream = F.struct(F.when(F.col("role") == "system", "audio").otherwise("video").alias("codec_type"))
    probes = turns(spark, sf_dir).groupBy("job_id").agg(F.collect_set(stream).alias("streams"), F.lit(1.0).alias("duration"), F.lit(1).alias("size"))
    return V.split_valid(probes)[1].select("job_id", "stage_name", "status", "error", "attempt")


@query("""
WITH d AS (SELECT DISTINCT source AS job_id FROM documents), r AS (SELECT * FROM d, (VALUES ('de'), ('en'), ('es'), ('fr'), ('hi')) v(file))
SELECT job_id, file FROM r WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.source = r.job_id AND x.lang = r.file)""")
def missing_bundle_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), F.col("lang").alias("file"))
    return V.missing_files(docs, docs, ("de", "en", "es", "fr", "hi"))


@query("""
SELECT conv_id AS job_id, turn AS chunk_id, turn % 4 < 2 AS accepted,
  CASE turn % 4 WHEN 2 THEN 'Unsupported bundle version: 2.0' WHEN 3 THEN 'Unsupported bundle version: None' END AS error FROM conversations""")
def version_gate(spark, sf_dir):
    # of four manifests, two have the version, one another and one none
    version = F.when(F.col("chunk_id") % 4 < 2, "1.0").when(F.col("chunk_id") % 4 == 2, "2.0")
    doc = F.to_json(F.struct(F.struct(version.alias("bundle_version"), F.col("job_id").cast("string").alias("job_id")).alias("metadata")))
    found = F.get_json_object(doc, "$.metadata.bundle_version")
    return turns(spark, sf_dir).select("job_id", "chunk_id", V.is_version(found).alias("accepted"), F.when(~V.is_version(found), V.unsupported(found)).alias("error"))


@query("SELECT user_id AS job_id, event_type AS stage_name, max(event_id)::INTEGER AS attempt, CASE WHEN arg_max(value, event_id) < 50 THEN 'failed' ELSE 'done' END AS status FROM events GROUP BY ALL")
def latest_attempts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage_name"), F.when(F.col("value") < 50, "failed").otherwise("done").alias("status"), F.create_map(F.lit("value"), "value").alias("metrics"), F.col("event_id").cast("int").alias("attempt"))
    return P.latest_attempt(rows).select("job_id", "stage_name", "attempt", "status")


# -- segmentation -------------------------------------------------------------------------------------------------


@query("""
WITH x AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings),
q AS (SELECT vec_id, pos, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS run FROM x WHERE abs(v) < pow(10, -1.5))
SELECT vec_id, min(pos)::INTEGER AS start_pos, (max(pos) + 1)::INTEGER AS end_pos FROM q GROUP BY vec_id, run HAVING count(*) >= 2""")
def silence_detect(spark, sf_dir):
    return S.silent_runs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10**-1.5, 2)


SQL_LOG = """
WITH n AS (SELECT user_id AS job_id, event_id, (event_id % 7 - 1) AS a, (event_id % 7 + 2) AS b, event_id % 5 AS k FROM events),
g AS (SELECT job_id, event_id, greatest(a, 0)::DOUBLE AS start_ts, b::DOUBLE AS end_ts FROM n WHERE k <> 4)
SELECT job_id, event_id, start_ts, end_ts FROM g"""


@query(SQL_LOG)
def silence_log_parse(spark, sf_dir):
    # a log per event: a start that may be negative, and its end, which every fifth lacks
    start = F.format_string("[silencedetect @ 0x55] silence_start: %d\n", F.col("event_id") % 7 - 1)
    end = F.when(F.col("event_id") % 5 != 4, F.format_string("[silencedetect @ 0x55] silence_end: %d | silence_duration: 3\n", F.col("event_id") % 7 + 2)).otherwise("")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), "event_id", F.explode(S.silences_from_log(F.concat(start, end))).alias("s"))
    return rows.select("job_id", "event_id", F.col("s.start").alias("start_ts"), F.col("s.end").alias("end_ts"))


SQL_SEGMENTS = f"""
x AS ({SQL_EVENTS}),
g AS (
  SELECT job_id, lag(e, 1, 0.0) OVER (PARTITION BY job_id ORDER BY s, event_id) AS f, s AS t FROM x
  UNION ALL SELECT job_id, arg_max(e, (s, event_id)), max(e) + 10 FROM x GROUP BY job_id),
seg AS (SELECT job_id, f AS start_ts, t AS end_ts FROM g WHERE t - f >= 0.25)"""


@query(f"WITH {SQL_SEGMENTS} SELECT job_id, round(start_ts, 6) AS start_ts, round(end_ts, 6) AS end_ts FROM seg")
def build_segments(spark, sf_dir):
    rows = S.speech_between_rows(silences(spark, sf_dir), "job_id", "s", "e", ["s", "event_id"], lambda w: F.max("e").over(w) + 10)
    return rows.select("job_id", F.round("start_ts", 6).alias("start_ts"), F.round("end_ts", 6).alias("end_ts"))


@query(f"WITH {SQL_SEGMENTS} SELECT job_id, count(*) AS n_segments, round(sum(end_ts - start_ts), 3) AS speech_seconds FROM seg GROUP BY job_id")
def speech_totals(spark, sf_dir):
    own = silences(spark, sf_dir).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("s", "event_id", "e"))).alias("x"), (F.max("e") + 10).alias("total"))
    found = S.speech_between(F.transform("x", lambda r: S.interval(r.s, r.e)), F.col("total"))
    seconds = F.aggregate(found, F.lit(0.0), lambda a, s: a + s.end - s.start)
    return own.select("job_id", F.size(found).cast("long").alias("n_segments"), F.round(seconds, 3).alias("speech_seconds"))


SQL_WINDOWS = "SELECT doc_id, i, 29.0 * i AS start_ts, least(29.0 * i + 30, total) AS end_ts FROM (SELECT doc_id, total, unnest(range(0, CASE WHEN total > 0 THEN ceil(greatest(total - 30, 0) / 29)::BIGINT + 2 ELSE 0 END)) AS i FROM t) WHERE i = 0 OR 29.0 * (i - 1) + 30 < total"


@query(f"WITH t AS (SELECT doc_id, n_chars / 15.0 AS total FROM documents) SELECT doc_id, round(start_ts::DOUBLE, 6) AS start_ts, round(end_ts::DOUBLE, 6) AS end_ts FROM ({SQL_WINDOWS})")
def fixed_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(S.fixed_windows(F.col("n_chars") / 15.0)).alias("s"))
    return rows.select("doc_id", F.round("s.start", 6).alias("start_ts"), F.round("s.end", 6).alias("end_ts"))


@query(f"""
WITH all_docs AS (SELECT doc_id, n_chars / 15.0 AS total FROM documents), t AS (SELECT * FROM all_docs WHERE doc_id % 3 = 0 OR total < 0.25),
o AS (SELECT * FROM all_docs WHERE doc_id % 3 <> 0 AND total >= 0.25),
p AS (SELECT doc_id, 0.0 AS start_ts, total / 4 AS end_ts FROM o UNION ALL SELECT doc_id, total / 2, total FROM o),
s AS (SELECT * FROM p WHERE end_ts - start_ts >= 0.25),
w AS (SELECT doc_id, start_ts, end_ts FROM ({SQL_WINDOWS.replace('FROM t)', "FROM (SELECT * FROM t UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM s)) u)")}))
SELECT doc_id, round(start_ts::DOUBLE, 6) AS start_ts, round(end_ts::DOUBLE, 6) AS end_ts FROM (SELECT * FROM s UNION ALL SELECT * FROM w)""")
def segments_or_windows(spark, sf_dir):
    # every third recording is silent throughout, the others in their second quarter
    total = F.col("n_chars") / 15.0
    silent = F.when(F.col("doc_id") % 3 == 0, F.array(S.interval(F.lit(0.0), total))).otherwise(F.array(S.interval(total / 4, total / 2)))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(S.segments_or_windows(silent, total)).alias("s"))
    return rows.select("doc_id", F.round("s.start", 6).alias("start_ts"), F.round("s.end", 6).alias("end_ts"))


@query(f"""
WITH {SQL_SEGMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_ts, end_ts) - 1 AS chunk_id FROM seg)
SELECT job_id, chunk_id, printf('chunk_%04d.wav', chunk_id) AS chunk_path, round(start_ts, 6) AS start_ts, round(end_ts, 6) AS end_ts FROM n""")
def chunk_manifest(spark, sf_dir):
    rows = S.manifest_rows(S.speech_between_rows(silences(spark, sf_dir), "job_id", "s", "e", ["s", "event_id"], lambda w: F.max("e").over(w) + 10))
    return rows.select("job_id", "chunk_id", "chunk_path", F.round("start_ts", 6).alias("start_ts"), F.round("end_ts", 6).alias("end_ts"))


@query(f"""
WITH t AS (SELECT doc_id, n_chars / 15.0 AS total FROM documents)
SELECT doc_id, printf('chunk_%04d.wav', i) AS chunk_path, round(start_ts::DOUBLE, 6) AS start_ts, round(end_ts::DOUBLE, 6) AS end_ts FROM ({SQL_WINDOWS}) WHERE i < doc_id % 5""")
def paired_manifest(spark, sf_dir):
    # of each recording 0 to 4 chunks were cut
    paths = F.transform(F.slice(F.sequence(F.lit(0), F.lit(4)), F.lit(1), (F.col("doc_id") % 5).cast("int")), T.chunk_name)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(S.paired(paths, S.fixed_windows(F.col("n_chars") / 15.0))).alias("s"))
    return rows.select("doc_id", "s.chunk_path", F.round("s.start_ts", 6).alias("start_ts"), F.round("s.end_ts", 6).alias("end_ts"))


# -- files --------------------------------------------------------------------------------------------------------

RATE = 8  # samples a second, so that a vector is a recording


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as WAV files (job_id, size, content) of 8 samples a second; every tenth is no media file."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("vec_id").to_pylist()
            made = [b"broken" if i % 10 == 9 else wav_bytes(np.array(v.as_py(), np.float64) * 32767, RATE) for i, v in zip(ids, b.column("embedding"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids]), pa.array([len(x) for x in made], pa.int64()), pa.array(made, pa.binary())], names=["job_id", "size", "content"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(go, "job_id string, size long, content binary")


SQL_SPEECH = """
x AS (SELECT vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE * 32767 AS v, unnest(range(len(embedding))) AS pos FROM embeddings WHERE vec_id % 10 <> 9),
q AS (SELECT vec_id, n, pos, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS run FROM x WHERE abs(least(greatest(round_even(v, 0), -32768), 32767)) < 32768 * pow(10, -1.5)),
r AS (SELECT vec_id, n, min(pos) / 8.0 AS a, (max(pos) + 1) / 8.0 AS b FROM q GROUP BY vec_id, n, run HAVING count(*) >= 4),
j AS (SELECT vec_id, len(embedding) / 8.0 AS total FROM embeddings WHERE vec_id % 10 <> 9),
g AS (
  SELECT vec_id, lag(b, 1, 0.0) OVER (PARTITION BY vec_id ORDER BY a) AS start_ts, a AS end_ts FROM r
  UNION ALL SELECT j.vec_id, coalesce(max(b), 0.0), j.total FROM j LEFT JOIN r ON r.vec_id = j.vec_id GROUP BY j.vec_id, j.total),
f AS (SELECT * FROM g WHERE end_ts - start_ts >= 0.25),
speech AS (SELECT vec_id, start_ts, end_ts FROM f UNION ALL SELECT vec_id, 0.0, total FROM j WHERE vec_id NOT IN (SELECT vec_id FROM f))"""


@query("SELECT vec_id::VARCHAR AS job_id, vec_id % 10 <> 9 AS valid, CASE WHEN vec_id % 10 <> 9 THEN len(embedding) / 8.0 END::DOUBLE AS duration FROM embeddings")
def stage_validate(spark, sf_dir):
    return P.Preprocess().validate(recordings(spark, sf_dir)).select("job_id", "valid", "duration")


@query(f"""
WITH {SQL_SPEECH}
SELECT vec_id::VARCHAR AS job_id, 'done' AS status, NULL::VARCHAR AS error, count(*)::DOUBLE AS num_segments FROM speech GROUP BY vec_id
UNION ALL SELECT vec_id::VARCHAR, 'failed', 'Input validation failed.', NULL FROM embeddings WHERE vec_id % 10 = 9""")
def preprocess_stage(spark, sf_dir):
    _, results = P.Preprocess().run(recordings(spark, sf_dir), P.Config(audio_sample_rate=RATE))
    return results.select("job_id", "status", "error", F.try_element_at("metrics", F.lit("num_segments")).alias("num_segments"))


@query(f"""
WITH {SQL_SPEECH}, n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY start_ts) - 1 AS chunk_id FROM speech)
SELECT vec_id::VARCHAR AS job_id, chunk_id, printf('chunk_%04d.wav', chunk_id) AS chunk_path, start_ts::DOUBLE AS start_ts, end_ts::DOUBLE AS end_ts, ((end_ts - start_ts) * 8)::BIGINT AS frames FROM n""")
def chunk_audio(spark, sf_dir):
    chunks, _ = P.Preprocess().run(recordings(spark, sf_dir), P.Config(audio_sample_rate=RATE))
    return chunks.select("job_id", "chunk_id", "chunk_path", "start_ts", "end_ts", ((F.octet_length("content") - 44) / 2).cast("long").alias("frames"))


@query(f"""
WITH {SQL_SPEECH}, n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY start_ts) - 1 AS chunk_id FROM speech),
w AS (SELECT vec_id, chunk_id, start_ts, unnest(range(floor(end_ts - start_ts)::BIGINT)) AS k FROM n)
SELECT vec_id::VARCHAR AS job_id, row_number() OVER (PARTITION BY vec_id ORDER BY chunk_id, k) - 1 AS segment_id, chunk_id, (start_ts + k)::DOUBLE AS start_ts, (start_ts + k + 1)::DOUBLE AS end_ts,
  ' word' || k || ' ' AS text, round(-0.1 * (k + 1), 6)::DOUBLE AS avg_logprob FROM w""")
def recognised_chunks(spark, sf_dir):
    """Media files to a transcript, by the stage and a recogniser that hears a word a second."""
    chunks, _ = P.Preprocess().run(recordings(spark, sf_dir), P.Config(audio_sample_rate=RATE))
    segments = R.assemble(B.recognise(chunks, B.StubRecogniser()))
    return segments.select("job_id", "segment_id", "chunk_id", "start_ts", "end_ts", "text", F.round("avg_logprob", 6).alias("avg_logprob"))


# A recording per label: its vectors one after the other.
SQL_LONG = """
e AS (SELECT *, sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id) - len(embedding) AS before FROM embeddings WHERE label IS NOT NULL),
x AS (SELECT label, before + unnest(range(len(embedding))) AS pos, least(greatest(round_even(unnest(embedding)::DOUBLE * 32767, 0), -32768), 32767)::BIGINT AS v FROM e),
q AS (SELECT label, pos, pos - row_number() OVER (PARTITION BY label ORDER BY pos) AS run FROM x WHERE abs(v) < 32768 * pow(10, -1.5)),
r AS (SELECT label, min(pos) AS a, max(pos) + 1 AS b FROM q GROUP BY label, run HAVING count(*) >= 4),
j AS (SELECT label, max(pos) + 1 AS total FROM x GROUP BY label),
g AS (
  SELECT label, lag(b, 1, 0) OVER (PARTITION BY label ORDER BY a) AS a, a AS b FROM r
  UNION ALL SELECT j.label, coalesce(max(r.b), 0), j.total FROM j LEFT JOIN r ON r.label = j.label GROUP BY j.label, j.total),
speech AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY a) - 1 AS chunk_id FROM g WHERE b - a >= 2)"""


def long_recordings(spark: SparkSession, sf_dir: str) -> str:
    """A WAV file per label, written in pieces: a header, then a vector at a time."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("label").cast("string").alias("job_id"), "vec_id", "embedding")

    def pcm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.clip(np.rint(np.array(v.as_py(), np.float64) * 32767), -32768, 32767).astype("<i2").tobytes() for v in b.column("embedding")]
            yield pa.RecordBatch.from_arrays([b.column("job_id"), b.column("vec_id"), pa.array(made, pa.binary())], names=["job_id", "piece", "content"])

    data = rows.mapInArrow(pcm, "job_id string, piece long, content binary")
    heads = rows.groupBy("job_id").agg(F.sum(F.size("embedding")).alias("n")).select("job_id", F.lit(-1).cast("long").alias("piece"), G.wav_header(F.col("n"), RATE, 1).alias("content"))
    root = work_folder(spark, "recordings")
    write_files(data.unionByName(heads).withColumn("path", F.lit("in.wav")), root)
    return root


@query(f"""
WITH {SQL_LONG}
SELECT label::VARCHAR AS job_id, total / 8.0 AS total_duration, (SELECT count(*) FROM r WHERE r.label = j.label) AS n_silences, (SELECT coalesce(sum(b - a), 0)::BIGINT FROM r WHERE r.label = j.label) AS silent_frames FROM j""")
def range_silences(spark, sf_dir):
    """Silences of whole recordings from what ranges of 500 bytes tell of themselves."""
    found = G.recording_silences(G.read_ranges(spark, long_recordings(spark, sf_dir), rate=RATE, rangeBytes=500), RATE)
    frames = F.aggregate("silences", F.lit(0.0), lambda n, s: n + (s.end - s.start) * RATE).cast("long")
    return found.select("job_id", (F.col("total") / RATE).alias("total_duration"), F.size("silences").cast("long").alias("n_silences"), frames.alias("silent_frames"))


@query(f"""
WITH {SQL_LONG}
SELECT s.label::VARCHAR AS job_id, chunk_id, printf('chunk_%04d.wav', chunk_id) AS chunk_path, s.a / 8.0 AS start_ts, s.b / 8.0 AS end_ts, count(*) AS frames, sum(v)::BIGINT AS total
FROM speech s JOIN x ON x.label = s.label AND x.pos >= s.a AND x.pos < s.b GROUP BY ALL""")
def range_chunks(spark, sf_dir):
    """Chunks cut from the ranges that they touch, with the sum of their samples."""
    pieces, _ = G.preprocess_recordings(spark, long_recordings(spark, sf_dir), RATE, rangeBytes=500)
    keys = ["job_id", "chunk_id", "chunk_path", "start_ts", "end_ts"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [read_pcm(c.as_py())[0] for c in b.column("content")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array([len(v) for v in x], pa.int64()), pa.array([int(v.sum()) for v in x], pa.int64())], names=[*keys, "frames", "total"])

    return G.whole_chunks(pieces).mapInArrow(sums, "job_id string, chunk_id long, chunk_path string, start_ts double, end_ts double, frames long, total long")


def stored(docs: DataFrame, name: str) -> str:
    """Writes a document per job (job_id, json) to a folder of its own, and returns their paths' pattern."""
    path = work_folder(docs.sparkSession, name)
    docs.write.mode("append").partitionBy("job_id").text(path)
    return f"{path}/*/*.txt"


def job_of(folder: str = "job_id"):
    return F.regexp_replace(folder, "^job_id=", "").cast("long").alias("job_id")


@query(f"""
WITH {SQL_SEGMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_ts, end_ts) - 1 AS chunk_id FROM seg)
SELECT job_id, chunk_id, printf('chunk_%04d.wav', chunk_id) AS chunk_path, round(start_ts, 6) AS start_ts, round(end_ts, 6) AS end_ts FROM n""")
def manifest_files(spark, sf_dir):
    """Manifests as JSON files of each job, and back: the chunk's number is the entry's place, the job its folder."""
    rows = S.manifest_rows(S.speech_between_rows(silences(spark, sf_dir), "job_id", "s", "e", ["s", "event_id"], lambda w: F.max("e").over(w) + 10))
    back = D.read_manifests(spark, stored(D.manifest_documents(rows), "manifests"))
    return back.select(job_of(), "chunk_id", "chunk_path", F.round("start_ts", 6).alias("start_ts"), F.round("end_ts", 6).alias("end_ts"))


# -- transcripts --------------------------------------------------------------------------------------------------

SQL_TRANSCRIPT = """
l AS (SELECT conv_id AS job_id, turn AS chunk_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM conversations),
tr AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY chunk_id, pos) - 1 AS segment_id, chunk_id, chunk_id * 30.0 + pos * 1.5 AS start_ts, chunk_id * 30.0 + pos * 1.5 + 1 AS end_ts, text FROM l)"""


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of half a minute, lines as what was recognised in them."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i * 1.5).alias("start"), (i * 1.5 + 1).alias("end"), x.alias("text")))
    return R.assemble(turns(spark, sf_dir).select("job_id", "chunk_id", (F.col("chunk_id") * 30.0).alias("chunk_start"), line.alias("segments")))


@query(f"WITH {SQL_TRANSCRIPT} SELECT job_id, segment_id, chunk_id, start_ts::DOUBLE AS start_ts, end_ts::DOUBLE AS end_ts, text FROM tr")
def transcript_assemble(spark, sf_dir):
    return transcript(spark, sf_dir).select("job_id", "segment_id", "chunk_id", "start_ts", "end_ts", "text")


@query(f"WITH {SQL_TRANSCRIPT} SELECT job_id, chunk_id, printf('chunk_%04d.wav', chunk_id) AS audio_name, count(*) AS n_segments FROM tr GROUP BY job_id, chunk_id HAVING count(*) > 1")
def output_collision(spark, sf_dir):
    return R.colliding_outputs(transcript(spark, sf_dir))


@query(rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({sql_strip('text')}, '{SPACE}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS k FROM w),
h AS (SELECT doc_id, count(*) FILTER (4 * k >= 290 AND 4 * k % 290 <= 6 AND 4 * k // 290 * 290 + 10 < 4 * n) AS n_repeated FROM k GROUP BY doc_id)
SELECT w.doc_id AS job_id, len(w)::BIGINT AS n_words, coalesce(n_repeated, 0) AS n_repeated, sha256(array_to_string(w, ' ')) AS words_sha256 FROM w LEFT JOIN h ON h.doc_id = w.doc_id""")
def words_heard_once(spark, sf_dir):
    """Documents as recordings of 0.4 s a word, heard by overlapping windows, and put together again."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("job_id"), T.words(F.col("text")).alias("all"))
    rows = docs.select("job_id", "all", F.posexplode_outer(S.fixed_windows(F.size("all") * 0.4)).alias("chunk_id", "s"))
    first, last = F.ceil(F.col("s.start") / 0.4), F.floor(F.round(F.col("s.end") / 0.4, 6))
    own = F.transform(F.slice("all", (first + 1).cast("int"), (last - first).cast("int")), lambda w, i: F.struct(w.alias("word"), ((i + first) * 4 / 10).alias("start"), ((i + first + 1) * 4 / 10).alias("end")))
    heard = rows.select("job_id", F.coalesce("chunk_id", F.lit(0)).alias("chunk_id"), F.col("s.start").alias("start_ts"), F.col("s.end").alias("end_ts"), F.when(F.col("s").isNotNull(), own).cast(O.WORD).alias("words"))
    out = O.heard_once(heard).groupBy("job_id").agg(F.sum("n_repeated").alias("n_repeated"), F.array_sort(F.collect_list(F.struct("chunk_id", "words"))).alias("all"))
    said = F.flatten(F.transform("all", lambda x: F.transform(x.words, lambda w: w.word)))
    return out.select("job_id", F.size(said).cast("long").alias("n_words"), "n_repeated", F.sha2(F.array_join(said, " "), 256).alias("words_sha256"))


@query("SELECT source AS job_id, coalesce(arg_min(lang, doc_id), 'unknown') AS language, round(coalesce(arg_min(n_chars / (n_chars + 100.0), doc_id), 0), 6)::DOUBLE AS language_probability FROM documents GROUP BY source")
def job_language(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("job_id"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("language"), (F.col("n_chars") / (F.col("n_chars") + 100.0)).alias("language_probability"))
    return R.job_languages(chunks).withColumn("language_probability", F.round("language_probability", 6))


TAG_CASE = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGE_TAGS.items()) + " ELSE {} END"


@query(f"SELECT doc_id, lang, {TAG_CASE.format('lang', 'lang')} AS tag FROM documents")
def language_tag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", T.language_tag(F.col("lang")).alias("tag"))


@query(f"SELECT doc_id, sha256(concat_ws(' ', {TAG_CASE.format('lang', 'lang')}, 'hin_Deva', coalesce(text, ''))) AS prompt_sha256 FROM documents")
def translation_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.prompt(F.col("lang"), F.lit("hi"), F.coalesce("text", F.lit(""))), 256).alias("prompt_sha256"))


@query(f"""WITH {SQL_TRANSCRIPT} SELECT job_id, 'hi' AS language, 24000::BIGINT AS output_sample_rate, segment_id, chunk_id, start_ts::DOUBLE AS start_ts, end_ts::DOUBLE AS end_ts,
  '[hi] ' || text AS text, 'voices/reference.wav' AS reference_audio FROM tr""")
def synthesis_request(spark, sf_dir):
    """Requests as JSON documents, read back and flattened."""
    translated = transcript(spark, sf_dir).select(F.col("job_id").cast("string"), "segment_id", "chunk_id", "start_ts", "end_ts", F.concat(F.lit("[hi] "), "text").alias("translated_text"), F.lit("hi").alias("target_language"))
    docs = D.request_documents(R.synthesis_requests(translated, "voices/reference.wav"))
    back = docs.select(parsed(F.col("json"), SYNTHESIS_REQUEST).alias("d")).select("d.*")
    return back.select(F.col("job_id").cast("long").alias("job_id"), "language", "output_sample_rate", F.explode("segments").alias("s")).select("job_id", "language", "output_sample_rate", "s.*")


class Tagged:
    """A translation as an expression: the text behind the tag of its language."""

    def column(self, prompt, text, source, target):
        return F.concat(F.lit("["), target, F.lit("] "), text)


@query(f"""
WITH {SQL_TRANSCRIPT}, t AS (SELECT *, CASE WHEN job_id % 2 = 0 THEN 'en' ELSE 'unknown' END AS source_language FROM tr)
SELECT job_id, segment_id, chunk_id, start_ts::DOUBLE AS start_ts, end_ts::DOUBLE AS end_ts, text AS source_text, '[tam_Taml] ' || text AS translated_text, source_language, 'ta' AS target_language FROM t""")
def translated_segments(spark, sf_dir):
    heard = turns(spark, sf_dir).select("job_id", "chunk_id", F.when(F.col("job_id") % 2 == 0, "en").alias("language"), F.lit(0.5).alias("language_probability"))
    return R.translate(transcript(spark, sf_dir), R.job_languages(heard), "ta", Tagged())


@query(f"""
WITH {SQL_TRANSCRIPT}
SELECT job_id, segment_id, '[hin_Deva] ' || text AS translated_text, CASE WHEN job_id % 2 = 0 THEN 'en' ELSE 'unknown' END AS source_language FROM tr""")
def translated_by_backend(spark, sf_dir):
    """The same by a backend that is loaded in the workers and takes batches of rows."""
    heard = turns(spark, sf_dir).select("job_id", "chunk_id", F.when(F.col("job_id") % 2 == 0, "en").alias("language"), F.lit(0.5).alias("language_probability"))
    out = R.translate(transcript(spark, sf_dir), R.job_languages(heard), "hi", B.TranslationBackend(B.StubTranslator()))
    return out.select("job_id", "segment_id", "translated_text", "source_language")


def requests(spark: SparkSession, sf_dir: str, rate: int) -> DataFrame:
    translated = transcript(spark, sf_dir).select(F.col("job_id").cast("string"), "segment_id", "chunk_id", "start_ts", "end_ts", F.col("text").alias("translated_text"), F.lit("hi").alias("target_language"))
    return R.synthesis_requests(translated, "voices/reference.wav", rate)


@query("SELECT DISTINCT conv_id::VARCHAR AS job_id, 'tts' AS stage_name, 'pending' AS status, 1 AS attempt FROM conversations")
def pending_jobs(spark, sf_dir):
    """What an export for a synthesiser elsewhere leaves behind."""
    return B.submitted(requests(spark, sf_dir, 24000)).select("job_id", "stage_name", "status", "attempt")


@query(f"""
WITH {SQL_TRANSCRIPT},
j AS (SELECT job_id, sha256(string_agg('[hi] ' || text, chr(10) ORDER BY segment_id)) AS texts_sha256 FROM tr GROUP BY job_id)
SELECT job_id, 'transcript' AS stage_name, 'done' AS status, 1 AS attempt, 1 AS executions, NULL AS texts_sha256 FROM j
UNION ALL SELECT job_id, 'translation', CASE WHEN job_id % 11 = 0 THEN 'failed' ELSE 'done' END, CASE WHEN job_id % 11 = 0 THEN 3 WHEN job_id % 7 = 0 THEN 2 ELSE 1 END, CASE WHEN job_id % 11 = 0 THEN 3 WHEN job_id % 7 = 0 THEN 2 ELSE 1 END, NULL FROM j
UNION ALL SELECT job_id, 'request', 'done', 1, 2, texts_sha256 FROM j WHERE job_id % 11 <> 0""")
def resumed_chain(spark, sf_dir):
    """A chain of steps that is run four times: some jobs fail once (by 7), some always (by 11: three attempts), then the
    last step's settings change. Executions are what the logs hold of a job and step, over all runs."""
    root = work_folder(spark, "chain")

    def steps(failing: int, rate: int) -> list[C.Step]:
        line = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i * 1.5).alias("start"), (i * 1.5 + 1).alias("end"), x.alias("text")))
        heard = lambda rows: R.assemble(rows.select("job_id", "chunk_id", (F.col("chunk_id") * 30.0).alias("chunk_start"), line.alias("segments")))
        bad = F.when((F.col("job_id") % 11 == 0) | (F.col("job_id") % failing == 0), F.lit("no backend"))
        said = lambda rows: rows.select("job_id", "segment_id", "chunk_id", "start_ts", "end_ts", F.concat(F.lit("[hi] "), "text").alias("translated_text"), F.lit("hi").alias("target_language"), bad.alias("error"))
        return [C.Step("transcript", heard), C.Step("translation", said, "hi"), C.Step("request", lambda rows: R.synthesis_requests(rows, "voices/reference.wav", rate), str(rate))]

    for failing, rate in ((7, 24000), (11, 24000), (11, 24000), (11, 16000)):
        run = C.run_chain(turns(spark, sf_dir), steps(failing, rate), root)
    logs = C.step_log(spark, root, "transcript", "long").unionByName(C.step_log(spark, root, "translation", "long")).unionByName(C.step_log(spark, root, "request", "long"))
    executions = logs.groupBy("job_id", "stage_name").agg(F.count(F.lit(1)).cast("int").alias("executions"))
    texts = C.chain_rows(spark, run, "request").select("job_id", F.lit("request").alias("stage_name"), F.sha2(F.array_join(F.transform("segments", lambda s: s.text), "\n"), 256).alias("texts_sha256"))
    out = C.chain_results(spark, run).select("job_id", "stage_name", "status", "attempt")
    return out.join(executions, ["job_id", "stage_name"]).join(texts, ["job_id", "stage_name"], "left")


def stored_bundles(spark: SparkSession, sf_dir: str, rate: int = 200, zipped: bool = False) -> str:
    """Bundles of all jobs in a folder of the shared store."""
    root = work_folder(spark, "bundles")
    asked = requests(spark, sf_dir, rate)
    files = D.bundle_files(asked, asked.select("job_id", F.encode("job_id", "UTF-8").alias("content")), "2024-01-01T00:00:00Z")
    write_files(D.zip_bundles(files) if zipped else files, root)
    return root


SQL_BUNDLES = f"""
WITH {SQL_TRANSCRIPT}
SELECT job_id, '1.0' AS bundle_version, 'hi' AS language, 200::BIGINT AS output_sample_rate, job_id::VARCHAR AS voice, count(*) AS n_segments, sha256(string_agg(text, chr(10) ORDER BY segment_id)) AS texts_sha256
FROM tr GROUP BY job_id"""


def told_bundles(back: DataFrame) -> DataFrame:
    texts = F.array_join(F.transform("segments", lambda s: s.text), "\n")
    return back.select(F.col("job_id").cast("long").alias("job_id"), "bundle_version", "language", "output_sample_rate", F.decode("reference_audio", "UTF-8").alias("voice"), F.size("segments").cast("long").alias("n_segments"), F.sha2(texts, 256).alias("texts_sha256"))


@query(SQL_BUNDLES)
def bundle_files(spark, sf_dir):
    """Bundles written, checked and read back, with the voice sample."""
    return told_bundles(D.load_bundles(spark, stored_bundles(spark, sf_dir), audio=True))


@query(SQL_BUNDLES)
def zipped_bundles(spark, sf_dir):
    """The same by way of zip archives, of which the members are read where they are."""
    return told_bundles(D.load_bundles(spark, stored_bundles(spark, sf_dir, zipped=True), audio=True, zipped=True))


@query(f"WITH {SQL_TRANSCRIPT} SELECT job_id, 'tts' AS stage_name, 'done' AS status, count(*)::DOUBLE AS num_segments, 0.0::DOUBLE AS failed_segments FROM tr GROUP BY job_id")
def worker_run(spark, sf_dir):
    """Bundles to results, by the worker and a synthesiser of tones."""
    results = B.run_bundles(spark, stored_bundles(spark, sf_dir), B.ToneSynthesiser(200))
    return results.select(F.col("job_id").cast("long").alias("job_id"), "stage_name", "status", *(F.element_at("metrics", F.lit(c)).alias(c) for c in ("num_segments", "failed_segments")))


@query(f"""
WITH {SQL_TRANSCRIPT}
SELECT job_id, 200::BIGINT AS sample_rate, segment_id, chunk_id, printf('output/chunk_%04d_seg_%06d.wav', chunk_id, segment_id) AS audio_path, round(greatest(length(text), 1) * 0.05, 6)::DOUBLE AS duration FROM tr""")
def result_files(spark, sf_dir):
    """The result documents that the worker wrote, read back."""
    root = stored_bundles(spark, sf_dir)
    B.run_bundles(spark, root, B.ToneSynthesiser(200))
    back = D.read_results(spark, f"{root}/*/output/synthesis_result.json").select(F.col("job_id").cast("long").alias("job_id"), "sample_rate", F.explode("segments").alias("s"))
    return back.select("job_id", "sample_rate", "s.segment_id", "s.chunk_id", "s.audio_path", F.round("s.duration", 6).alias("duration"))


# -- intervals ----------------------------------------------------------------------------------------------------

@query(f"""
WITH e AS ({SQL_EVENTS}), t AS (SELECT event_id, event_type AS kind, s, e FROM e JOIN events USING (event_id)),
n AS (SELECT kind, max(e) AS total FROM t GROUP BY kind),
w AS (SELECT kind, k AS window_id, k * 21000.0 AS s, k * 21000.0 + 21600 AS e FROM (SELECT kind, unnest(range((total // 21000)::BIGINT + 1)) AS k FROM n) UNION ALL SELECT kind, -1, -1e9, 1e9 FROM n)
SELECT event_id, window_id FROM t JOIN w ON t.kind = w.kind AND t.s < w.e AND w.s < t.e""")
def overlapping_windows(spark, sf_dir):
    """Events as intervals against overlapping windows of six hours, and one that spans everything, of their type."""
    own = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.expr(START).alias("s"), (F.expr(START) + F.col("value")).alias("e"))
    total = own.groupBy("kind").agg(F.max("e").alias("total"))
    row = lambda k, s, e: F.struct(k.cast("long").alias("window_id"), s.cast("double").alias("s"), e.cast("double").alias("e"))
    each = F.transform(F.sequence(F.lit(0), F.floor(F.col("total") / 21000)), lambda k: row(k, k * 21000, k * 21000 + 21600))
    windows = total.select("kind", F.inline(F.array_append(each, row(F.lit(-1), F.lit(-1e9), F.lit(1e9)))))
    return I.overlap_join(own, windows, ["kind"], ("s", "e"), ("s", "e")).select("left.event_id", "right.window_id")


@query(f"""
WITH {SQL_TRANSCRIPT},
c AS (SELECT conv_id AS job_id, turn AS chunk_id, turn * 22.0 AS s, turn * 22.0 + 25 AS e, min(role) AS speaker FROM conversations GROUP BY conv_id, turn),
p AS (SELECT tr.job_id, segment_id, c.chunk_id, speaker, row_number() OVER (PARTITION BY tr.job_id, segment_id ORDER BY least(end_ts, e) - greatest(start_ts, s) DESC, s, c.chunk_id) AS r
  FROM tr JOIN c ON c.job_id = tr.job_id AND start_ts < e AND s < end_ts)
SELECT tr.job_id, tr.segment_id, speaker FROM tr LEFT JOIN p ON p.job_id = tr.job_id AND p.segment_id = tr.segment_id AND r = 1""")
def labelled_segments(spark, sf_dir):
    """Speakers of chunks onto the segments they overlap longest."""
    chunks = turns(spark, sf_dir).groupBy("job_id", "chunk_id").agg(F.min("role").alias("speaker"))
    chunks = chunks.select("job_id", "chunk_id", (F.col("chunk_id") * 22.0).alias("start_ts"), (F.col("chunk_id") * 22.0 + 25).alias("end_ts"), "speaker")
    return I.labelled(transcript(spark, sf_dir), chunks, ("speaker",)).select("job_id", "segment_id", "speaker")


# -- metrics ------------------------------------------------------------------------------------------------------

@query(f"WITH {SQL_TRANSCRIPT} SELECT job_id, sha256(string_agg({sql_strip('text')}, ' ' ORDER BY segment_id)) AS hypothesis_sha256 FROM tr GROUP BY job_id")
def hypothesis_concat(spark, sf_dir):
    return transcript(spark, sf_dir).groupBy("job_id").agg(F.sha2(M.hypothesis(F.col("segment_id"), F.col("text")), 256).alias("hypothesis_sha256"))


@query(rf"""
WITH RECURSIVE p AS ({SQL_PAIRS}),
w AS (
  SELECT job_id, chunk_id, list_filter(regexp_split_to_array({sql_strip('text')}, '{SPACE}'), lambda x: x <> '') AS r,
    list_filter(regexp_split_to_array({sql_strip('next_text')}, '{SPACE}'), lambda x: x <> '') AS h
  FROM p WHERE next_text IS NOT NULL),
d AS (
  SELECT job_id, chunk_id, r, h, 0 AS i, range(len(h) + 1) AS row FROM w
  UNION ALL
  SELECT job_id, chunk_id, r, h, i + 1,
    list_reduce(list_concat([[i + 1]], list_transform(range(1, len(h) + 1), lambda j: [j])),
      lambda a, x: list_append(a, least(row[x[1] + 1] + 1, a[x[1]] + 1, row[x[1]] + CASE WHEN h[x[1]] = r[i + 1] THEN 0 ELSE 1 END)))
  FROM d WHERE i < len(r))
SELECT job_id, chunk_id, CASE WHEN len(r) > 0 THEN round(row[len(h) + 1] / len(r), 6) END AS wer FROM d WHERE i = len(r)""")
def wer(spark, sf_dir):
    return pairs(spark, sf_dir).select("job_id", "chunk_id", F.round(T.word_error_rate(F.col("text"), F.col("next_text")), 6).alias("wer"))


@query(rf"""
WITH RECURSIVE p AS ({SQL_PAIRS}),
w AS (
  SELECT job_id, chunk_id, list_filter(regexp_split_to_array({sql_strip('text')}, '{SPACE}'), lambda x: x <> '') AS r,
    list_filter(regexp_split_to_array({sql_strip('next_text')}, '{SPACE}'), lambda x: x <> '') AS h
  FROM p WHERE next_text IS NOT NULL),
d AS (
  SELECT job_id, chunk_id, r, h, 0 AS i, list_transform(range(len(h) + 1), lambda j: j * 1000000000000) AS row FROM w
  UNION ALL
  SELECT job_id, chunk_id, r, h, i + 1,
    list_reduce(list_concat([[(i + 1) * 1000000000001]], list_transform(range(1, len(h) + 1), lambda j: [j])),
      lambda a, x: list_append(a, least(row[x[1] + 1] + 1000000000001, a[x[1]] + 1000000000000, row[x[1]] + CASE WHEN h[x[1]] = r[i + 1] THEN 0 ELSE 1000001000000 END)))
  FROM d WHERE i < len(r)),
c AS (SELECT job_id, chunk_id, row[len(h) + 1] AS cost FROM d WHERE i = len(r))
SELECT job_id, chunk_id, cost // 1000000 % 1000000 AS substitutions, cost % 1000000 AS deletions, cost // 1000000000000 - cost // 1000000 % 1000000 - cost % 1000000 AS insertions FROM c""")
def word_edits(spark, sf_dir):
    rows = pairs(spark, sf_dir).where("next_text is not null").select("job_id", "chunk_id", T.word_edits(F.col("text"), F.col("next_text")).alias("e"))
    return rows.select("job_id", "chunk_id", "e.*")


# DuckDB's levenshtein() counts bytes, so each character outside ASCII becomes a control character of its own.
@query(rf"""
WITH p AS ({SQL_PAIRS}),
c AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x7F]')) AS c FROM conversations),
n AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM c),
m AS (SELECT coalesce(string_agg(c, '' ORDER BY k), '') AS f, coalesce(string_agg(chr((CASE WHEN k < 9 THEN k WHEN k < 26 THEN k + 5 ELSE k + 100 END)::INTEGER), '' ORDER BY k), '') AS t FROM n),
s AS (SELECT job_id, chunk_id, {sql_strip('text')} AS r, {sql_strip('next_text')} AS h FROM p WHERE next_text IS NOT NULL)
SELECT job_id, chunk_id, CASE WHEN length(r) > 0 THEN round(levenshtein(translate(r, f, t), translate(h, f, t)) / length(r), 6) END AS cer FROM s, m""")
def cer(spark, sf_dir):
    return pairs(spark, sf_dir).select("job_id", "chunk_id", F.round(T.character_error_rate(F.col("text"), F.col("next_text")), 6).alias("cer"))


@query(rf"""
WITH RECURSIVE {SQL_TRANSCRIPT.strip()},
lp AS (SELECT job_id, avg(-0.1 * (pos + 1)) AS p FROM l GROUP BY job_id),
hyp AS (SELECT job_id, string_agg({sql_strip('text')}, ' ' ORDER BY segment_id) AS h FROM tr GROUP BY job_id),
ref AS (SELECT conv_id AS job_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn, role, coalesce(text, '')) AS r FROM conversations WHERE turn > 0 GROUP BY conv_id),
w AS (
  SELECT ref.job_id, list_filter(regexp_split_to_array({sql_strip('r')}, '{SPACE}'), lambda x: x <> '') AS r, list_filter(regexp_split_to_array({sql_strip('h')}, '{SPACE}'), lambda x: x <> '') AS h
  FROM ref JOIN hyp ON ref.job_id = hyp.job_id),
d AS (
  SELECT job_id, r, h, 0 AS i, range(len(h) + 1) AS row FROM w
  UNION ALL
  SELECT job_id, r, h, i + 1,
    list_reduce(list_concat([[i + 1]], list_transform(range(1, len(h) + 1), lambda j: [j])),
      lambda a, x: list_append(a, least(row[x[1] + 1] + 1, a[x[1]] + 1, row[x[1]] + CASE WHEN h[x[1]] = r[i + 1] THEN 0 ELSE 1 END)))
  FROM d WHERE i < len(r)),
u AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x7F]')) AS c FROM conversations),
k AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM u),
m AS (SELECT coalesce(string_agg(c, '' ORDER BY k), '') AS f, coalesce(string_agg(chr((CASE WHEN k < 9 THEN k WHEN k < 26 THEN k + 5 ELSE k + 100 END)::INTEGER), '' ORDER BY k), '') AS t FROM k),
s AS (SELECT ref.job_id, {sql_strip('r')} AS r, {sql_strip('h')} AS h FROM ref JOIN hyp ON ref.job_id = hyp.job_id),
cer AS (SELECT job_id, CASE WHEN length(r) > 0 THEN round(levenshtein(translate(r, f, t), translate(h, f, t)) / length(r), 6) END AS cer FROM s, m)
SELECT d.job_id, CASE WHEN len(d.r) > 0 THEN round(row[len(d.h) + 1] / len(d.r), 6) END AS wer, cer, round(p, 6)::DOUBLE AS avg_logprob, 1.0::DOUBLE AS avg_segment_duration
FROM d JOIN lp ON lp.job_id = d.job_id JOIN cer ON cer.job_id = d.job_id WHERE i = len(d.r)""")
def transcript_quality(spark, sf_dir):
    """Transcripts against references that lack the first turn."""
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i * 1.5).alias("start"), (i * 1.5 + 1).alias("end"), x.alias("text"), (-0.1 * (i + 1)).alias("avg_logprob")))
    segments = R.assemble(turns(spark, sf_dir).select("job_id", "chunk_id", (F.col("chunk_id") * 30.0).alias("chunk_start"), line.alias("segments")))
    own = F.array_sort(F.collect_list(F.struct("chunk_id", "role", "text")))
    references = turns(spark, sf_dir).where("chunk_id > 0").groupBy("job_id").agg(F.array_join(F.transform(own, lambda x: x.text), " ").alias("reference"))
    out = M.evaluate_transcripts(segments, references)
    return out.select("job_id", *(F.round(c, 6).alias(c) for c in ("wer", "cer", "avg_logprob", "avg_segment_duration")))


@query("SELECT user_id AS job_id, round(coalesce(avg(value) FILTER (event_type <> 'error'), 0), 6) AS avg_logprob FROM events GROUP BY user_id")
def logprob_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.when(F.col("event_type") != "error", F.col("value")).alias("avg_logprob"))
    return rows.groupBy("job_id").agg(F.round(M.mean_or_zero(F.col("avg_logprob")), 6).alias("avg_logprob"))


@query(f"WITH {SQL_SEGMENTS} SELECT job_id, round(coalesce(avg(end_ts - start_ts), 0), 4) AS avg_segment_duration FROM seg GROUP BY job_id")
def segment_duration_mean(spark, sf_dir):
    rows = S.speech_between_rows(silences(spark, sf_dir), "job_id", "s", "e", ["s", "event_id"], lambda w: F.max("e").over(w) + 10)
    return rows.groupBy("job_id").agg(F.round(M.mean_or_zero(F.col("end_ts") - F.col("start_ts")), 4).alias("avg_segment_duration"))


@query(f"""
WITH p AS ({SQL_PAIRS}), q AS (SELECT * FROM p WHERE next_text IS NOT NULL),
a AS (SELECT job_id, count(*) AS n, sum(length(text)) AS ts, sum(length(next_text)) AS tt, avg(length(text)) AS s, avg(length(next_text)) AS t, sum(length(next_text)) / nullif(sum(length(text)), 0) AS x FROM q GROUP BY job_id)
SELECT j.job_id, coalesce(n, 0) AS num_segments, coalesce(ts, 0)::BIGINT AS total_source_chars, coalesce(tt, 0)::BIGINT AS total_target_chars, round(coalesce(s, 0), 6) AS avg_source_length, round(coalesce(t, 0), 6) AS avg_target_length, round(coalesce(x, 1), 6) AS expansion_ratio
FROM (SELECT DISTINCT conv_id AS job_id FROM conversations) j LEFT JOIN a ON a.job_id = j.job_id""")
def translation_metrics(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("job_id", F.col("text").alias("source_text"), F.col("next_text").alias("translated_text"))
    out = M.evaluate_translations(rows, turns(spark, sf_dir))
    return out.select("job_id", "num_segments", "total_source_chars", "total_target_chars", *(F.round(c, 6).alias(c) for c in ("avg_source_length", "avg_target_length", "expansion_ratio")))


@query(f"WITH {SQL_SEGMENTS} SELECT job_id, 16000 AS sample_rate, 1 AS channels, count(*) AS num_segments FROM seg GROUP BY job_id")
def stage_summary(spark, sf_dir):
    return M.stage_metrics(S.speech_between_rows(silences(spark, sf_dir), "job_id", "s", "e", ["s", "event_id"], lambda w: F.max("e").over(w) + 10))


@query("SELECT vec_id, round(len(embedding) / 24000.0, 9)::DOUBLE AS seconds FROM embeddings")
def waveform_length(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(M.waveform_seconds(F.col("embedding")), 9).alias("seconds"))


@query("""SELECT lang, source, count(*) AS jobs, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY ROLLUP (lang, source)""")
def quality_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "source", F.col("n_chars").alias("mean_chars"))
    return M.quality_rollup(rows, "lang", "source", values=("mean_chars",)).withColumn("mean_chars", F.round("mean_chars", 6))


# -- streams ------------------------------------------------------------------------------------------------------

@query("""
WITH e AS (
  SELECT user_id || '-' || event_id % 8 AS job_id, epoch_ms(ts::TIMESTAMP) AS t, event_id, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'error' ELSE 'start' END AS kind FROM events),
w AS (SELECT max(t) - 600000 AS w FROM e),
l AS (SELECT job_id, list({'t': t, 'kind': kind, 'status': '', 'attempt': 0, 'deadline': 0::BIGINT} ORDER BY t, event_id) AS x FROM e GROUP BY job_id),
f AS (
  SELECT job_id, list_reduce(list_concat([{'t': 0::BIGINT, 'kind': '', 'status': 'pending', 'attempt': 0, 'deadline': 0::BIGINT}], list_append(x, {'t': w, 'kind': 'end', 'status': '', 'attempt': 0, 'deadline': 0::BIGINT})),
    lambda a, y: list_transform([CASE WHEN a.status = 'running' AND y.t > a.deadline THEN CASE WHEN a.attempt >= 3 THEN 'failed' ELSE 'retrying' END ELSE a.status END], lambda s: {
      't': y.t, 'kind': y.kind,
      'status': CASE WHEN y.kind = 'start' AND s IN ('pending', 'retrying') THEN 'running' WHEN y.kind = 'ok' AND s = 'running' THEN 'done'
        WHEN y.kind = 'error' AND s = 'running' THEN CASE WHEN a.attempt >= 3 THEN 'failed' ELSE 'retrying' END ELSE s END,
      'attempt': a.attempt + CASE WHEN y.kind = 'start' AND s IN ('pending', 'retrying') THEN 1 ELSE 0 END,
      'deadline': CASE WHEN y.kind = 'start' AND s IN ('pending', 'retrying', 'running') THEN y.t + 172800000 ELSE a.deadline END})[1]) AS r
  FROM l, w)
SELECT job_id, r.status AS status, r.attempt AS attempt FROM f""")
def attempts_replayed(spark, sf_dir):
    """Events as starts and ends of attempts, through the state machine: attempts expire after two days, three are made."""
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    kind = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "error").otherwise("start")
    events = rows.select(F.concat_ws("-", "user_id", F.col("event_id") % 8).alias("job_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", kind.alias("kind"))
    at = work_folder(spark, "attempts")
    A.run_attempts(A.attempt_log(events, 2 * 86_400_000), f"{at}/log", f"{at}/checkpoint")
    return A.last_states(spark, f"{at}/log")
