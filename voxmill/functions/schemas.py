"""Schemas of the data model: jobs, chunks, transcripts, translations, synthesis and bundles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STATUSES = ("pending", "running", "done", "failed", "retrying")

INTERVAL = "struct<start:double,end:double>"
STAGE_RESULT = "stage_name string, status string, output_path string, metrics map<string,double>, error string, attempt int"
JOB = f"job_id string, source_lang string, target_lang string, stages map<string,struct<{STAGE_RESULT.replace(' ', ':').replace(',:', ',')}>>, created_at string"
AUDIO_CHUNK = "chunk_id bigint, chunk_path string, start_ts double, end_ts double, duration double, status string, speaker string, language string"
MANIFEST_ENTRY = "chunk_path string, start_ts double, end_ts double"
ASR_SEGMENT = "struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,compression_ratio:double>"
ASR_OUTPUT = f"job_id string, chunk_id bigint, chunk_start double, language string, language_probability double, segments array<{ASR_SEGMENT}>, error string"
TRANSCRIPT_SEGMENT = "job_id string, segment_id bigint, chunk_id bigint, start_ts double, end_ts double, text string, avg_logprob double, no_speech_prob double, compression_ratio double"
TRANSLATED_SEGMENT = "job_id string, segment_id bigint, chunk_id bigint, start_ts double, end_ts double, source_text string, translated_text string, source_language string, target_language string"
SYNTHESIS_REQUEST = "job_id string, language string, output_sample_rate bigint, segments array<struct<segment_id:bigint,chunk_id:bigint,start_ts:double,end_ts:double,text:string,reference_audio:string>>"
SYNTHESIS_RESULT = "job_id string, sample_rate bigint, segments array<struct<segment_id:bigint,chunk_id:bigint,audio_path:string,duration:double>>"
BUNDLE_MANIFEST = "metadata struct<bundle_version:string,job_id:string,created_at:string>, paths struct<request_json:string,reference_audio:string>"

#: Fields without a default: a document that lacks one is invalid.
REQUIRED = {SYNTHESIS_REQUEST: ("job_id", "language", "segments"), SYNTHESIS_RESULT: ("job_id", "sample_rate", "segments"), BUNDLE_MANIFEST: ("metadata.job_id", "metadata.created_at", "paths.request_json", "paths.reference_audio")}
REQUIRED_SEGMENT = {SYNTHESIS_REQUEST: ("segment_id", "chunk_id", "start_ts", "end_ts", "text", "reference_audio"), SYNTHESIS_RESULT: ("segment_id", "chunk_id", "audio_path", "duration")}


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def valid_status(status: Column) -> Column:
    """The status, or an error for one that isn't known."""
    return F.when(status.isNull() | status.isin(*STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), status)))


def parsed(json_text: Column, ddl: str) -> Column:
    """A document of the model; fields that aren't in the model are ignored, a missing required one is an error."""
    doc = F.from_json(json_text, ddl)
    ok = doc.isNotNull()
    for name in REQUIRED.get(ddl, ()):
        at = doc
        for part in name.split("."):
            at = at.getField(part)
        ok = ok & at.isNotNull()
    if ddl in REQUIRED_SEGMENT:
        fields = REQUIRED_SEGMENT[ddl]
        whole = F.forall(doc.segments, lambda s: s.isNotNull() & ~F.exists(F.array(*(s.getField(f).isNull() for f in fields)), lambda x: x))
        ok = ok & F.coalesce(whole, F.lit(False))
    return F.when(ok, doc).otherwise(F.raise_error(F.concat(F.lit("invalid document: "), F.substring(F.coalesce(json_text, F.lit("null")), 1, 200))))
