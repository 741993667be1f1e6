"""JSON documents and hand-off bundles: manifests, requests, results, zip archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schemas import BUNDLE_MANIFEST, MANIFEST_ENTRY, SYNTHESIS_REQUEST, SYNTHESIS_RESULT, parsed
from ..operators.validation import missing_files, version_checked
from .listing import found_files, known
from .media import list_files
from .zips import read_zips

VERSION = "1.0"
MANIFEST, REQUEST, REFERENCE = "manifest.json", "request/synthesis_request.json", "request/reference.wav"
REQUIRED = (MANIFEST, REQUEST, REFERENCE)


def as_json(value: Column, pretty: bool = True) -> Column:
    """A JSON document with null fields kept; the model's documents have two spaces of indent."""
    return F.to_json(value, {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files: job_id (the parent folder) and json. Tasks list and read them, where they can (see listing)."""
    if known(path):
        if found_files(spark, path, content=False).isEmpty():
            raise FileNotFoundError(f"Path does not exist: {path}")
        return found_files(spark, path).select(F.element_at(F.split("path", "/"), -2).alias("job_id"), F.col("content").cast("string").alias("json"))
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("json"), F.col("_metadata.file_path").alias("path"))
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("job_id"), "json")


def manifest_documents(chunks: DataFrame) -> DataFrame:
    """One JSON array per job, of chunk_path, start_ts and end_ts in the order of chunk_id."""
    entry = F.struct("chunk_id", F.struct("chunk_path", "start_ts", "end_ts").alias("e"))
    rows = chunks.groupBy("job_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return rows.select("job_id", as_json(F.transform("x", lambda s: s.e)).alias("json"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """job_id, chunk_id (the entry's place), chunk_path, start_ts, end_ts."""
    entries = f"array<struct<{MANIFEST_ENTRY.replace(', ', ',').replace(' ', ':')}>>"
    rows = read_documents(spark, path).select("job_id", F.posexplode(F.from_json("json", entries)).alias("chunk_id", "e"))
    return rows.select("job_id", F.col("chunk_id").cast("long").alias("chunk_id"), "e.*")


def request_documents(requests: DataFrame) -> DataFrame:
    return requests.select("job_id", as_json(F.struct("job_id", "language", "output_sample_rate", "segments")).alias("json"))


def result_documents(results: DataFrame) -> DataFrame:
    return results.select("job_id", as_json(F.struct("job_id", "sample_rate", "segments")).alias("json"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Synthesis results that came back; an incomplete document is an error."""
    return read_documents(spark, path).select(parsed(F.col("json"), SYNTHESIS_RESULT).alias("d")).select("d.*")


def bundle_files(requests: DataFrame, references: DataFrame, created_at: str) -> DataFrame:
    """Files of each job's bundle (job_id, path, content). references: job_id, content of the voice sample, which every
    job must have. The request keeps the sample's own path."""
    rows = requests.join(references.select("job_id", F.col("content").alias("voice")), "job_id", "left")
    voice = F.when(F.col("voice").isNotNull(), F.col("voice")).otherwise(F.raise_error(F.concat(F.lit("Reference audio missing: "), "job_id")).cast("binary"))
    manifest = F.struct(F.struct(F.lit(VERSION).alias("bundle_version"), "job_id", F.lit(created_at).alias("created_at")).alias("metadata"), F.struct(F.lit(REQUEST).alias("request_json"), F.lit(REFERENCE).alias("reference_audio")).alias("paths"))
    request = as_json(F.struct("job_id", "language", "output_sample_rate", "segments"))
    file = lambda path, content: F.struct(F.lit(path).alias("path"), content.cast("binary").alias("content"))
    none = F.lit(b"")
    files = F.array(file(MANIFEST, as_json(manifest)), file(REQUEST, request), file(REFERENCE, voice), file("output/", none), file("logs/", none))
    return rows.select("job_id", F.explode(files).alias("f")).select("job_id", "f.*")


def zip_bundles(files: DataFrame) -> DataFrame:
    """job_id, path (job_id.zip), content: the files of each bundle, deflated under their relative names. Folders vanish;
    a bundle that lacks a required file is an error that names it."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = set(pdf.path)
        for required in REQUIRED:
            if required not in names:
                raise FileNotFoundError(f"Missing required bundle file: {key[0]}/{required}")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in pdf.sort_values("path").itertuples():
                if not r.path.endswith("/"):
                    z.writestr(zipfile.ZipInfo(r.path), r.content, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"job_id": [key[0]], "path": [f"{key[0]}.zip"], "content": [out.getvalue()]})

    return files.select("job_id", "path", "content").groupBy("job_id").applyInPandas(pack, "job_id string, path string, content binary")


def folder_files(spark: SparkSession, root: str) -> tuple[DataFrame, Callable[[str], DataFrame]]:
    """job_id and file of all bundles' files below root/job_id, and what reads one of the files (job_id, content)."""
    parts = F.split("path", "/")
    inside = F.element_at(parts, -2) == "request"
    name = [F.when(inside, F.get(parts, F.size(parts) - 3)).otherwise(F.element_at(parts, -2)).alias("job_id"), F.when(inside, F.concat(F.lit("request/"), F.element_at(parts, -1))).otherwise(F.element_at(parts, -1)).alias("file")]

    def read(file: str) -> DataFrame:
        only = file.split("/")[-1]
        if known(root):
            rows = found_files(spark, f"{root.rstrip('/')}/*", deep=True, names=(only,))
        else:
            rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", only).load(root)
        return rows.select(*name, "content").where(F.col("file") == file).select("job_id", "content")

    there = found_files(spark, f"{root.rstrip('/')}/*", deep=True, content=False) if known(root) else list_files(spark, root)
    return there.select("path").select(*name), read


def zipped_files(spark: SparkSession, root: str) -> tuple[DataFrame, Callable[[str], DataFrame]]:
    """The same of bundles in zip archives below root: only the members that are asked for are read."""
    return read_zips(spark, root, REQUIRED, names=True).select("job_id", F.col("path").alias("file")), lambda file: read_zips(spark, root, (file,)).select("job_id", "content")


def load_bundles(spark: SparkSession, root: str, audio: bool = False, zipped: bool = False) -> DataFrame:
    """Requests of the bundles below root, folders or zip archives, after their checks: all required files, the version,
    whole documents. audio: with the voice sample as reference_audio. Only the files that are asked for are read."""
    there, read = (zipped_files if zipped else folder_files)(spark, root)
    lacking = missing_files(there.where(F.col("file").isin(*REQUIRED)), there, REQUIRED).limit(1).collect()
    if lacking:
        raise FileNotFoundError(f"Missing required bundle file: {lacking[0].job_id}/{lacking[0].file}")

    manifests = read(MANIFEST).select("job_id", parsed(F.col("content").cast("string"), BUNDLE_MANIFEST).alias("m"))
    manifests = manifests.select("job_id", version_checked(F.col("m.metadata.bundle_version")).alias("bundle_version"))
    requests = read(REQUEST).select("job_id", parsed(F.col("content").cast("string"), SYNTHESIS_REQUEST).alias("r"))
    out = manifests.join(requests, "job_id").select("job_id", "bundle_version", "r.language", "r.output_sample_rate", "r.segments")
    return out.join(read(REFERENCE).withColumnRenamed("content", "reference_audio"), "job_id") if audio else out
