"""Files that tasks list, write and move: the driver gets no list of them."""

import os
import pickle

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxmill.plans import backends as B
from voxmill.sources import bundles, filesink, listing, media


@pytest.fixture()
def folders(tmp_path):
    for k in range(50):
        os.makedirs(tmp_path / f"j{k}" / "output")
        (tmp_path / f"j{k}" / "output" / "synthesis_result.json").write_text(f'{{"job_id":"j{k}","sample_rate":1,"segments":[]}}')
        (tmp_path / f"j{k}" / ("_hidden" if k % 2 else "empty")).write_bytes(b"x" * (k % 2))
    os.makedirs(tmp_path / "_staging-x" / "j9")
    (tmp_path / "_staging-x" / "j9" / "synthesis_result.json").write_text("never read")
    (tmp_path / "top.txt").write_text("seen")
    return str(tmp_path)


def test_results_are_listed_by_tasks(spark, folders):
    """a driver that holds no file of the scan, and rows as Spark's own listing gives them."""
    pattern = f"{folders}/*/output/synthesis_result.json"
    back = bundles.read_results(spark, pattern)
    assert back.inputFiles() == [] and {r.job_id for r in back.collect()} == {f"j{k}" for k in range(50)} and back.count() == 50
    assert bundles.read_results(spark, f"{folders}/j{{1,2}}/output/synthesis_result.json").count() == 2  # other wildcards are Spark's
    with pytest.raises(FileNotFoundError):
        bundles.read_results(spark, f"{folders}/*/output/no.json")
    with pytest.raises(FileNotFoundError):
        bundles.read_results(spark, f"{folders}/none/x.json")
    for deep, at in ((True, f"{folders}/*"), (True, folders), (False, f"{folders}/*1/output"), (False, f"{folders}/j1*/*/*.json")):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).load(at)
        if at.endswith("/*"):  # Spark takes hidden folders that a star stands for
            listed = listed.where("path not like '%/_staging%'")
        own = listing.found_files(spark, at, deep)
        assert sorted((r.path.removeprefix("file:"), r.length, bytes(r.content)) for r in listed.collect()) == sorted((r.path, r.size, bytes(r.content)) for r in own.collect())
    assert media.list_files(spark, folders).count() == 51


def test_tasks_report_no_list_of_files(tmp_path):
    """what a task sends to the driver doesn't grow with its files."""
    rows = lambda n: pa.record_batch({"job_id": ["j"] * n, "path": [f"f{k}" for k in range(n)], "content": pa.array([b"x"] * n, pa.binary())})
    told = [filesink.FileWriter({"path": str(tmp_path), "run": "r"}, False).write(iter([rows(n)])) for n in (1, 3000)]
    assert abs(len(pickle.dumps(told[1])) - len(pickle.dumps(told[0]))) < 10


def test_moves_can_be_repeated(spark, tmp_path):
    """A move that was broken off goes on where it stopped; rows without a path are only listed."""
    root = str(tmp_path / "a")
    files = spark.range(30).selectExpr("concat('j', id % 3) AS job_id", "if(id = 7, null, concat('d/f', id)) AS path", "encode(id, 'UTF-8') AS content", "id / 4 AS more").repartition(3)
    own = filesink.stage_files(files, root)
    assert [x for x in os.listdir(root) if x[0] != "_"] == [] and own.rows().agg(F.sum("more")).first()[0] == 435 / 4
    store, top = filesink.store_of(root)
    assert sum(b.num_rows for b in filesink.placed(store, top, own.run, own.tasks[0])) > 0  # an attempt that was lost
    filesink.place_files(own)
    found = {os.path.relpath(f"{d}/{x}", root): open(f"{d}/{x}").read() for d, _, names in os.walk(root) for x in names if "/_" not in d}
    assert found == {f"j{k % 3}/d/f{k}": str(k) for k in range(30) if k != 7}
    assert own.rows().count() == 30 and os.listdir(root).count(f"_staging-{own.run}") == 0


SEGMENTS = "array<struct<segment_id:bigint,chunk_id:bigint,start_ts:double,end_ts:double,text:string,reference_audio:string>>"


def test_worker_writes_audio_once_and_all_or_none(spark, tmp_path, monkeypatch):
    """the worker's audio goes to its bundles alone; where the documents can't be written, none of it is in sight."""
    root = str(tmp_path / "b")
    asked = spark.createDataFrame([(f"j{k}", "hi", 200, [(n, 0, 0.0, 1.0, "x" * n, "r") for n in range(3)]) for k in range(4)], f"job_id string, language string, output_sample_rate long, segments {SEGMENTS}")
    filesink.write_files(bundles.bundle_files(asked, asked.select("job_id", F.encode("job_id", "UTF-8").alias("content")), "x"), root)
    kept = []
    once = B.written_once
    monkeypatch.setattr(B, "written_once", lambda df, name: kept.append(df.columns) or once(df, name))
    monkeypatch.setattr(B, "result_documents", lambda df: df.select("job_id", F.raise_error(F.lit("no document")).cast("string").alias("json")))
    with pytest.raises(Exception, match="no document"):
        B.run_bundles(spark, root, B.ToneSynthesiser(200))
    assert not any(os.listdir(f"{root}/j{k}/output") for k in range(4)) and not any(x.startswith("_staging") for x in os.listdir(root))
    monkeypatch.setattr(B, "result_documents", bundles.result_documents)
    done = B.run_bundles(spark, root, B.ToneSynthesiser(200)).collect()
    assert {(r.status, r.metrics["num_segments"]) for r in done} == {("done", 3.0)} and all(len(os.listdir(f"{root}/j{k}/output")) == 4 for k in range(4))
    assert not any("content" in c for c in kept)


def test_bundles_are_listed_by_tasks(spark, tmp_path):
    """loading holds no file on the driver; hidden folders and outputs don't matter, a missing root is an error."""
    root = str(tmp_path / "b")
    asked = spark.createDataFrame([(f"j{k}", "hi", 200, [(0, 0, 0.0, 1.0, "x", "r")]) for k in range(20)], f"job_id string, language string, output_sample_rate long, segments {SEGMENTS}")
    filesink.write_files(bundles.bundle_files(asked, asked.select("job_id", F.encode("job_id", "UTF-8").alias("content")), "x"), root)
    os.makedirs(f"{root}/_staging-y/j99/request")
    loaded = bundles.load_bundles(spark, root, audio=True)
    assert loaded.inputFiles() == [] and {(r.job_id, bytes(r.reference_audio)) for r in loaded.collect()} == {(f"j{k}", f"j{k}".encode()) for k in range(20)}
    there, _ = bundles.folder_files(spark, root)
    assert there.inputFiles() == [] and there.count() == 60
    with pytest.raises(FileNotFoundError):
        bundles.load_bundles(spark, f"{root}/none")
    open(f"{root}/j3/request/reference.wav", "wb").close()  # an empty file counts as missing, as it did
    with pytest.raises(FileNotFoundError, match="j3/request/reference.wav"):
        bundles.load_bundles(spark, root)
