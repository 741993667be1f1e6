"""Recordings in ranges against the whole ones, and the file sink's all or nothing."""

import os
import wave

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from voxmill.operators.segments import segments_or_windows
from voxmill.sources import filesink, media, recordings


def sound(seconds, rate, channels=1, seed=1):
    r = np.random.default_rng(seed)
    x = 9000 * np.sin(np.arange(int(seconds * rate))[:, None] / (3.0 + np.arange(channels))) + r.normal(0, 300, (int(seconds * rate), channels))
    for a in r.uniform(0, seconds, 6):
        x[int(a * rate) : int((a + r.uniform(0.05, 1.5)) * rate)] *= 0.001
    return x


def stored(root, name, content):
    os.makedirs(f"{root}/{name}")
    with open(f"{root}/{name}/in.wav", "wb") as f:
        f.write(content)


def wide(x, rate, width):
    out = media.io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(width)
        w.setframerate(rate)
        scaled = np.rint(x * 256 ** (width - 2)).astype("<i4")
        w.writeframes(scaled.view(np.uint8).reshape(-1, 4)[:, :width].tobytes())
    return out.getvalue()


@pytest.fixture(scope="module")
def inbox(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("inbox"))
    stored(root, "same", media.wav_bytes(sound(9, 8000), 8000))
    stored(root, "down", media.wav_bytes(sound(7, 22050, 2, 2), 22050))
    stored(root, "up", media.wav_bytes(sound(5, 6000, 1, 3), 6000))
    stored(root, "deep", wide(sound(4, 11025, 2, 4), 11025, 3))
    stored(root, "silent", media.wav_bytes(np.zeros((8000 * 3, 1)), 8000))
    stored(root, "loud", media.wav_bytes(np.full((8000 * 2, 1), 9000.0), 8000))
    stored(root, "tiny", media.wav_bytes(np.full((1, 1), 9000.0), 8000))
    stored(root, "none", media.wav_bytes(np.zeros((0, 1)), 8000))
    stored(root, "broken", b"not a wav at all")
    stored(root, "empty", b"")
    streamed = bytearray(media.wav_bytes(sound(2, 8000, 1, 9), 8000))
    streamed[40:44] = b"\xff\xff\xff\xff"
    stored(root, "streamed", bytes(streamed))
    return root


@pytest.mark.parametrize("options", [{}, {"rangeBytes": 50_000, "partitionBytes": 120_000}, {"rangeBytes": 3001, "partitionBytes": 9000}])
def test_ranges_equal_the_whole(spark, inbox, options):
    """Silences, segments and the bytes of chunks, from one range and from many."""
    pieces, results = recordings.preprocess_recordings(spark, inbox, rate=8000, **options)
    status = {r.job_id: (r.status, r.error) for r in results.collect()}
    assert {k for k, v in status.items() if v[0] == "failed"} == {"none", "broken", "empty"}
    assert "not a WAV" in status["broken"][1] and status["none"][1] == "Input validation failed."
    got = {(r.job_id, r.chunk_id): r for r in recordings.whole_chunks(pieces).collect()}
    want = {}
    for job in sorted(os.listdir(inbox)):
        if status[job][0] == "failed":
            continue
        with open(f"{inbox}/{job}/in.wav", "rb") as f:
            content = f.read()
        if job == "streamed":
            content = content[:40] + (len(content) - 44).to_bytes(4, "little") + content[44:]
        audio = media.convert(content, 8000, 1)
        x, rate = media.read_pcm(audio)
        jobs = spark.createDataFrame([(job, bytearray(audio), media.silences_of(x[:, 0], rate), len(x) / rate)], "job_id string, audio binary, silences array<struct<start:double,end:double>>, total double")
        for r in media.cut_chunks(jobs.withColumn("segments", segments_or_windows(F.col("silences"), F.col("total")))).collect():
            want[job, r.chunk_id] = r
    assert got.keys() == want.keys() and len(want) > 12
    for k, w in want.items():
        assert (got[k].chunk_path, got[k].start_ts, got[k].end_ts) == (w.chunk_path, w.start_ts, w.end_ts)
        assert bytes(got[k].content) == bytes(w.content), k
    if options:
        assert pieces.agg(F.max(F.octet_length("content"))).first()[0] <= 2 * options["rangeBytes"] + 44


def test_summaries_merge_in_any_grouping(spark, inbox):
    ranges = recordings.read_ranges(spark, inbox, rate=8000, rangeBytes=2000)
    one, many = (recordings.recording_silences(ranges, 8000, block=b).select("job_id", "silences", "total").collect() for b in (10**6, 3))
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_chunks_as_files(spark, inbox, tmp_path):
    """Pieces of a chunk become one file, in order."""
    pieces, _ = recordings.preprocess_recordings(spark, inbox, rate=8000, rangeBytes=5000)
    filesink.write_files(pieces.withColumnRenamed("chunk_path", "path"), str(tmp_path / "out"))
    for r in recordings.whole_chunks(pieces).collect():
        with open(tmp_path / "out" / r.job_id / r.chunk_path, "rb") as f:
            assert f.read() == bytes(r.content)


PLACES = {}


def elsewhere(uri):
    """A store of its own scheme."""
    return fs.SubTreeFileSystem(os.environ["VOXMILL_TEST_STORE"], fs.LocalFileSystem()), uri.removeprefix("shared://")


def seen(root):
    return sorted(os.path.relpath(f"{d}/{x}", root) for d, _, names in os.walk(root) for x in names if "/_" not in f"{d}/{x}"[len(str(root)) :])


def test_sink_commits_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "a")
    files = spark.range(40).select(F.concat(F.lit("j"), F.col("id") % 4).alias("job_id"), F.concat(F.lit("d/f"), F.col("id")).alias("path"), F.col("id").cast("string").cast("binary").alias("content")).repartition(4)
    log = filesink.write_files(files, root)
    assert log.count() == 40 and len(seen(root)) == 40
    before = {p: os.path.getmtime(f"{root}/{p}") for p in seen(root)}
    bad = files.withColumn("content", F.when(F.col("path") == "d/f7", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.lit(b"new")))
    with pytest.raises(Exception, match="broken"):
        filesink.write_files(bad, root)
    assert {p: os.path.getmtime(f"{root}/{p}") for p in seen(root)} == before
    assert filesink.write_files(files.withColumn("content", F.lit(b"again")).limit(3), root).count() == 3
    assert len(seen(root)) == 40 and sum(open(f"{root}/{p}").read() == "again" for p in seen(root)) == 3


def test_sink_of_a_repeated_task(spark, tmp_path):
    """What an attempt has left behind that wasn't reported doesn't come to sight."""
    writer = filesink.FileWriter({"path": str(tmp_path), "run": "r"}, False)
    import pyarrow as pa

    rows = lambda n: pa.record_batch({"job_id": ["j"] * n, "path": [f"f{k}" for k in range(n)], "content": pa.array([b"x"] * n, pa.binary())})
    writer.write(iter([rows(3)]))  # lost before it was reported
    done = writer.write(iter([rows(2)]))
    writer.commit([done, None])
    assert seen(tmp_path) == ["j/f0", "j/f1"] and sorted(os.listdir(tmp_path)) == ["_written-r.jsonl", "j"]
    pieces = filesink.FileWriter({"path": str(tmp_path), "run": "p"}, True)
    mixed = pa.record_batch({"job_id": ["j", "j", "j"], "path": ["a", "b", "a"], "content": pa.array([b"x"] * 3, pa.binary())})
    with pytest.raises(ValueError, match="follow"):
        pieces.write(iter([mixed]))


def test_sink_and_ranges_in_another_store(spark, tmp_path, monkeypatch):
    """A scheme that only a resolver knows."""
    os.makedirs(tmp_path / "store")
    monkeypatch.setenv("VOXMILL_TEST_STORE", str(tmp_path / "store"))
    spark.sparkContext.environment["VOXMILL_TEST_STORE"] = str(tmp_path / "store")
    files = spark.createDataFrame([("j1", "in.wav", bytearray(media.wav_bytes(sound(3, 8000), 8000)))], "job_id string, path string, content binary")
    assert filesink.write_files(files, "shared://inbox", resolver="tests.test_recordings:elsewhere").count() == 1
    assert seen(tmp_path / "store") == ["inbox/j1/in.wav"]
    _, results = recordings.preprocess_recordings(spark, "shared://inbox", rate=8000, rangeBytes=4000, resolver="tests.test_recordings:elsewhere")
    assert [(r.job_id, r.status) for r in results.collect()] == [("j1", "done")]
