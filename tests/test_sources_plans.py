"""Media, bundles, backends, stages, streams and the queries' contract, end to end on small files."""

import io
import json
import os
import wave
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from voxmill.functions.schemas import SYNTHESIS_REQUEST, SYNTHESIS_RESULT, parsed
from voxmill.operators import transcripts as R
from voxmill.plans import backends as B
from voxmill.plans import queries as Q
from voxmill.plans import stages as P
from voxmill.sources import bundles, filesink, media
from voxmill.streaming import drops

DATA = "/root/testdata/sf0.001"


def tone(seconds, rate=8000, quiet=()):
    x = 9000 * np.sin(np.arange(int(seconds * rate)) / 5.0)
    for a, b in quiet:
        x[int(a * rate) : int(b * rate)] = 0
    return media.wav_bytes(np.stack([x, x], axis=1), rate)


@pytest.fixture()
def inbox(tmp_path):
    for name, content in (("j1", tone(6, quiet=[(2, 3.5)])), ("j2", tone(3)), ("j3", b""), ("j4", b"not a wav")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "in.wav").write_bytes(content)
    return str(tmp_path)


def test_preprocess_to_synthesis(spark, inbox, tmp_path):
    files = media.list_files(spark, inbox)
    expected = spark.createDataFrame([(f"j{k}",) for k in range(1, 6)], "job_id string")
    chunks, results = P.Preprocess().run(files, expected=expected)
    by_job = {r.job_id: r for r in results.collect()}
    assert {k: r.status for k, r in by_job.items()} == {"j1": "done", "j2": "done", "j3": "failed", "j4": "failed", "j5": "failed"}
    metrics = by_job["j1"].metrics
    assert metrics.pop("latency_ms") > 0 and metrics == {"sample_rate": 16000.0, "channels": 1.0, "num_segments": 2.0}
    rows = sorted((r.job_id, r.chunk_id, r.chunk_path, round(r.start_ts, 2), round(r.end_ts, 2)) for r in chunks.collect())
    assert rows == [("j1", 0, "chunk_0000.wav", 0.0, 2.0), ("j1", 1, "chunk_0001.wav", 3.5, 6.0), ("j2", 0, "chunk_0000.wav", 0.0, 3.0)]
    x, rate = media.read_pcm(chunks.where("job_id = 'j1' and chunk_id = 1").first().content)
    assert rate == 16000 and x.shape[1] == 1 and abs(len(x) / rate - 2.5) < 0.01

    heard = B.recognise(chunks, B.StubRecogniser())
    segments, languages = R.assemble(heard), R.job_languages(heard)
    assert segments.where("job_id = 'j1'").count() == 4
    translated = R.translate(segments, languages, "hi", B.TranslationBackend(B.StubTranslator()))
    assert translated.where("job_id = 'j2' and segment_id = 0").first().translated_text == "[hin_Deva]  word0 "
    requests = R.synthesis_requests(translated, "voices/ref.wav")
    voices = spark.createDataFrame([("j1", bytearray(b"v1")), ("j2", bytearray(b"v2"))], "job_id string, content binary")
    made = B.synthesise(requests, voices, B.ToneSynthesiser())
    assert made.count() == 7 and made.select("job_id", "audio_path").distinct().count() == 7 and made.where("error is not null").count() == 0
    done = B.results_of(made)
    assert R.missing_outputs(requests, done.where("job_id = 'j1'")).count() == 3
    assert {r.status for r in B.submitted(requests).collect()} == {"pending"}

    out = str(tmp_path / "bundles")
    assert filesink.write_files(bundles.bundle_files(requests, voices, "2024-01-01T00:00:00Z"), out).count() == 10
    manifest = json.load(open(f"{out}/j1/manifest.json"))
    assert manifest["metadata"] == {"bundle_version": "1.0", "job_id": "j1", "created_at": "2024-01-01T00:00:00Z"}
    assert os.path.isdir(f"{out}/j1/output") and os.path.isdir(f"{out}/j1/logs")
    loaded = {r.job_id: r for r in bundles.load_bundles(spark, out, audio=True).collect()}
    assert len(loaded["j1"].segments) == 4 and loaded["j2"].output_sample_rate == 24000 and bytes(loaded["j2"].reference_audio) == b"v2"
    ran = {r.job_id: r for r in B.run_bundles(spark, out, B.ToneSynthesiser()).collect()}
    assert {r.status for r in ran.values()} == {"done"} and ran["j1"].metrics["num_segments"] == 4 and ran["j1"].metrics["latency_ms"] > 0
    with open(f"{out}/j1/output/chunk_0000_seg_000000.wav", "rb") as f:
        assert media.read_pcm(f.read())[1] == 24000
    back = bundles.read_results(spark, f"{out}/*/output/synthesis_result.json")
    assert back.count() == 2 and R.missing_outputs(requests, back).count() == 0
    assert len(bundles.load_bundles(spark, out).collect()) == 2  # with its outputs, a bundle is still one
    zipped = bundles.zip_bundles(bundles.bundle_files(requests, voices, "x")).where("job_id = 'j1'").first()
    assert zipped.path == "j1.zip" and sorted(zipfile.ZipFile(io.BytesIO(zipped.content)).namelist()) == sorted(bundles.REQUIRED)
    os.remove(f"{out}/j2/request/reference.wav")
    with pytest.raises(FileNotFoundError, match="j2/request/reference.wav"):
        bundles.load_bundles(spark, out)
    with pytest.raises(Exception, match="Missing required bundle file"):
        bundles.zip_bundles(bundles.bundle_files(requests, voices, "x").where("path <> 'manifest.json'")).collect()
    with pytest.raises(Exception, match="Reference audio missing"):
        bundles.bundle_files(requests, voices.where("job_id = 'j1'"), "x").collect()


def test_five_jobs_at_once(spark):
    """One breaks in the decoder, after its probe; the others are done."""

    def decoder(content):
        if content.endswith(b"bad"):
            raise OSError("no such codec")
        return media.read_pcm(content)

    jobs = [(f"j{k}", len(tone(2)), bytearray(tone(2) + (b"bad" if k == 3 else b""))) for k in range(5)]
    df = spark.createDataFrame(jobs, "job_id string, size long, content binary").repartition(5)
    chunks, results = P.Preprocess(decoder=decoder).run(df)
    got = {r.job_id: (r.status, r.error) for r in results.collect()}
    assert got == {f"j{k}": ("failed", "OSError: no such codec") if k == 3 else ("done", None) for k in range(5)}
    assert sorted(r.job_id for r in chunks.collect()) == ["j0", "j1", "j2", "j4"]
    assert P.Preprocess().validate(df).where("valid").count() == 5


def test_other_formats_need_their_programs(spark):
    df = spark.createDataFrame([("j", 3, bytearray(b"abc"))], "job_id string, size long, content binary")
    assert P.Preprocess(prober=media.FfmpegProber("no-such-ffprobe")).run(df)[1].first().status == "failed"
    found = {"streams": [{"codec_type": "audio"}], "duration": 1.0}
    failed = P.Preprocess(prober=lambda content: found, decoder=media.FfmpegDecoder("no-such-ffmpeg")).run(df)[1].first()
    assert failed.error == "RuntimeError: no-such-ffmpeg is not installed."


def test_ffmpeg_by_pipes(tmp_path):
    """With programs that stand in for ffprobe and ffmpeg."""
    (tmp_path / "in.wav").write_bytes(tone(1))
    for name, body in (("ffprobe", """cat > /dev/null; echo '{"streams":[{"codec_type":"video"},{"codec_type":"audio","sample_rate":"8000","channels":2}],"format":{"duration":"1.5"}}'"""), ("ffmpeg", f"cat > /dev/null; cat {tmp_path}/in.wav"), ("broken", "echo nothing to read >&2; exit 1")):
        (tmp_path / name).write_text(f"#!/bin/sh\n{body}\n")
        (tmp_path / name).chmod(0o755)
    assert media.FfmpegProber(str(tmp_path / "ffprobe"))(b"x") == {"streams": [{"codec_type": "video"}, {"codec_type": "audio"}], "duration": 1.5, "sample_rate": 8000, "channels": 2}
    x, rate = media.FfmpegDecoder(str(tmp_path / "ffmpeg"))(b"x")
    assert rate == 8000 and (x == media.read_pcm(tone(1))[0]).all()
    assert media.FfmpegProber(str(tmp_path / "broken"))(b"x") is None
    with pytest.raises(ValueError, match="nothing to read"):
        media.FfmpegDecoder(str(tmp_path / "broken"))(b"x")


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("frames", [0, 1000, 1001])
def test_pcm_of_any_width(width, frames):
    values = np.random.default_rng(width).integers(-128, 128, (frames, 2)) << (8 * (width - 1))
    raw = (values + 128).astype(np.uint8).tobytes() if width == 1 else values.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(width)
        w.setframerate(8000)
        w.writeframes(raw)
    x, rate = media.read_pcm(out.getvalue())
    assert rate == 8000 and x.shape == (frames, 2) and np.allclose(x, values * 2.0 ** (16 - 8 * width))
    assert len(media.read_pcm(media.convert(out.getvalue()))[0]) == 2 * frames


def test_resampling_keeps_the_band():
    """What lies above half of the new rate goes, what lies below stays."""
    at = np.arange(48000) / 48000
    low, high = 8000 * np.sin(2 * np.pi * 1000 * at), 8000 * np.sin(2 * np.pi * 15000 * at)
    power = lambda x: np.abs(media.read_pcm(media.convert(media.wav_bytes(x, 48000)))[0][800:-800]).max()
    assert abs(power(low) - 8000) < 200 and power(high) < 100


def test_silences_of_samples():
    x = np.full(32000, 9000.0)
    x[:8000], x[12000:20000], x[24000:24100] = 0, 10, 0
    assert media.silences_of(x, 16000) == [{"start": 0.0, "end": 0.5}, {"start": 0.75, "end": 1.25}]
    assert media.silences_of(np.zeros(16000), 16000) == [{"start": 0.0, "end": 1.0}] and media.silences_of(np.zeros(0), 16000) == []


def test_external_synthesis(spark, tmp_path):
    segment = (0, 0, 0.0, 1.0, "text", "voice.wav")
    requests = spark.createDataFrame([("a", "hi", 24000, [segment]), ("b", "hi", 24000, [segment])], SYNTHESIS_REQUEST)
    exchange = B.FolderExchange(str(tmp_path))
    assert {(r.job_id, r.status) for r in exchange.export_requests(requests).collect()} == {("a", "pending"), ("b", "pending")}
    sent = json.loads((tmp_path / "a" / "synthesis_request.json").read_text())
    assert sent["segments"][0]["text"] == "text" and sent["output_sample_rate"] == 24000
    (tmp_path / "a" / "synthesis_result.json").write_text('{"job_id":"a","sample_rate":24000,"segments":[{"segment_id":0,"chunk_id":0,"audio_path":"x","duration":1.0}]}')
    assert [r.job_id for r in exchange.import_results(spark).collect()] == ["a"]
    assert [tuple(r) for r in R.missing_outputs(requests, exchange.import_results(spark)).collect()] == [("b", 0)]


class Mute(B.ToneSynthesiser):
    def synthesise(self, text, speaker, language):
        if text == "mute":
            raise ValueError("no voice")
        return super().synthesise(text, speaker, language)


def test_synthesis_in_groups(spark):
    """Groups of segments give what one call gives; a segment that fails leaves the others, and its job is failed."""
    segments = [(k, 0, 0.0, 1.0, "mute" if k == 70 else f"text {k}", "voice.wav") for k in range(150)]
    requests = spark.createDataFrame([("a", "hi", 800, segments), ("b", "hi", 800, segments[:70]), ("c", "hi", 800, [])], SYNTHESIS_REQUEST)
    voices = spark.createDataFrame([(x, bytearray(x.encode())) for x in "abc"], "job_id string, content binary")
    made = B.synthesise(requests, voices, Mute(800))
    rows = made.collect()
    assert len(rows) == 220 and [r.segment_id for r in rows if r.error] == [70]
    one = {(r.job_id, r.segment_id): bytes(r.content) for r in B.synthesise(requests, voices, Mute(800), at_once=1000).collect() if r.content}
    assert one == {(r.job_id, r.segment_id): bytes(r.content) for r in rows if r.content}
    other = B.synthesise(requests, voices, Mute(800, temperature=9.0)).where("job_id = 'b' and segment_id = 1").first()
    assert bytes(other.content) != one["b", 1]
    results = {r.job_id: r for r in B.stage_results_of(made).collect()}
    assert (results["a"].status, results["a"].error, results["b"].status) == ("failed", "ValueError: no voice", "done")
    assert {r.job_id: len(r.segments) for r in B.results_of(made).collect()} == {"a": 149, "b": 70}


def test_manifest_and_result_documents(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "chunk_0001.wav", 2.0, 3.5), ("a", 0, "chunk_0000.wav", 0.0, 1.0)], "job_id string, chunk_id long, chunk_path string, start_ts double, end_ts double")
    doc = bundles.manifest_documents(rows).first().json
    assert json.loads(doc) == [{"chunk_path": "chunk_0000.wav", "start_ts": 0.0, "end_ts": 1.0}, {"chunk_path": "chunk_0001.wav", "start_ts": 2.0, "end_ts": 3.5}]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "manifest.json").write_text(doc)
    back = bundles.read_manifests(spark, f"{tmp_path}/a/manifest.json")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    good = '{"job_id":"a","sample_rate":24000,"more":1,"segments":[{"segment_id":0,"chunk_id":0,"audio_path":"x","duration":1.0}]}'
    df = spark.createDataFrame([(good,)], "j string")
    assert df.select(parsed(F.col("j"), SYNTHESIS_RESULT).alias("d")).first().d.segments[0].audio_path == "x"
    for bad in ('{"job_id":"a","segments":[]}', '{"job_id":"a","sample_rate":1,"segments":[{"segment_id":0}]}', "junk"):
        with pytest.raises(Exception, match="invalid document"):
            spark.createDataFrame([(bad,)], "j string").select(parsed(F.col("j"), SYNTHESIS_RESULT)).collect()
    nulls = spark.createDataFrame([(None,)], "x string").select(bundles.as_json(F.struct("x"), pretty=False)).first()[0]
    assert json.loads(nulls) == {"x": None}


def test_backends_must_be_loaded():
    with pytest.raises(RuntimeError):
        B.StubRecogniser().transcribe(b"")
    with pytest.raises(RuntimeError):
        B.StubTranslator().translate(["p"], ["t"], ["a"], ["b"])
    for call in (lambda: B.WhisperRecogniser("none").transcribe(b""), lambda: B.SequenceTranslator("none").translate(["p"], ["t"], ["a"], ["b"]), lambda: B.VoiceCloner("none").speaker(b"")):
        with pytest.raises((RuntimeError, AttributeError)):
            call()
    assert B.settings(B.WhisperRecogniser("m", "cpu")) != B.settings(B.WhisperRecogniser("m", "cuda"))


def test_config_and_preflight(spark):
    c = P.Config.read('asr:\n  model: "small"\n  vad_filter: false\n\naudio:\n  sample_rate: 8000  # Hz\n  other: 1\n')
    assert (c.asr_model, c.asr_vad_filter, c.audio_sample_rate, c.audio_channels) == ("small", False, 8000, 1)
    assert P.preflight(spark, modules=("numpy",), gpu=False).first().numpy == np.__version__
    with pytest.raises(RuntimeError, match="no_such_module"):
        P.preflight(spark, modules=("no_such_module",), gpu=False)


def test_latest_attempt(spark):
    rows = [("a", "asr", "failed", None, {}, "x", 1), ("a", "asr", "done", "p", {"n": 1.0}, None, 2), ("b", "asr", "failed", None, {}, "y", 1)]
    df = spark.createDataFrame(rows, "job_id string, stage_name string, status string, output_path string, metrics map<string,double>, error string, attempt int")
    assert sorted((r.job_id, r.status) for r in P.latest_attempt(df).collect()) == [("a", "done"), ("b", "failed")]


def test_streams(spark, tmp_path):
    rows = [{"job_id": "a", "segment_id": k, "chunk_id": 0, "source_text": "ab", "translated_text": "abc"} for k in range(3)]
    (tmp_path / "1.json").write_text("\n".join(map(json.dumps, rows)))
    q = drops.running_translation_metrics(drops.translated_drops(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("running").collect()] == [("a", 3, 6, 9, 1.5)]
    events = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:00:20"), ("u", "2024-01-01 00:05:00")], "u string, t string").select("u", F.col("t").cast("timestamp").alias("ts"))
    assert sorted(r.events for r in drops.activity_sessions(events, "u").collect()) == [1, 2]


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_equal_sql(spark, name):
    got = Q.QUERIES[name](spark, DATA)
    c = duckdb.connect()
    for t in ("events", "documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.execute(Q.SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    tidy = lambda rows: sorted(repr(tuple(None if x != x else float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else x for x in r)) for r in rows)
    assert tidy(map(tuple, got.select(*names).collect())) == tidy(want[names].astype(object).where(want[names].notna(), None).itertuples(index=False, name=None))


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


class PickyRecogniser(B.StubRecogniser):
    def transcribe(self, audio):
        if len(audio) > 40_000:
            raise ValueError("too long")
        return super().transcribe(audio)


class PickySynthesiser(B.ToneSynthesiser):
    def speaker(self, reference):
        if reference == b"broken":
            raise OSError("no voice")
        return super().speaker(reference)


def test_failures_stay_with_their_jobs(spark, inbox, tmp_path):
    """A bad chunk, a bad voice and a bad file: each fails its own job; a finished stage's manifest is there."""
    at = str(tmp_path / "artifacts")
    chunks, results = P.Preprocess().run(media.list_files(spark, inbox), artifacts=at)
    done = {r.job_id: r for r in results.collect()}
    assert {k: r.output_path for k, r in done.items()} == {"j1": f"{at}/j1/manifest.json", "j2": f"{at}/j2/manifest.json", "j4": None}
    assert [e["chunk_path"] for e in json.load(open(done["j1"].output_path))] == ["chunk_0000.wav", "chunk_0001.wav"]
    assert sorted(os.listdir(f"{at}/j1/chunks")) == ["chunk_0000.wav", "chunk_0001.wav"]

    limit = chunks.groupBy().agg(F.max(F.octet_length("content"))).first()[0]
    assert limit > 40_000
    heard = B.recognise(chunks, PickyRecogniser())
    status = {r.job_id: (r.status, r.error, r.metrics["failed_chunks"]) for r in B.recognition_results(heard).collect()}
    bad = {r.job_id for r in chunks.where(F.octet_length("content") > 40_000).select("job_id").collect()}
    assert {j for j, s in status.items() if s[0] == "failed"} == bad and all(status[j][1] == "ValueError: too long" for j in bad)
    assert {r.job_id for r in R.assemble(heard).select("job_id").collect()} == {r.job_id for r in chunks.where(F.octet_length("content") <= 40_000).collect()}

    segment = "array<struct<segment_id:bigint,chunk_id:bigint,start_ts:double,end_ts:double,text:string,reference_audio:string>>"
    requests = spark.createDataFrame([(j, "hi", 24000, [(0, 0, 0.0, 1.0, "x", "r"), (1, 0, 1.0, 2.0, "y", "r")]) for j in ("a", "b")], f"job_id string, language string, output_sample_rate bigint, segments {segment}")
    voices = spark.createDataFrame([("a", bytearray(b"broken")), ("b", bytearray(b"fine"))], "job_id string, content binary")
    made = B.synthesise(requests, voices, PickySynthesiser())
    by_job = {r.job_id: (r.status, r.error, r.metrics["failed_segments"]) for r in B.stage_results_of(made).collect()}
    assert by_job == {"a": ("failed", "OSError: no voice", 2.0), "b": ("done", None, 0.0)}
