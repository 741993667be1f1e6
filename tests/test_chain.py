"""The chain of steps: broken off and started again, changed settings and inputs, failing jobs, media to speech."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxmill.plans import backends as B
from voxmill.plans import chain as C
from voxmill.plans.stages import Config
from voxmill.sources import media

from .test_sources_plans import tone

JOBS = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), ("b", 1, None), ("c", 7, "z"), (None, 9, "lost")]


def jobs(spark, rows=JOBS):
    return spark.createDataFrame(rows, "job_id string, n int, text string")


def add(name, k=1, setting="", broken=False, failing=()):
    def run(rows):
        if broken:
            raise RuntimeError("lost")
        return rows.withColumn("n", F.col("n") + k).withColumn("error", F.when(F.col("job_id").isin(*failing), F.lit("bad")) if failing else F.lit(None).cast("string"))

    return C.Step(name, run, setting)


def times(spark, root, *steps):
    return {s: sorted((r.job_id, r.status, r.attempt) for r in C.step_log(spark, root, s).collect()) for s in steps}


def rows_of(spark, run, step):
    return sorted((r.job_id, r.n, r.text or "") for r in C.chain_rows(spark, run, step).collect())


def test_broken_after_any_step(spark, tmp_path):
    want = [("a", 4, "x"), ("a", 5, "y"), ("b", 4, ""), ("b", 4, ""), ("c", 10, "z")]
    once = [(j, "done", 1) for j in "abc"]
    for at in range(3):
        root = str(tmp_path / str(at))
        with pytest.raises(RuntimeError):
            C.run_chain(jobs(spark), [add(s, broken=k == at) for k, s in enumerate("pqr")], root)
        assert C.last_run(spark, root) is None
        run = C.run_chain(jobs(spark), [add(s) for s in "pqr"], root)
        assert C.last_run(spark, root) == run
        assert rows_of(spark, run, "r") == want
        assert times(spark, root, *"pqr") == {s: once for s in "pqr"}


def test_rows_without_their_log_are_made_again(spark, tmp_path):
    """An execution that was lost between its rows and its log, or while it wrote, counts for nothing."""
    root = str(tmp_path)
    jobs(spark).withColumn("n", F.lit(0)).write.parquet(f"{root}/data/p/{C.EXECUTION}=x0")
    os.makedirs(f"{root}/log/p/{C.EXECUTION}=x0/_temporary/0")
    run = C.run_chain(jobs(spark), [add("p")], root)
    assert rows_of(spark, run, "p") == [("a", 2, "x"), ("a", 3, "y"), ("b", 2, ""), ("b", 2, ""), ("c", 8, "z")]


def test_what_changes_runs_again(spark, tmp_path):
    root = str(tmp_path)
    C.run_chain(jobs(spark), [add("p"), add("q"), add("r")], root)
    run = C.run_chain(jobs(spark), [add("p"), add("q", 10, "10"), add("r")], root)
    assert rows_of(spark, run, "r")[0] == ("a", 13, "x")
    assert {s: len(x) for s, x in times(spark, root, *"pqr").items()} == {"p": 3, "q": 6, "r": 6}
    more = [("c", 8, "z") if r[0] == "c" else r for r in reversed(JOBS)] + [("d", 1, "new")]
    run = C.run_chain(jobs(spark, more).select("text", "job_id", "n"), [add("p"), add("q", 10, "10"), add("r")], root)
    assert {s: len(x) for s, x in times(spark, root, *"pqr").items()} == {"p": 5, "q": 8, "r": 8}
    assert rows_of(spark, run, "r") == [("a", 13, "x"), ("a", 14, "y"), ("b", 13, ""), ("b", 13, ""), ("c", 20, "z"), ("d", 13, "new")]
    back = C.run_chain(jobs(spark), [add("p"), add("q"), add("r")], root)  # the first state is still there
    assert {s: len(x) for s, x in times(spark, root, *"pqr").items()} == {"p": 5, "q": 8, "r": 8}
    assert rows_of(spark, back, "r")[0] == ("a", 4, "x")


def test_failing_jobs(spark, tmp_path):
    root = str(tmp_path)
    for failing in (("a", "b"), ("a",), ("a",), ("a",), ("a",)):
        run = C.run_chain(jobs(spark), [add("p", failing=failing), add("q")], root)
    assert times(spark, root, "p")["p"] == [("a", "failed", 1), ("a", "failed", 2), ("a", "failed", 3), ("b", "done", 2), ("b", "failed", 1), ("c", "done", 1)]
    found = sorted((r.job_id, r.stage_name, r.status, r.attempt, r.error, r.metrics["num_rows"]) for r in C.chain_results(spark, run).collect())
    assert found == [("a", "p", "failed", 3, "bad", 2.0), ("b", "p", "done", 2, None, 2.0), ("b", "q", "done", 1, None, 2.0), ("c", "p", "done", 1, None, 1.0), ("c", "q", "done", 1, None, 1.0)]


def test_edges(spark, tmp_path):
    none = spark.createDataFrame([], jobs(spark).schema)
    run = C.run_chain(none, [add("p"), add("q")], f"{tmp_path}/empty")
    assert C.chain_rows(spark, run, "q").count() == C.chain_results(spark, run).count() == 0
    assert C.chain_rows(spark, run, "q").columns == ["job_id", "n", "text", "error"]
    gone = C.run_chain(jobs(spark), [C.Step("p", lambda rows: rows.where("false")), add("q")], f"{tmp_path}/gone")
    assert {(r.status, r.metrics["num_rows"]) for r in C.chain_results(spark, gone).collect()} == {("done", 0.0)}
    clash = jobs(spark).withColumns({c: F.lit("own") for c in ("key", "status", "attempt", "failures", "h", "s0")})
    run = C.run_chain(clash, [add("p"), add("q")], f"{tmp_path}/clash")
    assert {r.key for r in C.chain_rows(spark, run, "q").collect()} == {"own"}
    with pytest.raises(ValueError, match="names"):
        C.run_chain(none, [add("p"), add("p")], f"{tmp_path}/twice")
    with pytest.raises(ValueError, match=C.EXECUTION):
        C.run_chain(jobs(spark), [C.Step("p", lambda rows: rows.withColumn(C.EXECUTION, F.lit(1)))], f"{tmp_path}/own")
    bad = C.run_chain(jobs(spark), [add("p", failing=("a", "b", "c")), add("q")], f"{tmp_path}/bad")
    assert C.chain_rows(spark, bad, "q").count() == 0 and C.chain_results(spark, bad).count() == 3
    assert isinstance(C.chain_rows(spark, bad, "p").schema, StructType)


def test_fingerprints_count_rows(spark):
    key = lambda rows: {r.job_id: r.key for r in C.fingerprints(jobs(spark, rows)).collect()}
    assert key(JOBS) == key(JOBS[::-1])
    assert key(JOBS)["b"] != key([("b", 1, None)])["b"] != key([("b", 1, "")])["b"]


class CountedSynthesiser(B.ToneSynthesiser):
    def speaker(self, reference):
        if reference == b"broken":
            raise OSError("no voice")
        return super().speaker(reference)


def test_media_to_speech(spark, tmp_path):
    """One bad job of each kind; a mended voice runs the last step again, for that setting only."""
    files = [("fine", tone(6, quiet=[(2, 3.5)])), ("mute", tone(3)), ("hoarse", tone(3)), ("noise", b"no wav")]
    rows = spark.createDataFrame([(j, len(x), bytearray(x)) for j, x in files], "job_id string, size long, content binary")
    voices = lambda *v: spark.createDataFrame([(j, bytearray(x)) for j, x in v], "job_id string, content binary")
    steps = lambda v, version: C.speech_steps(Config(), B.StubRecogniser(), B.StubTranslator(), CountedSynthesiser(8000), "hi", v, version)
    root = str(tmp_path)
    run = C.run_chain(rows, steps(voices(("fine", b"v"), ("hoarse", b"broken"), ("noise", b"v")), "1"), root)
    found = {(r.job_id, r.stage_name): (r.status, r.error) for r in C.chain_results(spark, run).collect()}
    assert found[("fine", "tts")] == ("done", None) and found[("hoarse", "tts")] == ("failed", "OSError: no voice")
    assert found[("mute", "tts")] == ("failed", "Reference audio missing: mute")
    assert found[("noise", "preprocess")] == ("failed", "Input validation failed.") and ("noise", "asr") not in found
    made = C.chain_rows(spark, run, "tts").collect()
    assert {r.job_id for r in made} == {"fine"} and len(made) == 4 and all(media.probe_wav(r.content)["duration"] > 0 for r in made)
    run = C.run_chain(rows, steps(voices(("fine", b"v"), ("hoarse", b"v"), ("mute", b"v")), "2"), root)
    assert {r.job_id for r in C.chain_rows(spark, run, "tts").collect()} == {"fine", "hoarse", "mute"}
    assert {s: C.step_log(spark, root, s).where("status = 'done'").count() for s in ("preprocess", "asr", "translation", "tts")} == {"preprocess": 3, "asr": 3, "translation": 3, "tts": 4}
