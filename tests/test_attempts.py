"""The state machine of attempts: by itself, and as a stream in several runs."""

import datetime
import random

from pyspark.sql import functions as F

from voxmill.streaming import attempts as A

BEGIN = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def folded(events, timeout, limit, watermark):
    job = A.Job()
    for at, _, kind in sorted(events):
        job = A.after(job, kind, at, timeout, limit)
    return A.expired(job, watermark, limit)


def test_rules():
    go = lambda *kinds, limit=3: folded([(1000 * k, k, x) for k, x in enumerate(kinds)], 5000, limit, 0)
    assert go("start").status == "running" and go("ok", "error").status == "pending"
    assert go("start", "ok", "start", "error").status == "done"
    assert (go("start", "error").status, go("start", "error", "start").attempt) == ("retrying", 2)
    assert go("start", "error", "start", "error", "start", "error", "start").status == "failed"
    assert folded([(0, 1, "start"), (9000, 2, "ok")], 5000, 3, 0).status == "retrying"
    assert folded([(0, 1, "start"), (4000, 2, "start"), (8000, 3, "ok")], 5000, 3, 0).status == "done"
    assert folded([(0, 1, "start")], 5000, 1, 6000).status == "failed" and folded([(0, 1, "start")], 5000, 1, 5000).status == "running"


def test_stream_in_runs(spark, tmp_path):
    """Three drops, each a run from the checkpoint; the states are those of all events at once, and late events change nothing."""
    r = random.Random(5)
    schema = "job_id string, at timestamp, event_id long, kind string"
    events = [(f"j{r.randrange(40)}", BEGIN + datetime.timedelta(minutes=k), k, r.choice(["start", "start", "ok", "error", "odd"])) for k in range(600)]
    events += [(None, BEGIN, 900, "start"), ("j1", None, 901, "start"), events[5]]
    for k in range(3):
        spark.createDataFrame(events[k * 201 : (k + 1) * 201], schema).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    drop, log, checkpoint = tmp_path / "drop", str(tmp_path / "log"), str(tmp_path / "checkpoint")
    drop.mkdir()
    ms = lambda t: int(t.timestamp() * 1000)
    for k in range(3):
        for f in (tmp_path / f"in{k}").glob("*.parquet"):
            f.rename(drop / f"{k}-{f.name}")
        A.run_attempts(A.attempt_log(spark.readStream.schema(schema).parquet(str(drop)), 60 * 60_000, 3), log, checkpoint)
    got = {x.job_id: (x.status, x.attempt) for x in A.last_states(spark, log).collect()}
    own = {}
    for job, at, i, kind in events[:603]:
        if job and at:
            own.setdefault(job, set()).add((ms(at), i, kind))
    watermark = max(t for x in own.values() for t, _, _ in x) - 600_000
    want = {j: folded(x, 60 * 60_000, 3, watermark) for j, x in own.items()}
    assert got == {j: (w.status, w.attempt) for j, w in want.items()}
    assert {"done", "failed"} <= {s for s, _ in got.values()}
    late = [(j, BEGIN + datetime.timedelta(days=1), 10_000, "start") for j in own]
    spark.createDataFrame(late, schema).write.parquet(str(tmp_path / "late"))
    for f in (tmp_path / "late").glob("*.parquet"):
        f.rename(drop / f"late-{f.name}")
    A.run_attempts(A.attempt_log(spark.readStream.schema(schema).parquet(str(drop)), 60 * 60_000, 3), log, checkpoint)
    again = {x.job_id: (x.status, x.attempt) for x in A.last_states(spark, log).collect()}
    assert all(again[j] == got[j] for j in got if got[j][0] in ("done", "failed"))
    rows = spark.read.parquet(log)
    assert rows.groupBy("job_id", "seq").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count() == 0
