"""Segments, transcripts, metrics and text functions against small loops and fixed expectations."""

import random

import pytest
from pyspark.sql import functions as F

from voxmill.functions import text as T
from voxmill.operators import metrics as M
from voxmill.operators import segments as S
from voxmill.operators import transcripts as R
from voxmill.operators import validation as V


def speech_loop(silences, total):
    out, at = [], 0.0
    for a, b in silences:
        if a - at >= 0.25:
            out.append((at, a))
        at = b
    if total - at >= 0.25:
        out.append((at, total))
    return out


def windows_loop(total):
    out, start = [], 0.0
    while start < total:
        end = min(start + 30.0, total)
        out.append((start, end))
        if end >= total:
            break
        start = end - 1.0
    return out


INTERVALS = "array<struct<start:double,end:double>>"


def jobs(spark, rows):
    return spark.createDataFrame([(k, s, t) for k, (s, t) in enumerate(rows)], f"k int, silences {INTERVALS}, total double")


def found(df, column):
    return [[(s.start, s.end) for s in r.x] for r in df.select("k", column.alias("x")).orderBy("k").collect()]


CASES = [
    ([(2.0, 3.0), (5.0, 6.0)], 8.0), ([], 10.0), ([], 0.0), ([], 0.2), ([(0.0, 1.0)], 5.0), ([(4.0, 5.0)], 5.0), ([(0.0, 5.0)], 5.0),
    ([(0.25, 1.0), (1.25, 2.0), (2.2, 3.0)], 3.25), ([(1.0, 4.0), (2.0, 3.0)], 9.0), ([(1.0, 4.0), (3.0, 2.0)], 2.1),
]


def test_speech_between(spark):
    r = random.Random(1)
    rows = CASES + [([(round(a := r.uniform(0, 50), 2), round(a + r.uniform(0, 5), 2)) for _ in range(r.randrange(6))], round(r.uniform(0, 60), 2)) for _ in range(50)]
    got = found(jobs(spark, rows), S.speech_between(F.col("silences"), F.col("total")))
    assert got == [speech_loop(*x) for x in rows]
    assert got[0] == [(0.0, 2.0), (3.0, 5.0), (6.0, 8.0)]


def test_speech_between_rows(spark):
    rows = [(j, i, float(a), float(b)) for j, (s, _) in enumerate(CASES) for i, (a, b) in enumerate(s)]
    df = spark.createDataFrame(rows, "job int, i int, s double, e double")
    got = sorted(map(tuple, S.speech_between_rows(df, "job", "s", "e", ["i"], lambda w: F.max("e").over(w) + 1).collect()))
    assert got == sorted((j, a, b) for j, (s, _) in enumerate(CASES) if s for a, b in speech_loop(s, max(x[1] for x in s) + 1))


def test_fixed_windows_and_fallback(spark):
    totals = [0.0, -1.0, 0.1, 29.0, 30.0, 30.5, 59.0, 59.0001, 88.0, 88.1, 1000.0]
    got = found(jobs(spark, [([], t) for t in totals]), S.fixed_windows(F.col("total")))
    assert got == [windows_loop(t) for t in totals]
    rows = [([(0.0, 70.0)], 70.0), ([(0.0, 10.0)], 70.0), (None, 0.1)]
    assert found(jobs(spark, rows), S.segments_or_windows(F.col("silences"), F.col("total"))) == [windows_loop(70.0), [(10.0, 70.0)], [(0.0, 0.1)]]


def test_silences_from_log(spark):
    log = "silence_start: -0.01\nsilence_end: 1.5 | x\nsilence_start: 3\nfoo silence_end: 4.25\nsilence_start: 9"
    df = spark.createDataFrame([(0, log), (1, ""), (2, "silence_end: 3")], "k int, log string")
    assert found(df, S.silences_from_log(F.col("log"))) == [[(0.0, 1.5), (3.0, 4.25)], [], []]


def test_silences_from_samples(spark):
    x = [5000] * 10 + [0] * 20 + [5000] * 5 + [3] * 4 + [-9000] + [1] * 12
    df = spark.createDataFrame([(0, x), (1, []), (2, [0] * 30)], "k int, x array<int>")
    assert found(df, S.silences_from_samples(F.col("x"), 10, seconds=1.0)) == [[(1.0, 3.0), (4.0, 5.2)], [], [(0.0, 3.0)]]


def test_chunk_names_and_pairing(spark):
    assert spark.range(1).select(T.chunk_name(F.lit(7)), T.chunk_name(F.lit(12345))).first()[:] == ("chunk_0007.wav", "chunk_12345.wav")
    df = spark.createDataFrame([(["a", "b", "c"], [(0.0, 1.0), (2.0, 3.5)])], f"p array<string>, s {INTERVALS}")
    assert [tuple(x) for x in df.select(S.paired(F.col("p"), F.col("s"))).first()[0]] == [("a", 0.0, 1.0), ("b", 2.0, 3.5)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_error_rates(spark):
    r = random.Random(2)
    vocabulary = ["a", "bé", "𝔸x", "dd", "e-e", "日本"]
    rows = [(" ".join(r.choices(vocabulary, k=r.randrange(1, 12))), " ".join(r.choices(vocabulary, k=r.randrange(0, 12)))) for _ in range(40)]
    rows += [("  a  b\t", "a b"), ("", "x"), (" \n", ""), (" ".join(f"w{k}" for k in range(300)), " ".join(f"w{k}" for k in range(1, 301)))]
    df = spark.createDataFrame(rows, "r string, h string")
    for (ref, hyp), got in zip(rows, df.select(T.word_error_rate(F.col("r"), F.col("h")), T.character_error_rate(F.col("r"), F.col("h"))).collect(), strict=True):
        words, chars = ref.split(), ref.strip()
        assert got[0] == (pytest.approx(edits(words, hyp.split()) / len(words)) if words else None)
        assert got[1] == (pytest.approx(edits(chars, hyp.strip()) / len(chars)) if chars else None)


def test_strip_and_tags(spark):
    df = spark.createDataFrame([(" \t x y  \x85",), ("",), ("plain",)], "t string")
    assert [r[0] for r in df.select(T.strip(F.col("t"))).collect()] == ["x y", "", "plain"]
    got = spark.createDataFrame([("en",), ("xx",), (None,)], "l string").select(T.language_tag(F.col("l"))).collect()
    assert [r[0] for r in got] == ["eng_Latn", "xx", None]


def recognised(spark):
    seg = "array<struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double,compression_ratio:double>>"
    rows = [("j", 1, 30.0, "de", 0.5, [(0.0, 1.0, " b ", None, None, None), (1.0, 2.0, "c", -0.5, 0.1, 1.0)]), ("j", 0, 0.0, "en", 0.9, [(0.5, 1.0, "a", -0.1, None, None)]), ("k", 0, 0.0, None, None, [])]
    return spark.createDataFrame(rows, f"job_id string, chunk_id long, chunk_start double, language string, language_probability double, segments {seg}")


def test_transcript_and_language(spark):
    got = [tuple(r)[:6] for r in R.assemble(recognised(spark)).orderBy("segment_id").collect()]
    assert got == [("j", 0, 0, 0.5, 1.0, "a"), ("j", 1, 1, 30.0, 31.0, " b "), ("j", 2, 1, 31.0, 32.0, "c")]
    langs = R.job_languages(recognised(spark), spark.createDataFrame([("j",), ("k",), ("m",)], "job_id string"))
    assert sorted(map(tuple, langs.collect())) == [("j", "en", 0.9), ("k", "unknown", 0.0), ("m", "unknown", 0.0)]
    assert [tuple(r) for r in R.colliding_outputs(R.assemble(recognised(spark))).collect()] == [("j", 1, "chunk_0001.wav", 2)]


def test_metrics(spark):
    refs = spark.createDataFrame([("j", "a b c"), ("m", "x")], "job_id string, reference string")
    got = {r.job_id: r for r in M.evaluate_transcripts(R.assemble(recognised(spark)), refs).collect()}
    assert got["j"].wer == 0 and got["j"].cer == 0 and got["j"].avg_logprob == pytest.approx(-0.3) and got["j"].avg_segment_duration == pytest.approx(2.5 / 3)
    assert got["m"].wer == 1 and got["m"].avg_logprob == 0 and got["m"].avg_segment_duration == 0
    rows = spark.createDataFrame([("a", "xy", "xyz"), ("a", "", "q"), ("b", "", "")], "job_id string, source_text string, translated_text string")
    out = sorted(map(tuple, M.evaluate_translations(rows, spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")).collect()))
    assert out == [("a", 2, 2, 4, 1.0, 2.0, 2.0), ("b", 1, 0, 0, 0.0, 0.0, 1.0), ("c", 0, 0, 0, 0.0, 0.0, 1.0)]
    nan = spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "x double")
    assert nan.agg(M.mean_or_zero(F.col("x"))).first()[0] == 2.0


def test_validation(spark):
    rows = [("ok", 5, [("audio",)], "1.5"), ("empty", 0, [("audio",)], "1"), ("gone", None, None, None), ("video", 5, [("video",)], "1"), ("na", 5, [("audio",)], "N/A"), ("zero", 5, [("audio",)], "0"), ("none", 5, [("audio",)], None)]
    df = spark.createDataFrame(rows, "job_id string, size int, streams array<struct<codec_type:string>>, duration string")
    good, bad = V.split_valid(df)
    assert [r.job_id for r in good.collect()] == ["ok"]
    failed = bad.collect()
    assert len(failed) == 6 and {(r.status, r.error, r.attempt) for r in failed} == {("failed", "Input validation failed.", 1)}
    with pytest.raises(Exception, match="Unsupported bundle version"):
        spark.createDataFrame([("2.0",)], "v string").select(V.version_checked(F.col("v"))).collect()
    with pytest.raises(Exception, match="unknown status"):
        spark.range(1).select(V.valid_status(F.concat(F.lit("bo"), F.col("id").cast("string")))).collect()
