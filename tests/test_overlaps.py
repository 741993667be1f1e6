"""Words heard twice: windows with an overlap give back the text."""

import random

from pyspark.sql import functions as F

from voxmill.operators import overlaps as O


def heard(texts, jitter=0.0, seed=1):
    """Windows of 30 s each 29 s, words of 0.4 s; each window hears the words that lie in it."""
    r, rows = random.Random(seed), []
    for job, text in enumerate(texts):
        total = len(text) * 0.4
        i = 0
        while i == 0 or 29 * (i - 1) + 30 < total:
            a, b = 29.0 * i, min(29.0 * i + 30, total)
            own = [(w if r.random() < 0.5 or not jitter else w.upper(), k * 4 / 10 + r.uniform(-jitter, jitter), (k + 1) * 4 / 10 + r.uniform(-jitter, jitter)) for k, w in enumerate(text) if w and k * 4 / 10 >= a and (k + 1) * 4 / 10 <= b]
            rows.append((job, i, a, b, own or None))
            i += 1
    return rows


SCHEMA = f"job_id long, chunk_id long, start_ts double, end_ts double, words {O.WORD}"


def test_text_comes_back(spark):
    r = random.Random(2)
    texts = [[], ["one"], ["the"] * 400, r.choices(["the", "a"], k=500), [f"w{k}" for k in range(300)], ["x"] * 70 + [""] * 160 + ["y"] * 80, r.choices(["né", "日本", "no"], k=333)]
    for jitter, tolerance in ((0.0, 0.0), (0.04, 0.1)):
        out = O.heard_once(spark.createDataFrame(heard(texts, jitter), SCHEMA), tolerance=tolerance)
        back = {}
        for x in sorted(out.collect(), key=lambda x: (x.job_id, x.chunk_id)):
            back.setdefault(x.job_id, []).extend(w.word.lower() for w in x.words)
        assert [back[k] for k in range(len(texts))] == [[w for w in t if w] for t in texts]
        assert out.agg(F.sum("n_repeated")).first()[0] > 30


def test_what_isnt_shared_stays(spark):
    rows = [(1, 0, 0.0, 10.0, [("a", 1.0, 2.0), ("b", 9.2, 9.6)]), (1, 1, 10.0, 20.0, [("b", 10.0, 10.4)]), (1, 2, 19.0, 29.0, [("c", 19.1, 19.4), ("b", 19.5, 19.8)]), (2, 0, 19.0, 29.0, [("b", 19.1, 19.4)])]
    out = O.heard_once(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.job_id, x.chunk_id, x.n_repeated, len(x.words)) for x in out) == [(1, 0, 0, 2), (1, 1, 0, 1), (1, 2, 0, 2), (2, 0, 0, 1)]
    timed = spark.createDataFrame([(" a b\tc ", 1.0, 4.0), ("", 0.0, 1.0)], "t string, a double, b double").select(O.timed_words(F.col("t"), F.col("a"), F.col("b")).alias("w")).collect()
    assert [tuple(x) for x in timed[0].w] == [("a", 1.0, 2.0), ("b", 2.0, 3.0), ("c", 3.0, 4.0)] and timed[1].w == []
