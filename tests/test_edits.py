"""Banded edit distance against the full table, and on long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from voxmill.functions import edits as E
from voxmill.functions import text as T


def full(r, h):
    row = [(j, 0, 0) for j in range(len(h) + 1)]
    for i, x in enumerate(r, 1):
        new = [(i, 0, i)]
        for j, y in enumerate(h, 1):
            add = lambda c, d, s, k: (c[0] + d, c[1] + s, c[2] + k)
            new.append(min(add(row[j], 1, 0, 1), add(new[-1], 1, 0, 0), row[j - 1] if x == y else add(row[j - 1], 1, 1, 0)))
        row = new
    d, s, k = row[-1]
    return s, k, d - s - k


@pytest.mark.parametrize("first", [1, 2, 64])
def test_counts_equal_the_full_table(first, monkeypatch):
    monkeypatch.setattr(E, "FIRST", first)
    r = random.Random(first)
    cases = [([], []), (["a"], []), ([], ["a", "b"]), (["a"] * 9, ["a"] * 9), (list("kitten"), list("sitting"))]
    cases += [(r.choices("abcd", k=r.randrange(0, 30)), r.choices("abcd", k=r.randrange(0, 30))) for _ in range(150)]
    for a, b in cases:
        assert E.edit_counts(a, b) == full(a, b), (a, b)


def edited(r, words, n):
    out = list(words)
    for k in sorted(r.sample(range(len(out)), n), reverse=True):
        out[k : k + 1] = r.choice([[], ["new"], [out[k], "more"]])
    return out


def test_long_texts_cost_their_distance():
    """20,000 words: near in seconds, and wider bands only where the distance asks for them."""
    r = random.Random(3)
    words = [f"w{r.randrange(5000)}" for _ in range(20_000)]
    took = {}
    for n in (20, 900):
        other = edited(r, words, n)
        began = time.perf_counter()
        s, d, i = E.edit_counts(words, other)
        took[n] = time.perf_counter() - began
        assert n * 0.9 <= s + d + i <= n * 1.01 and len(words) - d + i == len(other)
    assert took[20] < 20 and took[900] < 60


def test_rates_of_long_transcripts(spark):
    """The banded rates equal the counts of edits, for words and characters, near and far, empty and long."""
    r = random.Random(4)
    long = [f"w{r.randrange(900)}" for _ in range(4000)]
    texts = [(" ".join(long), " ".join(edited(r, long, 150))), ("a b c", "x y"), ("", "x"), ("  ", "a"), ("a", ""), (None, "a"), ("a b", None), ("x" * 3000, "y" * 3000), ("naïve café", "naive cafe"), ("q " * 300, "q " * 290)]
    df = spark.createDataFrame(texts, "r string, h string")
    got = df.select("r", "h", T.word_error_rate(F.col("r"), F.col("h")).alias("wer"), T.character_error_rate(F.col("r"), F.col("h")).alias("cer"), T.word_edits(F.col("r"), F.col("h")).alias("e")).collect()
    for x in got:
        if x.r is None or x.h is None:
            assert x.wer is None or x.h is None
            continue
        r_, h_ = x.r.split(), x.h.split()
        assert sum(x.e) == sum(E.edit_counts(r_, h_))
        assert x.wer == (sum(x.e) / len(r_) if r_ else None)
        rc, hc = x.r.strip(), x.h.strip()
        if len(rc) < 5000:
            assert x.cer == (sum(E.edit_counts(list(rc), list(hc))) / len(rc) if rc else None)
    assert got[0].cer == spark.createDataFrame(texts[:1], "r string, h string").select((F.levenshtein("r", "h") / F.char_length("r")).alias("c")).first().c
