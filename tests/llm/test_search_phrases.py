"""Ranked search, phrase mining and fingerprints against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import LONG, TEXTS, empty, lower, rows, table
from pyspark.sql import functions as F

from voxmill.llm import collocations as C
from voxmill.llm import fingerprints as P
from voxmill.llm import lexical_search as S
from voxmill.llm import tokens as T
from voxmill.llm.shingles import shingle_sets

ITEM_SCHEMA = "item_id long, text string, score long, rank string"


def terms(text):
    return re.findall(S.TERM, lower(text or ""))


def searched(data, items, k):
    docs = [(r[0], collections.Counter(terms(r[1]))) for r in data]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    wanted = collections.defaultdict(collections.Counter)
    for item, text, *_ in items:
        wanted[item].update(terms(text))
    out = []
    for item, own in wanted.items():
        found = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(times * S.weight(n, df[t]) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in own.items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("pairs,block,k", [(1 << 20, 8192, 20), (1300, 3, 4), (2600, 7, 1)])
def test_search(spark, pairs, block, k, monkeypatch):
    """In one block of items and in many; ties, repeated rows, null ids, texts of many pieces."""
    r = random.Random(5)
    data = rows([*TEXTS, *(" ".join(r.choices(["Alpha", "beta", "GAMMA", "delta", "naïve", "日本語", "word7"], k=r.randrange(1, 9))) for _ in range(60))])
    items = [(1, "alpha beta beta", 1, None), (2, "naïve; 日本語 word7", None, "x"), (3, None, 1, "x"), (4, "nothing-like-it", 1, "x"), (1, "gamma", 1, "x"), (None, "delta ALPHA", 2, "x"), (5, LONG, 1, "x"), (6, "short", 1, "x")]
    got = S.ranked_search(table(spark, data), spark.createDataFrame(items, ITEM_SCHEMA), k=k, block_pairs=pairs, block_docs=block)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(repr(tuple(x)) for x in got.collect()) == searched(data, items, k)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "alpha", 1, "x")], ITEM_SCHEMA)
    assert S.ranked_search(empty(spark), items).count() == 0
    assert S.ranked_search(table(spark), items.limit(0)).count() == 0
    assert S.ranked_search(table(spark, [(1, "...", *[None] * 10), (2, None, *[None] * 10)]), items).count() == 0


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**9, 3], np.int64)
    assert S.lengths(n, 10**12, 10**13).tolist() == [75 + 25 * x * 10**12 // 10**13 for x in n.tolist()]


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 20])
def test_tokens(size):
    texts = pa.array(["a bB-c", None, "", "  ", "x", "Éa" * 40, "end", LONG[:300]]).slice(0)
    data, offsets = T.utf8(texts)
    found = collections.defaultdict(list)
    for row, own, ends in T.pieces(data, offsets, S.OF_TERM, size):
        words, at = T.tokens(own, ends, S.OF_TERM)
        for w, k in zip(words.to_pylist(), at.tolist(), strict=True):
            found[k + row].append(w.decode())
    assert dict(found) == {k: terms(t) for k, t in enumerate(texts.to_pylist()) if terms(t)}


def mined(data, least, words, best, covered=80):
    f, n = collections.Counter(), collections.Counter()
    for r in data:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r[1] or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, words + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    candidates = {c: a for c, a in f.items() if len(c) > 2 and a >= least}
    over = collections.defaultdict(int)
    for c, a in candidates.items():
        own = c[1:]
        for k in range(2, len(own)):
            for i in range(len(own) - k + 1):
                over[c[0], *own[i : i + k]] = max(over[c[0], *own[i : i + k]], a)
    out = collections.defaultdict(list)
    for c, a in candidates.items():
        if 100 * over[c] >= covered * a:
            continue
        s, _, l, r = min((2_000_000 * a // (f[c[: k + 1]] + f[c[0], *c[k + 1 :]]), k, f[c[: k + 1]], f[c[0], *c[k + 1 :]]) for k in range(1, len(c) - 1))
        out[c[0]].append((-s, -a, " ".join(c[1:]).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(x)[:best], 1))


def phrase_data(n=150):
    r = random.Random(2)
    vocabulary = ["the", "of", "Of", "new", "york", "city", "hall", "naïve", "日本", "a\x0bb", "x" * 50, " "]
    out = []
    for _ in range(n):
        out.append("".join(" ".join(r.choice([["new", "york", "city", "hall"], ["of", "the"], [r.choice(vocabulary)]])) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(r.randrange(1, 30))))
    return out


@pytest.mark.parametrize("options", [{}, {"size": 1}, {"size": 200, "held": 10}, {"words": 2}, {"words": 3}])
def test_collocations(spark, options):
    data = rows([*TEXTS, *phrase_data()])
    got = [tuple(r) for r in C.collocations(table(spark, data), best=25, least=5, **options).collect()]
    assert sorted(got) == mined(data, 5, options.get("words", 4), 25)
    assert len({r[0] for r in got}) == 3 and any(" " in r[2] for r in got)


def test_collocations_of_nothing(spark):
    assert C.collocations(empty(spark)).count() == 0
    assert C.collocations(table(spark), least=10**6).count() == 0


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    """With one word of 64 bits the filter lets nearly all through, and the counts are the same."""
    data = rows(phrase_data(60))
    want = mined(data, 4, 4, 50)
    monkeypatch.setattr(C, "known", lambda frequent, h: np.ones(len(h), bool))
    assert sorted(map(tuple, C.collocations(table(spark, data), best=50, least=4).collect())) == want


def test_counts_out_of_core():
    """More phrases than DuckDB's memory holds."""
    def batches():
        for k in range(40):
            n = np.arange(k * 25_000, (k + 1) * 25_000) % 700_000
            yield pa.record_batch({"lang": pa.array(["en"] * len(n)), "phrase": pa.array([f"a rather long phrase of many words {x:09d}" for x in n]), "n": pa.array(np.ones(len(n), np.int64))})

    got = pa.Table.from_batches(list(C.counted(batches(), 2, 48)))
    assert got.num_rows == 300_000 and set(got.column("n").to_pylist()) == {2}
    assert list(C.counted(iter([]), 2, 48)) == []


def test_scores_beyond_64_bits(spark):
    a = 7 * 10**15 + 1
    got = spark.createDataFrame([(a, 3 * a)], "a long, p long").select(C.score(F.col("a"), F.col("p")).alias("s")).first().s
    assert got == 2_000_000 * a // (3 * a)


def printed(data):
    """By brute force: rows by descending id, null last, then in any order."""
    key = lambda r: (r[0] is None, -(r[0] or 0))
    assert len({r[0] for r in data}) == len(data)
    own = sorted(data, key=key)
    out = {}
    for k, r in enumerate(own):
        text, after = r[1] or "", own[(k + 1) % len(own)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        out[r[0]] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), *shingle_sets([text, edited, after]))
    return out


@pytest.mark.parametrize("ranges,some", [(None, 4 << 20), (1, 1), (5, 300), (40, 1)])
def test_fingerprints(spark, ranges, some, monkeypatch):
    """In one range and in more ranges than rows; each row beside its next."""
    r = random.Random(4)
    texts = [*TEXTS, *(" ".join(r.choices([f"w{k}" for k in range(3000)], k=r.choice([3, 9, 60, 900]))) for _ in range(20))]
    data = [(k * 3, t, *x[2:]) for k, (t, x) in enumerate(zip(texts, rows(texts), strict=False))] + [(None, "a null id", *rows()[0][2:])]
    monkeypatch.setattr(P, "SOME", some)
    got = P.edited_fingerprints(table(spark, data), ranges=ranges).collect()
    want = printed(data)
    assert len(got) == len(data)
    for g in got:
        n, sha, own, edited, after = want[g.doc_id]
        assert (g.n_chars, g.edited_sha256) == (n, sha)
        prints = [P.sketch(s) for s in (own, edited, after)]
        assert (g.fingerprint, g.edited_fingerprint) == (P.as_text(prints[0]), P.as_text(prints[1]))
        assert (g.near_edited, g.near_next, g.held_edited) == (P.likeness(prints[0], prints[1]), P.likeness(prints[0], prints[2]), P.containment(prints[0], prints[1]))
        union = len(np.union1d(own, edited))
        true = len(np.intersect1d(own, edited)) / union if union else 1.0
        assert abs(g.near_edited - true) < (0.25 if union > P.LEAST else 1e-9)


def test_fingerprints_of_hard_tables(spark):
    data = rows()
    got = P.edited_fingerprints(table(spark, data)).collect()
    assert len(got) == len(data) and all(0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 for g in got)
    again = P.edited_fingerprints(table(spark, data), ranges=3).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert P.edited_fingerprints(empty(spark)).count() == 0
    one = P.edited_fingerprints(table(spark, data[3:4])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256((data[3][1][: len(data[3][1]) - len(data[3][1]) // 3] + data[3][1][: len(data[3][1]) // 3]).encode()).hexdigest()


def test_fingerprints_of_equal_lengths_and_merging():
    """A short text's share in a long one; merged fingerprints equal those of the texts together."""
    r = random.Random(6)
    w = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    sets = shingle_sets([" ".join(w), " ".join(w[4000:4600]), " ".join(w[:5000] + ["other"] * 1 + [f"v{k}" for k in range(5000)]), "tiny text"])
    long, part, half, tiny = map(P.sketch, sets)
    assert P.from_text(P.as_text(part))[0] == part[0] and (P.from_text(P.as_text(part))[1] == part[1]).all()
    assert P.containment(part, long) == 1.0 and P.likeness(part, long) < 0.05
    assert abs(P.containment(half, long) - 0.5) < 0.05
    assert P.containment(tiny, long) == 0.0 and P.likeness(tiny, tiny) == 1.0
    both = P.merged(long, half)
    want = P.sketch(np.union1d(sets[0], sets[2]))
    assert both[0] == want[0] and (both[1] == want[1]).all()
    assert abs(len(both[1]) * P.SCALE / len(np.union1d(sets[0], sets[2])) - 1) < 0.1


def test_shares_of_groups(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(10**6)}" for _ in range(6000)]
    docs = [(k, " ".join(words[k * 300 : k * 300 + 600]), "ab"[k % 2]) for k in range(18)]
    prints = [(i, g, P.as_text(P.sketches([t])[0])) for i, t, g in docs] + [(99, "c", P.as_text(P.sketches([""])[0]))]
    df = spark.createDataFrame(prints, "doc_id long, source string, fingerprint string")
    got = {(x.doc_id, x.source): x.share for x in P.shares(df, P.shingle_table(df, "source")).collect()}
    sets = {i: set(P.below(P.from_text(p), P.ALL // P.SCALE).tolist()) for i, _, p in prints}
    for i, own in sets.items():
        for g in "abc":
            held = set().union(*(sets[j] for j, h, _ in prints if h == g))
            want = len(own & held) / len(own) if own else 0
            assert math.isclose(got.get((i, g), 0), want)
