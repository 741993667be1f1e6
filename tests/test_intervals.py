"""Overlap joins against all pairs, on intervals of many widths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.operators.intervals import labelled, overlap_join

KIND = "k string, i int, s double, e double"


def all_pairs(a, b):
    """Null and NaN ends and ends before starts overlap with nothing."""
    ok = lambda r: r[0] is not None and all(x is not None and not math.isnan(x) for x in r[2:]) and r[2] <= r[3]
    return sorted((x[1], y[1]) for x in a for y in b if ok(x) and ok(y) and x[0] == y[0] and x[2] < y[3] and y[2] < x[3])


def drawn(seed, n, widths):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        s = float(r.integers(-200, 200)) if i % 3 else float(r.normal() * 100)
        out.append(("a" if r.random() < 0.7 else "b", i, s, s + float(r.choice(widths)) * (1 if i % 5 else float(r.random()))))
    return out


def joined(spark, a, b):
    pairs = overlap_join(spark.createDataFrame(a, KIND), spark.createDataFrame(b, KIND), ["k"], ("s", "e"), ("s", "e"))
    return sorted((r[0], r[1]) for r in pairs.select("left.i", "right.i").collect()), pairs


@pytest.mark.parametrize("left, right", [((0.0, 0.5, 1, 2, 64), (0.0, 1, 3, 1000)), ((1e-6, 0.3), (4096, 1e6)), ((1e9, 1), (1e-3, 2, 1e9))])
def test_all_widths(spark, left, right):
    a, b = drawn(1, 250, left), drawn(2, 150, right)
    got, pairs = joined(spark, a, b)
    assert got == all_pairs(a, b) and len(got) > 20
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_edges(spark):
    inf, nan = math.inf, math.nan
    odd = [("a", 0, 0.0, 4.0), ("a", 1, 4.0, 8.0), ("a", 2, 4.0, 4.0), ("a", 3, 2.0, 2.0), ("a", 4, -inf, inf), ("a", 5, 5.0, inf), ("a", 6, nan, 3.0), ("a", 7, 1.0, nan), ("a", 8, None, 3.0),
           ("a", 9, 3.0, None), (None, 10, 0.0, 9.0), ("a", 11, 7.0, 1.0), ("a", 12, 1e300, 1.5e300), ("a", 13, -1e18, 1e18), ("a", 14, 1e15, 1e15 + 1), ("a", 15, 3.9999999, 4.0000001), ("a", 16, inf, inf), ("a", 0, 0.0, 4.0)]
    got, _ = joined(spark, odd, odd)
    assert got == all_pairs(odd, odd)
    assert joined(spark, odd, [])[0] == joined(spark, [], odd)[0] == []


def test_wide_against_many(spark):
    """One interval that spans everything meets all others without holding them in one task."""
    n = 20_000
    many = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.col("id").cast("double").alias("s"), (F.col("id") + 0.5).alias("e"))
    one = spark.createDataFrame([("a", -1, -1.0, 1e9)], "k string, i long, s double, e double")
    plain = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in plain}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        for left, right in ((many, one), (one, many)):
            pairs = overlap_join(left, right, ["k"], ("s", "e"), ("s", "e"))
            assert pairs.select("left.i", "right.i").distinct().count() == n
            held = [r[1] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(held) == n and max(held) < 0.8 * n
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_clashing_columns_and_two_keys(spark):
    rows = spark.createDataFrame([("a", 1, 0, 10, "x"), ("a", 2, 0, 10, "y"), ("a", None, 0, 10, "z")], "k string, _k0 int, _start long, _end long, left string")
    pairs = overlap_join(rows, rows, ["k", "_k0"], ("_start", "_end"), ("_start", "_end"))
    assert sorted((r.left.left, r.right.left) for r in pairs.collect()) == [("x", "x"), ("y", "y")]
    big = spark.createDataFrame([(2**60, 2**60 + 1, 1), (2**60 + 1, 2**60 + 2, 2)], "s long, e long, i int")
    assert sorted((r.left.i, r.right.i) for r in overlap_join(big, big, [], ("s", "e"), ("s", "e")).collect()) == [(1, 1), (2, 2)]


def test_labels(spark):
    segments = spark.createDataFrame([("j", 0, 0.0, 2.0, "old"), ("j", 1, 2.0, 6.0, None), ("j", 2, 90.0, 91.0, None), ("k", 0, 0.0, 1.0, None)], "job_id string, segment_id long, start_ts double, end_ts double, speaker string")
    chunks = spark.createDataFrame([("j", 0, 0.0, 3.0, "ann", "en"), ("j", 1, 3.0, 9.0, "bob", "hi"), ("j", 2, 0.0, 3.0, "cid", "de"), ("k", 0, 5.0, 6.0, "dan", "en")], "job_id string, chunk_id long, start_ts double, end_ts double, speaker string, language string")
    found = sorted((r.job_id, r.segment_id, r.speaker, r.language) for r in labelled(segments, chunks).collect())
    assert found == [("j", 0, "ann", "en"), ("j", 1, "bob", "hi"), ("j", 2, None, None), ("k", 0, None, None)]
