"""Connected components of a link table, for the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove_path, shared_path


def find(parent: dict, x):
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while (up := parent.get(x, x)) != root:
        parent[x] = root
        x = up
    return root


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node of its tree) for the nodes of these links, without the smallest ones."""
    parent: dict = {}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(parent, x), find(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, find(parent, x)) for x in list(parent)]


def contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of a partition as stars, batch by batch, so that a task holds one star per node it has seen."""
    own = np.zeros((0, 2), np.int64)
    for pdf in batches:
        own = np.array(forest(np.append(own[:, 0], pdf.a.to_numpy()), np.append(own[:, 1], pdf.b.to_numpy())), np.int64).reshape(-1, 2)
    yield pd.DataFrame({"a": own[:, 0], "b": own[:, 1]})


def components(links: DataFrame) -> DataFrame:
    """From links (a, b; long): id and component_id, the smallest id reachable, of all ids that have a link to another.

    Alternating stars: each round hangs every node and its larger neighbours on the smallest node it sees, then every
    node's smaller neighbours; rounds grow with the logarithm of a component's width. Minima are summed per task and joined
    back to rows of two numbers. A task contracts its links first and holds a star per node that it has seen, so a node
    has a link per task at most when the rounds begin. Links with a null end don't count.
    """
    spark, top = links.sparkSession, shared_path(links.sparkSession, "components")
    steps = 0

    def kept(df: DataFrame) -> DataFrame:
        """Written, and what was written three steps before, which nothing reads any more, removed. (A checkpoint would carry
        the plan's estimate of its size along, and products of estimates over the rounds grow beyond measure.)"""
        nonlocal steps
        df.write.parquet(f"{top}/{steps}")
        if steps > 2:
            remove_path(spark, f"{top}/{steps - 3}")
        steps += 1
        return spark.read.schema(df.schema).parquet(f"{top}/{steps - 1}")

    edges = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = kept(edges.mapInPandas(contracted, "a long, b long").distinct())
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = kept(both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("n"))
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s")).select("s.a", "s.b").where("a <> b").distinct()
        edges = kept(small)
