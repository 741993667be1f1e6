"""Operator 4, embedding near-dedup by int8 tile products with rigorous error bounds.

Equal vectors of a label (by 128 bits of hash, which stand for the vector in every join) are one representative with a
count, summed per task before the shuffle. The representatives of a label are dealt by hash into
blocks of a bounded number of bytes, and every pair of blocks is one tile. In a tile the unit vectors u are quantised
to s q with |q| <= 127, q whole, and the rest e = u - s q is measured, so that
|u.v - s s' q.q'| <= |s q| |e'| + |e| (v being a unit vector), plus a slack for rounding. q.q' comes from a matrix
product that is exact: codes are kept as int8 and a part of a tile at a time becomes float32, which holds whole numbers
up to 2**24, or float64 for longer vectors. Pairs whose bounds
both lie on one side of the threshold are decided; the rest is computed again in double precision.
A tile sends back link counts and a spanning forest, never its pairs, so a group of near copies costs rows in
proportion to its size. Each vector meets every other of its label once: the work is quadratic in a label, as asked.

Edge cases: vectors that are null, empty or zero, or hold a null or non-finite component, and rows without a label
link with nothing; vectors of different length aren't compared; rows that share vec_id count as one vector each in
n_links, and form one component; a null vec_id has no links (component_id null, kept false); an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .components import components

BLOCK_BYTES, BLOCK_ROWS, SUB = 4 << 20, 8192, 1024
SLACK = 1e-6


class Tile:
    """One side of a tile: unit vectors, their int8 codes and what quantising lost."""

    def __init__(self, flat: np.ndarray, ids: np.ndarray, copies: np.ndarray):
        self.ids, self.copies = ids, copies
        x = flat.reshape(len(ids), -1).astype(np.float64)
        self.x = x / np.abs(x).max(axis=1, keepdims=True)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        unit = self.x / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.error = np.linalg.norm(unit - self.codes * self.scale[:, None], axis=1)
        self.length = np.linalg.norm(self.codes * self.scale[:, None], axis=1)
        self.kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64


def links_of(a: Tile, b: Tile, i: slice, j: slice, threshold: float) -> np.ndarray:
    """Boolean matrix of the links between a[i] and b[j]."""
    near = (a.codes[i].astype(a.kind) @ b.codes[j].astype(a.kind).T).astype(np.float64) * a.scale[i, None] * b.scale[None, j]
    bound = a.length[i, None] * b.error[None, j] + a.error[i, None] + SLACK
    sure, open_ = near - bound >= threshold, near + bound >= threshold
    r, c = np.nonzero(open_ & ~sure)
    for k in range(0, len(r), 1 << 16):
        p, q = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
        exact = np.einsum("ij,ij->i", a.x[i][p], b.x[j][q]) / (a.norm[i][p] * b.norm[j][q])
        sure[p, q] = exact >= threshold
    return sure


def compare(a: Tile, b: Tile, own: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of each vector of a and of b into the other side, in copies, and a forest over the positions (b's follow a's)."""
    m, n = len(a.ids), len(b.ids)
    of_a, of_b, tree, edges = np.zeros(m, np.int64), np.zeros(n, np.int64), np.arange(m + n), []
    if own:
        tree[m:] = tree[:m]
    for p in range(0, m, SUB):
        for q in range(p if own else 0, n, SUB):
            i, j = slice(p, min(p + SUB, m)), slice(q, min(q + SUB, n))
            linked = links_of(a, b, i, j, threshold)
            if own and p == q:
                linked |= linked.T
                np.fill_diagonal(linked, False)
            of_a[i] += linked @ b.copies[j]
            if not (own and p == q):
                back = a.copies[i] @ linked
                if own:
                    of_a[j] += back
                else:
                    of_b[j] += back
            for r in np.flatnonzero(linked.any(axis=1)):
                at = np.flatnonzero(linked[r]) + q + m
                roots, first = np.unique(tree[at], return_index=True)
                for root, k in zip(roots, first, strict=True):
                    if root != tree[p + r]:
                        edges.append((p + r, int(at[k])))
                        tree[tree == root] = tree[p + r]
    return of_a, of_b, edges


def tiles(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            side = lambda x: Tile(*(row[f"{x}_{n}"].values.to_numpy(zero_copy_only=False) for n in ("flat", "ids", "copies")))  # noqa: B023, E731
            a = side("a")
            own = row["i"].as_py() == row["j"].as_py()
            b = a if own else side("b")
            of_a, of_b, edges = compare(a, b, own, threshold)
            if own:
                of_a += a.copies - 1
            ids = np.concatenate([a.ids, b.ids])
            e = np.array(edges, np.int64).reshape(-1, 2)
            found = [(a.ids[of_a > 0], of_a[of_a > 0]), (b.ids[of_b > 0], of_b[of_b > 0])]
            yield pa.record_batch({
                "id": pa.array(np.concatenate([found[0][0], found[1][0], ids[e[:, 0]]]), pa.int64()),
                "links": pa.array(np.concatenate([found[0][1], found[1][1], np.zeros(len(e), np.int64)]), pa.int64()),
                "other": pa.array([None] * (len(found[0][0]) + len(found[1][0])) + ids[e[:, 1]].tolist(), pa.int64()),
            })


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v, flat = F.col("v"), vectors.schema[vector_col].dataType.elementType.typeName() == "float"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{'float' if flat else 'double'}>").alias("v"))
    good = v.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumns({"h1": F.xxhash64(F.lit(3), v), "h2": F.xxhash64(F.lit(5), v)})
    narrow = cut(rows.drop("v"))
    reps = rows.where("good").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    reps = cut(reps.withColumn("dim", F.size("v")))
    keys = reps.select("label", "h1", "h2", "id")
    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    per_block = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(64), F.floor(F.lit(block_bytes) / ((4 if flat else 8) * F.col("dim")))))
    reps = reps.join(sizes, ["label", "dim"]).withColumn("blocks", F.ceil(F.col("n") / per_block).cast("int"))
    reps = reps.withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = reps.groupBy("label", "dim", "i", "blocks").agg(F.collect_list(F.struct("id", "copies", "v")).alias("b"))
    packed = cut(packed.select("label", "dim", "i", "blocks", F.transform("b", lambda x: x.id).alias("ids"), F.transform("b", lambda x: x.copies).alias("copies"), F.flatten(F.transform("b", lambda x: x.v)).alias("flat")))
    data = ("ids", "copies", "flat")
    a = packed.select("label", "dim", "i", F.explode(F.expr("sequence(i, blocks - 1)")).alias("j"), *(F.col(c).alias(f"a_{c}") for c in data))
    b = packed.select("label", "dim", F.explode(F.expr("sequence(0, i)")).alias("i"), F.col("i").alias("j"), *(F.col(c).alias(f"b_{c}") for c in data))
    told = cut(a.join(b, ["label", "dim", "i", "j"]).mapInArrow(lambda batches: tiles(batches, threshold), "id long, links long, other long"))

    degree = told.where("other is null").groupBy(F.col("id").alias("d_id")).agg(F.sum("links").alias("links"))
    tree = components(told.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    member = narrow.where("good").join(keys, ["label", "h1", "h2"]).select("vec_id", "id")
    # a repeated vec_id with several vectors joins their components
    twice = member.groupBy("vec_id").agg(F.count_distinct("id").alias("n")).where("n > 1").select("vec_id")
    if twice.limit(1).count():
        more = member.join(twice, "vec_id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
        tree = components(more.unionByName(tree.select(F.col("id").alias("a"), F.col("component_id").alias("b"))))
    out = member.join(degree, F.col("id") == F.col("d_id"), "left").join(tree.withColumnRenamed("id", "t_id"), F.col("id") == F.col("t_id"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    rest = narrow.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH RECURSIVE g AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id <= coalesce(c.least, vec_id) AS kept
FROM embeddings v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""
QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
SQL = {"op4_embedding_dedup": OP4_SQL}
