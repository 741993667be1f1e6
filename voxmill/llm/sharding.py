"""Operator 8, sharding by vector bin packing.

Rows of equal text form a group with a vector of bytes, tokens and rows. Groups that hold a `units`-th of a total in
some dimension (3 x units of them at most) are placed one by one; the others are dealt by hash into `units` units,
which are placed as wholes. Largest first, each goes to the shard where the dot product of its vector with the
shard's residual capacity is highest; moves that bring the bytes closer together follow. So the driver sees 4 x units
vectors however many documents there are, and as many again of split groups.

A group larger than a shard's share can't be balanced whole: its rows are numbered (per cell, with the cells' offsets)
and dealt in turn into pieces, which differ by one row at most whatever the ids are. Where groups below a share still
leave the shards' bytes further apart than the largest row and `tolerance` of a share, groups above a half of a share
are split as well, then above a quarter, down to a sixteenth; otherwise groups stay whole. Slots are numbered per
(shard, cell), with the cells' offsets from a table of n_shards x cells rows, so no shard is one task.

Edge cases: a null text has no bytes (size 1) and equals the empty text; a null id is an id; repeated rows are rows,
and repeated ids don't bring rows together; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, text_of, words_in

UNITS, CELLS, TOLERANCE, LEAST_SPLIT = 4096, 1024, 0.005, 1 / 16


def place(vectors: np.ndarray, n_shards: int, rounds: int = 400) -> np.ndarray:
    """Shard of each vector (columns: bytes, tokens, rows), by the dot product with the residual capacities."""
    share = vectors / np.maximum(vectors.sum(axis=0), 1)
    left = np.full((n_shards, vectors.shape[1]), 1.0 / n_shards)
    shard = np.zeros(len(vectors), dtype=np.int64)
    order = np.argsort(-share.max(axis=1), kind="stable")
    for i in order:
        shard[i] = j = int(np.argmax(left @ share[i]))
        left[j] -= share[i]
    by_bytes = share[:, 0]
    for _ in range(rounds):  # from the fullest to the emptiest shard, in bytes: a move, or a swap of nearly equal ones
        load = np.bincount(shard, by_bytes, n_shards)
        a, b = int(load.argmax()), int(load.argmin())
        gap = (load[a] - load[b]) / 2
        ours, theirs = np.flatnonzero(shard == a), np.flatnonzero(shard == b)
        if gap < 1e-5 or not len(ours):
            break
        theirs = np.append(theirs, -1)
        theirs = theirs[np.argsort(np.append(by_bytes[theirs[:-1]], 0.0), kind="stable")]
        have = np.where(theirs < 0, 0.0, by_bytes[theirs])
        k = np.clip(np.searchsorted(have, by_bytes[ours] - gap), 0, len(have) - 1)
        k = np.where((k > 0) & (np.abs(by_bytes[ours] - have[k - 1] - gap) < np.abs(by_bytes[ours] - have[k] - gap)), k - 1, k)
        off = np.abs(by_bytes[ours] - have[k] - gap)
        best = int(off.argmin())
        if off[best] >= gap * (1 - 1e-9):
            break
        shard[ours[best]] = b
        if theirs[k[best]] >= 0:
            shard[theirs[k[best]]] = a
    return shard


def pieces_of(vector: np.ndarray, n: int) -> np.ndarray:
    """Vectors of the n pieces into which the rows of a group (bytes, tokens, rows; all rows alike) are dealt in turn."""
    rows = int(vector[2])
    own = rows // n + (np.arange(n) < rows % n)
    return own[:, None] * (vector / rows)


def place_groups(groups: np.ndarray, units: np.ndarray, n_shards: int, largest_row: float, tolerance: float = TOLERANCE) -> tuple[list[np.ndarray], np.ndarray]:
    """Shards of each group's pieces (one, where it stays whole) and of each unit. Groups and units: bytes, tokens, rows."""
    total = np.maximum(groups.sum(axis=0) + units.sum(axis=0), 1)
    part = (groups / total).max(axis=1, initial=0) * n_shards
    limit = 1.0
    while True:
        n = np.where(part > limit, np.minimum(groups[:, 2], np.ceil(part / limit) * 8), 1).astype(np.int64)
        where = place(np.concatenate([*(pieces_of(v, k) for v, k in zip(groups, n, strict=True)), units]), n_shards)
        ends = np.cumsum([0, *n])
        of_groups, of_units = [where[x:y] for x, y in zip(ends, ends[1:], strict=False)], where[ends[-1] :]
        load = np.bincount(of_units, units[:, 0], n_shards).astype(float)
        for v, own in zip(groups, of_groups, strict=True):
            load += np.bincount(own, pieces_of(v, len(own))[:, 0], n_shards)
        limit /= 2
        if load.max() - load.min() <= max(largest_row, tolerance * total[0] / n_shards) or limit < LEAST_SPLIT:
            return of_groups, of_units


def numbered(rows: DataFrame, keys: list[str], cell: str, order: list[str]) -> DataFrame:
    """Adds `number`, gapless from 0 among the rows of equal keys: a count per (keys, cell) after the offset of the cell."""
    counts = rows.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order))
    return rows.withColumn("inside", inside).join(F.broadcast(offsets), [*keys, cell]).withColumn("number", F.col("offset") + F.col("inside") - 1).drop("inside", "offset")


def pack_shards(docs: DataFrame, n_shards: int = 8, units: int = UNITS, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, tokens, text_crc32, shard, slot."""
    spark, text = docs.sparkSession, text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), words_in(text).alias("tokens"), F.crc32(text).alias("text_crc32"), F.xxhash64(F.lit(3), text).alias("h1"), F.xxhash64(F.lit(5), text).alias("h2"))
    rows = cut(rows.withColumn("cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells))))
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    names = ["bytes", "tokens", "rows"]
    *totals, largest_row = (x or 0 for x in rows.agg(*sums, F.max("size")).first())
    groups = rows.groupBy("h1", "h2").agg(*sums)
    large = F.lit(False)
    for name, total in zip(names, totals, strict=True):
        large = large | (F.col(name) * units >= max(total, 1))
    big = groups.where(large).collect()  # 3 x units at most
    small = groups.where(~large).groupBy(F.pmod("h1", F.lit(units)).alias("unit")).agg(*(F.sum(n).alias(n) for n in names)).collect()
    big.sort(key=lambda r: (r.h1, r.h2))
    small.sort(key=lambda r: r.unit)
    vectors = lambda found: np.array([[r[n] for n in names] for r in found], float).reshape(-1, 3)
    of_groups, of_units = place_groups(vectors(big), vectors(small), n_shards, largest_row)
    of_big = pa.table({"b1": pa.array([r.h1 for r in big], pa.int64()), "b2": pa.array([r.h2 for r in big], pa.int64()), "big": pa.array([x.tolist() for x in of_groups], pa.list_(pa.int32()))})
    of_unit = pa.table({"unit": pa.array([r.unit for r in small], pa.int64()), "of_unit": pa.array(of_units, pa.int32())})

    put = rows.join(F.broadcast(spark.createDataFrame(of_big)), (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2")), "left")
    put = put.withColumn("unit", F.pmod("h1", F.lit(units))).join(F.broadcast(spark.createDataFrame(of_unit)), "unit", "left")
    out = ["doc_id", "size", "tokens", "text_crc32", "h1", "h2", "cell", "shard"]
    split = F.coalesce(F.size("big") > 1, F.lit(False))
    whole = put.where(~split).withColumn("shard", F.coalesce(F.get("big", F.lit(0)), "of_unit")).select(*out)
    dealt = whole
    if any(len(x) > 1 for x in of_groups):
        turns = numbered(put.where(split), ["h1", "h2"], "cell", ["doc_id"])
        dealt = cut(whole.unionByName(turns.withColumn("shard", F.get("big", F.pmod("number", F.size("big")).cast("int"))).select(*out)))
    put = numbered(dealt, ["shard"], "cell", ["doc_id", "h1", "h2"])
    return put.select("doc_id", "size", "tokens", "text_crc32", "shard", F.col("number").cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, id_col: str = "doc_id", **options) -> None:
    """Writes the rows of docs as one folder per shard (`shard=0`, ...) with their slots; ids must be unique. Columns of docs
    that are named shard or slot become row_shard and row_slot."""
    put = pack_shards(docs, n_shards, id_col=id_col, **options).select(F.col("doc_id").alias("put_id"), F.struct("shard", "slot").alias("put"))
    rows = docs.select(F.struct("*").alias("row"))
    both = rows.join(put, F.col("row").getField(id_col).eqNullSafe(F.col("put_id")))
    own = [F.col("row").getField(c).alias(f"row_{c}" if c in ("shard", "slot") else c) for c in docs.columns]
    both.select(*own, "put.shard", "put.slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_shards(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": op8_sharding}
SQL: dict[str, str] = {}
