"""Operator 13, document fingerprints: sketches of the hashes below a threshold, which can be merged and compared.

A text's set is that of its five-word shingles (all its words where it has fewer), each a hash of 48 bits. The sketch
keeps every hash below a fixed fraction of all (1 in SCALE), whatever the text's length, so that a short text's share in
a long one shows as well as a likeness. Where that leaves fewer than LEAST hashes, the threshold is raised to keep the
LEAST smallest, or all there are. A fingerprint is its threshold and its hashes; two compare below the lower of their
thresholds, where both are complete, and merge by union there. As text: base64 of 48-bit numbers, the threshold less 1
first, then the hashes, ascending. Likeness is the share of the union that both hold (Jaccard), 1 for two empty sets.

edited_fingerprints() gives each document beside one made from it and the next. A pass over numbers alone finds the
bounds of ranges of descending doc_id (four a shuffle partition: so many keys of three numbers are broadcast). Then the
texts move once, each to its range, the first of a range to the one before it as well; a task reads its sorted rows as a
stream and holds a few. Null ids come last and rows of one id go by a hash of the text, so null ids are many ranges; rows
that agree in both follow each other in one range.

Edge cases: a null text is empty, and an empty text has an empty set; equal texts have equal fingerprints; a row that is
alone is its own next; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of
from .shingles import shingle_sets

SCALE, LEAST, ALL, SOME = 8, 16, 1 << 48, 4 << 20

Sketch = tuple[int, np.ndarray]


def sketch(hashes: np.ndarray, scale: int = SCALE, least: int = LEAST) -> Sketch:
    """(threshold, the hashes below it, ascending) of a set of 64-bit hashes."""
    own = np.unique(hashes >> np.uint64(16))
    n = int(np.searchsorted(own, np.uint64(ALL // scale)))
    if n >= least:
        return ALL // scale, own[:n]
    return (ALL, own) if len(own) <= least else (int(own[least - 1]) + 1, own[:least])


def sketches(texts: list[str], scale: int = SCALE, least: int = LEAST, words: int = 5) -> list[Sketch]:
    return [sketch(s, scale, least) for s in shingle_sets(texts, words)]


def as_text(print_: Sketch) -> str:
    numbers = np.append(np.uint64(print_[0] - 1), print_[1]).astype(">u8")
    return base64.b64encode(numbers.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(text: str) -> Sketch:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    numbers = np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).reshape(-1).view(">u8").astype(np.uint64)
    return int(numbers[0]) + 1, numbers[1:]


def below(print_: Sketch, threshold: int) -> np.ndarray:
    return print_[1] if threshold >= print_[0] else print_[1][: np.searchsorted(print_[1], np.uint64(threshold))]


def likeness(a: Sketch, b: Sketch) -> float:
    """Share of the union that both hold."""
    t = min(a[0], b[0])
    x, y = below(a, t), below(b, t)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def containment(a: Sketch, b: Sketch) -> float:
    """Share of a that b holds: 1 if a is of an empty set, 0 if a has no hash below b's threshold, so that nothing tells."""
    t = min(a[0], b[0])
    x = below(a, t)
    return len(np.intersect1d(x, below(b, t), assume_unique=True)) / len(x) if len(x) else float(not len(a[1]))


def merged(*prints: Sketch) -> Sketch:
    """The fingerprint of all texts together."""
    t = min(p[0] for p in prints)
    return t, reduce(np.union1d, (below(p, t) for p in prints))


TOLD = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_edited double"
NAMES = [x.split()[0] for x in TOLD.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
#: What rows are ordered by: ids descending, null last; rows of one id by their text.
KEY = {"none": "doc_id IS NULL", "down": "~doc_id", "tie": "xxhash64(text)"}


def dealt(batches: Iterator[pa.RecordBatch], bounds: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their range; the first row of each range goes, as `ahead`, to the range before it too."""
    sent = set()
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in KEY), strict=True))
        own = [bisect.bisect_right(bounds, k) - 1 for k in keys]
        first = {r: i for i, (k, r) in reversed(list(enumerate(zip(keys, own, strict=True)))) if k == bounds[r] and r not in sent}
        sent |= first.keys()
        at = [*range(len(own)), *first.values()]
        ranges = [*own, *((r - 1) % len(bounds) for r in first)]
        ahead = [False] * len(own) + [True] * len(first)
        out = batch.take(pa.array(at, pa.int64()))
        yield out.append_column("range", pa.array(ranges, pa.int32())).append_column("ahead", pa.array(ahead, pa.bool_()))


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A few megabytes of texts at a time."""
    start, ends = 0, np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype=np.int64)
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + SOME, side="right")))
        yield batch.slice(start, end - start)
        start = end


def neighbours(batches: Iterator[pa.RecordBatch], scale: int, least: int) -> Iterator[pa.RecordBatch]:
    """Each row beside the next of its range; the rows of a range come in order, what is ahead of it last."""
    before: list[tuple] = []
    for batch in (p for b in batches for p in parts(b)):
        texts = batch.column("text").to_pylist()
        rows = [*before, *zip(*(batch.column(c).to_pylist() for c in ("range", "ahead", "doc_id")), texts, sketches(texts, scale, least), strict=True)]
        both = [(a, b) for a, b in itertools.pairwise(rows) if a[0] == b[0] and not a[1]]
        yield told([a[2:] for a, _ in both], [b[3:] for _, b in both], scale, least)
        before = rows[-1:]


def told(own: list[tuple], after: list[tuple], scale: int, least: int) -> pa.RecordBatch:
    """Of (doc_id, text, sketch), each beside the next one's (text, sketch)."""
    cuts = [len(text) // 3 for _, text, _ in own]
    edited = [text[: len(text) - k] + more[:k] for (_, text, _), (more, _), k in zip(own, after, cuts, strict=True)]
    prints = sketches(edited, scale, least)
    columns = zip(*(
        (i, len(text), hashlib.sha256(e.encode()).hexdigest(), as_text(s), as_text(p), likeness(s, p), likeness(s, t), containment(s, p))
        for (i, text, s), (_, t), e, p in zip(own, after, edited, prints, strict=True)
    ), strict=True)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns if own else [[]] * len(NAMES), KINDS, strict=True)], NAMES)


def edited_fingerprints(docs: DataFrame, scale: int = SCALE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, held_edited (the share of
    the document's own shingles that the edited text holds)."""
    spark = docs.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumns({name: F.expr(e) for name, e in KEY.items()})
    keys = rows.select(*KEY).repartitionByRange(ranges, *KEY).groupBy(F.spark_partition_id().alias("part"))
    bounds = sorted(tuple(r.least) for r in keys.agg(F.min(F.struct(*KEY)).alias("least")).collect())
    if not bounds:
        return spark.createDataFrame([], TOLD)
    sent = spark.sparkContext.broadcast(bounds)
    spread = rows.mapInArrow(lambda x: dealt(x, sent.value), "doc_id long, text string, none boolean, down long, tie long, range int, ahead boolean")
    ordered = spread.repartition("range").sortWithinPartitions("range", "ahead", *KEY)
    return ordered.mapInArrow(lambda x: neighbours(x, scale, least), TOLD)


def shingle_table(prints: DataFrame, by: str, column: str = "fingerprint") -> DataFrame:
    """by, hash: the merged fingerprints of each group as rows, which can be merged further by union and distinct, and
    joined: a group of any size stays distributed. Only hashes below the fixed fraction, which all fingerprints hold."""
    hashes = F.transform(F.sequence(F.lit(0), (F.length(column) / 8).cast("int") - 1), lambda k: F.hex(F.unbase64(F.substring(F.col(column), k * 8 + 1, F.lit(8)))))
    rows = prints.select(F.col(by), F.explode(F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0)))).alias("hash"))
    return rows.where(F.col("hash") < f"{ALL // SCALE:012X}").distinct()


def shares(prints: DataFrame, table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, by, share: how much of each document's fingerprint the merged fingerprint of each group holds, where above 0."""
    by = next(c for c in table.columns if c != "hash")
    own = shingle_table(prints, id_col)
    total = own.groupBy(F.col(id_col).alias("of_id")).agg(F.count(F.lit(1)).alias("n"))
    both = own.join(table, "hash").groupBy(id_col, by).agg(F.count(F.lit(1)).alias("both"))
    return both.join(total, F.col(id_col) == F.col("of_id")).select(id_col, by, (F.col("both") / F.col("n")).alias("share"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


QUERIES = {"op13_fingerprints": op13_fingerprints}
SQL: dict[str, str] = {}
