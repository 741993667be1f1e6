"""Operator 3, token-ID / binary output in patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id and sorted, so tasks write shards in ascending order of id. A task encodes
whole texts with the tokenizers library, appends the end id, and closes a shard at `shard_tokens` ids. Each shard is a
file of its own in the folder, in the format below. Spark's writer puts the bytes there (a row of raw bytes per file,
with a line break at the end, which the format ignores), on whatever store the path names, and keeps a lost or repeated
task from leaving half a file. Reading takes the files' heads for the offsets, then the files.

File, little-endian: head (magic, ids per block, docs, ids, blocks, end id, writing task, shard of the task, ids of the
task before it), doc ids as int64, a byte per doc that is 1 where the id is null, ids per doc as uint32, then per block
minimum uint32, width uint8, exceptions uint16 and start uint64 of its bits, the packed bits of all blocks, and the
exceptions as (place in block uint16, value uint32). A block holds `block` ids less their minimum, packed at the width
of the chosen percentile; what is wider is an exception and is stored whole. The starts index the blocks, so any of them
can be read alone: see read_block().

White space (U+0020, U+0009 to U+000D) separates matches of this tokenizer and is dropped by it, so texts are encoded
word by word through the library, with a bounded cache of words; the ids are those of the whole text (tests compare).

Edge cases: a null text is empty and has the end id only; null ids come first; rows that share an id are all written,
in the order of their texts' hashes; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_path, text_of

MAGIC, HEADER = b"VXP2", "<4sIQQQIIIQ"
#: Places of numbers in the head: ids, the writing task, the ids of that task before the shard.
IDS, PART, AT = 3, 6, 8
BLOCK, PERCENTILE, SHARD_TOKENS, END_ID = 128, 98, 2_000_000, 1
CACHE, YOUNG, CACHED_BYTES, PIECE = 600_000, 100_000, 64, 6_000_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts as little-endian uint32 bytes. Words that aren't in the cache yet go through the library many at a
    time, with a mark between them that is a token of its own."""

    MARK = "\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.young = Tokenizer.from_file(path), {}, {}
        mark = self._ids([self.MARK])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        if self.mark is None:
            return [x.tobytes() for x in self._ids([w.decode() for w in words])]
        out: list[bytes] = []
        for k in range(0, len(words), 512):
            ids = self._ids([f" {self.MARK} ".join([w.decode() for w in words[k : k + 512]])])[0]
            marks = np.flatnonzero(ids == self.mark) * 4
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(marks + 4).tolist()], [*marks.tolist(), len(raw)], strict=True)]
        return out

    def _known(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words. The cache fills with the words met first, among them all common ones; later words have
        a smaller cache that starts anew when it is full."""
        if len(self.young) > YOUNG:
            self.young = {}
        mark, old, young = self.MARK.encode(), self.cache.get, self.young.get
        out = [old(w) for w in words]
        missed = [k for k, x in enumerate(out) if x is None]
        for k in missed:
            out[k] = young(words[k])
        new = [k for k in missed if out[k] is None]
        keep = self.cache if len(self.cache) < CACHE else self.young
        plain = [k for k in new if len(words[k]) <= CACHED_BYTES and mark not in words[k]]
        odd = [k for k in new if len(words[k]) > CACHED_BYTES or mark in words[k]]
        for k, x in zip(plain, self._encode_words([words[k] for k in plain]), strict=True):
            out[k] = keep[words[k]] = x
        for k in odd:
            out[k] = self._ids([words[k].decode()])[0].tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has. Words are split and told apart by Arrow, so Python sees the
        distinct ones of a piece only."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        which, ends = coded.indices.to_numpy(), np.asarray(split.offsets)
        ends = ends - ends[0]
        known = self._known(coded.dictionary.cast(pa.binary()).to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        table, first = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = table[np.repeat(first[which] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, np.diff(upto[ends])


def pieces_of(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """(start, rows) of pieces of about `size` bytes, one row at least."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
    start = total = 0
    for k, n in enumerate(lengths):
        if k > start and total + n > size:
            yield start, k - start
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths) - start


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder per Python worker: its cache serves all tasks that the worker runs."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def bit_widths(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def pack(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray, end_id: int = END_ID, block: int = BLOCK, percentile: float = PERCENTILE, place: tuple[int, int, int] = (0, 0, 0)) -> bytes:
    """The file of a shard. place: its task, its number there, and the ids of the task before it."""
    n = len(ids)
    n_blocks = -(-n // block)
    full = np.zeros(n_blocks * block, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]
    full = full.reshape(n_blocks, block)
    low = full.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    over = full - low[:, None]
    rank = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    width = bit_widths(np.partition(over, rank, axis=1)[:, rank]) if n_blocks else np.zeros(0, np.uint8)
    wide = bit_widths(over.ravel()).reshape(over.shape) > width[:, None]
    row, spot = np.nonzero(wide)
    values = over[row, spot]
    over[wide] = 0
    sizes = (width.astype(np.int64) * block + 7) // 8
    starts = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        of_width = np.flatnonzero(width == w)
        for k in range(0, len(of_width), 2048):
            at = of_width[k : k + 2048]
            bits = (over[at][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
            packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
            data[starts[at][:, None] + np.arange(packed.shape[1])] = packed
    return b"".join([
        struct.pack(HEADER, MAGIC, block, len(counts), n, n_blocks, end_id, *place),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), counts.astype("<u4").tobytes(),
        low.astype("<u4").tobytes(), width.tobytes(), np.bincount(row, minlength=n_blocks).astype("<u2").tobytes(), starts.astype("<u8").tobytes(),
        data.tobytes(), spot.astype("<u2").tobytes(), values.astype("<u4").tobytes(),
    ])


class Image:
    """A shard's file, read back."""

    def __init__(self, image: bytes):
        magic, self.block, docs, self.n, blocks, self.end_id, self.part, self.seq, self.before = struct.unpack_from(HEADER, image)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.at, self.image = struct.calcsize(HEADER), image
        self.doc_ids, self.null, self.counts = self._take("<i8", docs), self._take("u1", docs), self._take("<u4", docs)
        self.low, self.width, self.exceptions, self.starts = self._take("<u4", blocks), self._take("u1", blocks), self._take("<u2", blocks), self._take("<u8", blocks).astype(np.int64)
        sizes = (self.width.astype(np.int64) * self.block + 7) // 8
        self.data, total = self._take("u1", int(sizes.sum())), int(self.exceptions.sum(dtype=np.int64))
        self.place, self.values = self._take("<u2", total), self._take("<u4", total)
        self.first = np.cumsum(self.exceptions, dtype=np.int64) - self.exceptions

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.image, kind, n, self.at)
        self.at += out.nbytes
        return out

    def _unpack(self, at: np.ndarray, w: int) -> np.ndarray:
        size = (w * self.block + 7) // 8
        bits = np.unpackbits(self.data[self.starts[at][:, None] + np.arange(size)], axis=1, count=w * self.block, bitorder="little").reshape(len(at), self.block, w)
        out = np.zeros((len(at), self.block), np.uint32)
        for k in range(w):
            out |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        return out

    def read_block(self, k: int) -> np.ndarray:
        """One block, through the index."""
        out = self._unpack(np.array([k]), int(self.width[k]))[0]
        own = slice(self.first[k], self.first[k] + self.exceptions[k])
        out[self.place[own]] = self.values[own]
        return (out + self.low[k])[: self.n - k * self.block]

    def ids(self) -> np.ndarray:
        out = np.zeros((len(self.low), self.block), np.uint32)
        for w in np.unique(self.width[self.width > 0]):
            of_width = np.flatnonzero(self.width == w)
            for k in range(0, len(of_width), 2048):
                out[of_width[k : k + 2048]] = self._unpack(of_width[k : k + 2048], int(w))
        out[np.repeat(np.arange(len(self.low)), self.exceptions), self.place] = self.values
        return (out + self.low[:, None]).ravel()[: self.n]


def write_token_file(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block: int = BLOCK, percentile: float = PERCENTILE, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the shards of docs, in ascending order of id, to the folder `path`."""
    tokenizer = tokenizer or tokenizer_path()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    src = src.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, at = encoder_for(tokenizer), TaskContext.get().partitionId(), 0, 0
        ids, counts, doc_ids, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            image = pack(np.concatenate(ids), doc_ids, np.array(counts, np.int64), end_id, block, percentile, (part, seq, at))
            return pa.RecordBatch.from_pydict({"image": [image]})

        for batch in batches:
            for start, rows in pieces_of(batch.column("text")):
                own = batch.slice(start, rows)
                coded, sizes = encoder.encode(own.column("text"))
                whole = np.full(len(coded) + rows, end_id, np.uint32)
                ends = np.cumsum(sizes + 1)
                inside = np.ones(len(whole), bool)
                inside[ends - 1] = False
                whole[inside] = coded
                for name, a, b in zip(own.column("doc_id").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    ids.append(whole[a:b])
                    counts.append(b - a)
                    doc_ids.append(name)
                    n += b - a
                    if n >= shard_tokens:
                        yield close()
                        ids, counts, doc_ids, seq, at, n = [], [], [], seq + 1, at + n, 0
        if counts:
            yield close()

    src.mapInArrow(go, "image binary").select(F.col("image").cast("string")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def in_head(content: Column, field: int) -> Column:
    """A number of a file's head, by its place there (0: the magic)."""
    at, size = struct.calcsize(HEADER[: field + 2]), struct.calcsize(f"<{HEADER[field + 2]}")
    pairs = F.regexp_extract_all(F.hex(F.substring(content, at + 1, size)), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("long")


def read_token_file(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start (ids of all before it), n_tokens, ids_crc32 and, if wanted, ids (little-endian uint32)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    shards = files.select(in_head(F.col("content"), PART).alias("part"), in_head(F.col("content"), AT).alias("at"), in_head(F.col("content"), IDS).alias("n"), F.col("content").alias("image"))
    parts = shards.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row per writing task
    before = np.cumsum([0, *(r.n for r in parts)])[:-1] if parts else []
    offsets = spark.createDataFrame(pa.table({"o_part": pa.array([r.part for r in parts], pa.int64()), "before": pa.array(before, pa.int64())}))
    shards = shards.join(F.broadcast(offsets), F.col("part") == F.col("o_part")).select((F.col("before") + F.col("at")).alias("start"), "image")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image, start = Image(batch.column("image")[k].as_py()), batch.column("start")[k].as_py()
                ids = image.ids().astype("<u4").tobytes()
                ends = np.cumsum(image.counts, dtype=np.int64)
                starts = ends - image.counts
                for i in range(0, len(ends), 1024):
                    own = slice(i, i + 1024)
                    parts = [ids[4 * a : 4 * b] for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
                    columns = [pa.array(image.doc_ids[own], pa.int64(), mask=image.null[own] == 1), pa.array(starts[own] + start, pa.int64()), pa.array(image.counts[own].astype(np.int64)), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())] if with_ids else columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return shards.mapInArrow(go, schema)


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_path(spark, "tokens")
    write_token_file(documents(spark, sf_dir), at)
    return read_token_file(spark, at, with_ids=False)


QUERIES = {"op3_token_file": op3_token_file}
SQL: dict[str, str] = {}
