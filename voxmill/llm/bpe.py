"""Operator 7, byte-level BPE encoding and decoding, by Spark's higher-order functions.

A rank file becomes literals: each token's only split into two tokens (found by running the merges on the token
itself) in a table of pairs, the ids of single bytes, and the bytes of each id. A word's fold starts from
the ids of its bytes and merges the pair of lowest rank, the leftmost first, until none is left; the state is one
array with (rank of the pair with the next id, id) packed in each element. Words over `LONG` bytes fold a string of
one character per id instead and merge all occurrences of the lowest pair at once, which gives the same ids (no merge
can make a pair of lower rank, as each token has one split) in far fewer and linear steps.

All distinct words of all texts are counted; the commonest (at most `dictionary` words, by a cut in the counts) are
folded once each and broadcast, which bounds what is sent whatever the corpus; the words of a text are looked up there
in Arrow batches, and the fold runs on those of a row that aren't in it. So `dictionary` is a matter of memory only, and
texts are never exploded and shuffled for encoding: each row is encoded where it is read. Decoding joins the bytes of
the ids.

Edge cases: null and empty texts have no ids and decode to no bytes; repeated rows and null ids of documents are rows
like others; an empty table gives no row; other columns are carried along. Pieces are split by java.util.regex with
Unicode classes, so letters and digits added to Unicode after the JVM's version count as neither.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from .common import cut, documents, small_batches, text_of

DICTIONARY, LONG, PART, MISSING = 800_000, 96, 300_000, "?"
NO_RANK = 1 << 17


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two pieces of a token before its last merge, or the pieces of a word that is no token."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 2 or (len(parts) == 2 and word not in ranks):
        found = [ranks.get(a + b, NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        best = min(found)
        if best == NO_RANK:
            break
        k = found.index(best)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def id_char(i: int) -> str:
    """A character for each id, past the surrogates."""
    return chr(0x100 + i if 0x100 + i < 0xD800 else 0x100 + i + 0x800)


def literal(values: list, element: str) -> Column:
    """A constant array as one literal in Spark's compact binary form, which all places of a plan share: a from_json() of
    a string would be parsed, boxed and printed in each place."""
    spark = SparkSession.getActiveSession()
    made = spark.range(0, 1, 1, 1).select(F.from_json(F.lit(json.dumps(values, separators=(",", ":"), ensure_ascii=False)), f"array<{element}>").alias("x"))
    jvm, row = spark.sparkContext._jvm, made._jdf.queryExecution().executedPlan().executeCollect()[0]
    value = jvm.org.apache.spark.sql.catalyst.expressions.Literal(row.getArray(0).copy(), made._jdf.schema().apply(0).dataType())
    return ClassicColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(value))


def bind(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Vocabulary:
    """The literals of a rank file and the expressions over them."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        if max(ranks.values()) >= NO_RANK:
            raise ValueError("too many ids for the packing")
        pairs = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = merge_bytes(token, ranks)
                if len(parts) != 2:
                    raise ValueError(f"token {token!r} can't be reached by merges")
                pairs[ranks[parts[0]], ranks[parts[1]]] = rank
        self.by_id = {v: k for k, v in ranks.items()}
        size = max(self.by_id) + 1
        self._table(pairs)
        self.byte_ids = literal([ranks[bytes([i])] for i in range(256)], "int")
        self.chars = literal([id_char(i) for i in range(size)], "string")
        self.pieces = literal([self.by_id.get(i, b"").decode("latin-1") for i in range(size)], "string")

    def _table(self, pairs: dict[tuple[int, int], int]) -> None:
        """Sparse rows laid over each other: pair (a, b) is at shift[a] + b, and owner says whose place that is."""
        rows: dict[int, dict[int, int]] = {}
        for (a, b), rank in pairs.items():
            rows.setdefault(a, {})[b] = rank
        width = max(self.by_id) + 1
        size = 1 << int(np.ceil(np.log2(4 * (width + len(pairs)))))
        shift, owner, value, random = np.zeros(width, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int64), np.random.default_rng(1)
        for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
            at = np.array(list(row), np.int64)
            for d in iter(lambda: int(random.integers(size - width)), None):
                if (owner[at + d] < 0).all():
                    break
            shift[a], owner[at + d], value[at + d] = d, a, list(row.values())
        self.shift, self.owner, self.value = (literal(x.tolist(), "int") for x in (shift, owner, value))

    def rank(self, a: Column, b: Column) -> Column:
        """Rank of the pair of ids, which is the merged id; null if there's none. a and b: long."""
        at = F.get(self.shift, a) + b
        return F.when(F.get(self.owner, at) == a, F.get(self.value, at).cast("long"))

    def packed(self, a: Column, b: Column) -> Column:
        return F.shiftleft(F.coalesce(self.rank(a, b), F.lit(NO_RANK)), 17).bitwiseOR(a)

    def start(self, word: Column) -> Column:
        """Ids of a word's bytes."""
        return F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(self.byte_ids, F.ascii(c)).cast("long"))

    def fold_short(self, word: Column) -> Column:
        """Ids of a word, as decimals joined by spaces; one merge a step."""
        none, low = F.lit(NO_RANK << 17).cast("long"), (1 << 17) - 1

        def step(own: Column) -> Column:
            def merge(best: Column) -> Column:
                new = F.shiftright(best, 17)

                def at(p: Column) -> Column:  # p: place of the left id, from 0
                    after = F.get(own, p + 2).bitwiseAND(low)
                    put = lambda x, i: F.when((i < p - 1) | (i > p + 1), x).when(i == p, self.packed(new, after)).when(i == p - 1, self.packed(x.bitwiseAND(low), new)).otherwise(F.lit(-1).cast("long"))
                    return F.array_remove(F.transform(own, put), -1)

                return F.when(best >= none, own).otherwise(bind((F.array_position(own, best) - 1).cast("int"), at))

            return bind(F.array_min(own), merge)

        begin = bind(self.start(word), lambda x: F.transform(x, lambda e, i: self.packed(e, F.get(x, i + 1))))
        merged = F.aggregate(F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1))), begin, lambda a, _: step(a))
        return F.array_join(F.transform(merged, lambda e: e.bitwiseAND(low).cast("string")), " ")

    def fold_long(self, word: Column) -> Column:
        """The same by a string of a character per id, all occurrences of a pair a step."""

        def best(ids: Column) -> Column:
            pairs = F.zip_with(F.slice(ids, F.lit(1), F.size(ids) - 1), F.slice(ids, F.lit(2), F.size(ids)), lambda a, b: F.struct(self.rank(a, b).alias("new"), a.alias("a"), b.alias("b")))
            return F.array_min(F.filter(pairs, lambda p: p.new.isNotNull()))

        char = lambda x: F.get(self.chars, x.cast("int"))
        ids_of = lambda s: F.transform(F.split(s, ""), lambda c: bind(F.ascii(c), lambda p: F.when(p < 0xD800, p - 0x100).otherwise(p - 0x900).cast("long")))

        def step(acc: Column) -> Column:
            new = F.replace(acc.s, F.concat(char(acc.p.a), char(acc.p.b)), char(acc.p.new))
            return F.when(acc.p.isNull(), acc).otherwise(bind(new, lambda s: F.struct(s.alias("s"), best(ids_of(s)).alias("p"))))

        def begin(x: Column) -> Column:
            return F.struct(F.array_join(F.transform(x, char), "").alias("s"), best(x).alias("p"))

        return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), bind(self.start(word), begin), lambda a, _: step(a), lambda a: F.array_join(F.transform(ids_of(a.s), lambda i: i.cast("string")), " "))

    def fold(self, word: Column) -> Column:
        return F.when(F.octet_length(word) <= LONG, self.fold_short(word)).otherwise(self.fold_long(word))

    def decode(self, ids: Column) -> Column:
        """Bytes of an array of ids (numbers, or their decimals); an id that the vocabulary lacks has none."""
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(self.pieces, i.cast("int"))), ""), "ISO-8859-1")


@lru_cache(2)
def _vocabulary(path: str, application: str) -> Vocabulary:
    return Vocabulary(path)


def vocabulary(path: str | None = None) -> Vocabulary:
    """The literals live in the JVM of a session, and are kept as long as it is the same."""
    return _vocabulary(path or rank_path(), SparkSession.getActiveSession().sparkContext.applicationId)


def pieces(text: Column, regex: str | None = None) -> Column:
    """The matches of the pattern, which are encoded separately."""
    return F.regexp_extract_all(text, F.lit("(?U)" + (regex or pattern())), F.lit(0))


def common_words(docs: DataFrame, most: int, text_col: str = "text", regex: str | None = None) -> DataFrame:
    """word, n: at most `most` of the commonest words of all texts, by a cut in eighths of powers of two of their counts."""
    words = docs.select(F.explode(pieces(text_of(text_col), regex)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = cut(words.where(F.octet_length("word") <= LONG).withColumn("level", F.floor(8 * F.log2("n")).cast("int")))
    levels = sorted(((r.level, r["count"]) for r in words.groupBy("level").count().collect()), reverse=True)
    total, least = 0, None
    for level, n in levels:
        if total + n > most:
            break
        total, least = total + n, level
    return words.where(F.col("level") >= (least if least is not None else 1 << 30)).select("word", "n")


_known: dict[str, pa.Table] = {}


def known(key: str, sent) -> pa.Table:
    """The broadcast dictionary (word, ids) in this Python worker, which keeps the last one, as Arrow columns over the
    bytes that were sent."""
    if key not in _known:
        _known.clear()
        with pa.ipc.open_stream(sent.value) as stream:
            _known[key] = stream.read_all()
    return _known[key]


def look_up(lists: pa.ListArray, words: pa.Array, ids: pa.Array) -> Iterator[tuple[int, int, pa.Array, pa.ListArray]]:
    """For lists of words, some at a time (from, to): their ids, joined by spaces, with MISSING for words that aren't known,
    and lists of these. Each distinct word is looked up once."""
    coded, ends = lists.flatten().dictionary_encode(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    found = pc.index_in(coded.dictionary, value_set=words)
    told, unknown = pc.fill_null(ids.take(found), MISSING), found.is_null().to_numpy(zero_copy_only=False)
    start = 0
    while start < len(lists):  # a row at least, and PART words at about
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + PART, side="right")) - 1)
        own, places = coded.indices.slice(ends[start], ends[end] - ends[start]), ends[start : end + 1] - ends[start]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(places, pa.int32()), told.take(own)), " ")
        missing = unknown[own.to_numpy()]
        before = np.concatenate([[0], np.cumsum(missing, dtype=np.int32)])
        yield start, end, joined, pa.ListArray.from_arrays(pa.array(before[places], pa.int32()), coded.dictionary.take(own.filter(pa.array(missing))))
        start = end


def looked_up(docs: DataFrame, words: DataFrame, row: Column, text: Column, regex: str) -> DataFrame:
    """row, partial and missing (see look_up) of each row of docs; words: word, ids."""
    spark = docs.sparkSession
    small_batches(spark)
    table, sink = words.toArrow().combine_chunks(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    sent, key = spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex
    del table, sink

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = known(key, sent)
        own, ids = (dictionary.column(c).chunk(0) if dictionary.num_rows else pa.array([], pa.string()) for c in ("word", "ids"))
        for whole in batches:
            for start, end, *found in look_up(whole.column("words"), own, ids):
                yield pa.RecordBatch.from_arrays([whole.column("row").slice(start, end - start), *found], names=["row", "partial", "missing"])
            whole = found = None
            pa.default_memory_pool().release_unused()

    src = docs.select(row.alias("row"), pieces(text, regex).alias("words"))
    kind = src.schema["row"].dataType.simpleString()
    return src.mapInArrow(go, f"row {kind}, partial string, missing array<string>")


def encode_documents(docs: DataFrame, path: str | None = None, regex: str | None = None, dictionary: int = DICTIONARY, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns row (those of docs that are to be kept, all by default, as a struct), ids_text (decimals joined by spaces)
    and parts (the same as array<string>); ids_of(parts) are the ids as array<int>."""
    v, text, regex = vocabulary(path), text_of(text_col), regex or pattern()
    words = common_words(docs, dictionary, text_col, regex).select("word")
    words = words.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = words.select("word", v.fold(F.col("word")).alias("ids"))
    out = looked_up(docs, words, F.struct(*(keep or ["*"])), text, regex)
    spread = F.zip_with(F.split("partial", r"\?", -1), F.transform("missing", v.fold), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    ids_text = F.when(F.size("missing") == 0, F.col("partial")).otherwise(F.array_join(spread, ""))
    out = out.select("row", ids_text.alias("ids_text"))
    parts = F.when(F.col("ids_text") == "", F.array().cast("array<string>")).otherwise(F.split("ids_text", " "))
    return out.select("row", "ids_text", parts.alias("parts"))


def ids_of(parts: Column | str) -> Column:
    return F.transform(parts, lambda x: x.cast("int"))


def decode_ids(ids: Column, path: str | None = None) -> Column:
    return vocabulary(path).decode(ids)


def digests(encoded: DataFrame, path: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256; more: "ids" or columns of the documents."""
    v = vocabulary(path)
    return encoded.select(F.col("row.doc_id").alias("doc_id"), F.size("parts").cast("long").alias("n_tokens"), F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2(v.decode(F.col("parts")), 256).alias("decoded_sha256"), *(ids_of("parts").alias("ids") if c == "ids" else F.col(f"row.{c}").alias(c) for c in more))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(documents(spark, sf_dir), keep=("doc_id",)))


QUERIES = {"op7_bpe": op7_bpe}
SQL: dict[str, str] = {}
