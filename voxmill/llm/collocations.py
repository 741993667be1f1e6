"""Operator 12, phrase collocation mining: weighted n-grams counted out of core in DuckDB, a hash bucket a task.

Texts are split into pieces, and equal pieces of a language become one with a multiplicity, summed per task before the
shuffle. Phrases are then counted by length, 1 to 4 words. A task turns its pieces into word numbers of its own, sums
equal phrases, and sends them by hash of language and phrase to a bucket; DuckDB sums a bucket within `memory` MB,
writing what has no room to a scratch folder of that task, and keeps phrases at least `least` often. A longer phrase can
be frequent only if the phrase without its first word and that without its last are; a Bloom filter of these, of
FILTER_WORDS times 64 bits whatever the table's size, is sent to the next length's tasks. It drops no frequent phrase:
what it lets through in error is counted and found rare. A candidate's parts ask for their counts by a shuffled
join of requests and counts, so that a request meets its count in the bucket of its phrase, and the answers go back to
the candidate. The best of a language are cut in SALTS groups first.

Bounds: a task holds CHUNK bytes of pieces (one piece at least), HELD phrases, a filter of 16 MB and DuckDB's `memory`.
The scratch folder is the task's alone (Python's tempfile), is read by nothing else and goes with the task; a repeated
task starts a new one.

Edge cases: a null text is empty and has no words; a null lang counts as `und`, an empty one as itself; every row
counts, repeated or not; empty tables, and languages in which no phrase is frequent, give no row; other columns are
ignored. Products are taken in decimals of 38 digits.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, documents, text_of, written
from .line_dedup import SQL_LOWER
from .shingles import STEP, mixed
from .tokens import inside, tokens, utf8

BREAKS, OF_WORD = r"[.,;:!?\x0A-\x0D]", inside(0x20, 0x09)
LEAST, WORDS, BEST, SALTS = 30, 4, 2000, 64
SCALE, COVERED = 2_000_000, 80
FILTER_WORDS, CHUNK, HELD, MEMORY = 1 << 21, 8 << 20, 1 << 20, 256
GRAMS = "lang string, phrase string, n long"


def pieces_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, piece, n: the distinct pieces of each language and how often they stand in the texts."""
    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.explode(F.split(ascii_lower(text_of(text_col)), BREAKS)).alias("piece"))
    return rows.select("lang", F.btrim("piece", F.lit(" \t")).alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("n"))


class Words:
    """The words of some pieces as numbers, with language, piece and weight of each."""

    def __init__(self, lang: pa.Array, piece: pa.Array, n: np.ndarray):
        words, self.row = tokens(*utf8(piece), OF_WORD)
        words, lang = words.dictionary_encode(), lang.dictionary_encode()
        self.names, self.langs = words.dictionary.cast(pa.string()), lang.dictionary
        self.word, self.lang = words.indices.to_numpy().astype(np.int64), lang.indices.to_numpy().astype(np.int64)[self.row]
        self.n = n[self.row]
        of = lambda x: pd.util.hash_array(np.array(x.to_pylist(), object), categorize=False)
        self.name_hash, self.lang_hash = of(self.names), of(self.langs)

    def hashes(self, k: int) -> np.ndarray:
        """Of the k words from each position on, with their language; meaningless where a piece ends before."""
        own = self.name_hash[self.word]
        out = self.lang_hash[self.lang]
        for j in range(k):
            out = mixed(out[: len(own) - j] * STEP + own[j:])
        return out

    def phrases(self, at: np.ndarray, k: int) -> pa.Table:
        """The distinct phrases of k words that begin at these positions, with their weights summed."""
        code, most = self.lang[at], len(self.langs)
        for j in range(k):
            if most > (1 << 62) // len(self.names):
                code = np.unique(code, return_inverse=True)[1]
                most = len(at)
            code, most = code * len(self.names) + self.word[at + j], most * len(self.names)
        order = np.argsort(code, kind="stable")
        code = code[order]
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        one = at[order[starts]]
        n = np.add.reduceat(self.n[at][order], starts) if len(starts) else np.zeros(0, np.int64)
        names = [self.names.take(pa.array(self.word[one + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*names, " ") if k > 1 else names[0]
        return pa.table({"lang": self.langs.take(pa.array(self.lang[one])), "phrase": phrase, "n": n})

    def total(self) -> pa.Table:
        """All words of each language, as the phrase of no words."""
        n = np.zeros(len(self.langs), np.int64)
        np.add.at(n, self.lang, self.n)
        return pa.table({"lang": self.langs, "phrase": [""] * len(n), "n": n})


def bits_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter that a hash belongs to, and its three bits there."""
    one, six = np.uint64(1), np.uint64(63)
    bits = (one << (h & six)) | (one << ((h >> np.uint64(6)) & six)) | (one << ((h >> np.uint64(12)) & six))
    return ((h >> np.uint64(24)) % np.uint64(FILTER_WORDS)).astype(np.int64), bits


def known(frequent: np.ndarray, h: np.ndarray) -> np.ndarray:
    word, bits = bits_of(h)
    return frequent[word] & bits == bits


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Words]:
    """The rows (lang, text, n) in parts of about `size` bytes."""
    held, had = [], 0
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
        start = 0
        while start < batch.num_rows:
            before = int(lengths[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(lengths, before + size - had, side="right")))
            held.append(batch.slice(start, end - start))
            had += int(lengths[end - 1]) - before
            start = end
            if had >= size or start < batch.num_rows:
                yield words_of(held)
                held, had = [], 0
    if held:
        yield words_of(held)


def words_of(held: list[pa.RecordBatch]) -> Words:
    t = pa.Table.from_batches(held).combine_chunks()
    lang, piece, n = (t.column(i).combine_chunks() for i in range(3))
    return Words(lang, piece, n.to_numpy())


def summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])


def grams(batches: Iterator[pa.RecordBatch], k: int, frequent: np.ndarray | None, size: int, most: int) -> Iterator[pa.RecordBatch]:
    """Sums of a task's phrases of k words whose two parts of k - 1 the filter knows."""
    held: list[pa.Table] = []
    for words in chunks(batches, size):
        at = np.flatnonzero(words.row[k - 1 :] == words.row[: len(words.row) - k + 1])
        if frequent is not None:
            seen = known(frequent, words.hashes(k - 1))
            at = at[seen[at] & seen[at + 1]]
        held.append(words.phrases(at, k))
        if k == 1:
            held.append(words.total())
        if sum(t.num_rows for t in held) > most:
            held = [summed(held)]
            if held[0].num_rows > most // 2:
                yield from held[0].to_batches(1 << 16)
                held = []
    if held:
        yield from summed(held).to_batches(1 << 16)


def counted(batches: Iterator[pa.RecordBatch], least: int, memory: int) -> Iterator[pa.RecordBatch]:
    """The sums of a bucket's phrases, by DuckDB, where they are at least `least`."""
    first = next(batches, None)
    if first is None:
        return
    folder = tempfile.mkdtemp(prefix="phrases-")
    con = duckdb.connect(config={"memory_limit": f"{memory}MB", "temp_directory": folder, "threads": 1, "preserve_insertion_order": False})
    try:
        con.register("grams", pa.RecordBatchReader.from_batches(first.schema, (b for part in ([first], batches) for b in part)))
        found = con.sql(f"SELECT lang, phrase, sum(n)::BIGINT AS n FROM grams GROUP BY ALL HAVING sum(n) >= {int(least)}")
        yield from found.to_arrow_reader(1 << 16)
    finally:
        con.close()
        shutil.rmtree(folder, ignore_errors=True)


def filter_bits(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """What frequent phrases of k words set in the filter."""
    for words in chunks(batches, CHUNK):
        first = np.flatnonzero(np.append(True, words.row[1:] != words.row[:-1])) if len(words.row) else np.zeros(0, np.int64)
        word, bits = bits_of(words.hashes(k)[first])
        order = np.argsort(word, kind="stable")
        word, bits = word[order], bits[order]
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        if len(starts):
            yield pa.record_batch({"word": pa.array(word[starts]), "bits": pa.array(np.bitwise_or.reduceat(bits, starts).view(np.int64))})


def phrase_counts(docs: DataFrame, least: int = LEAST, words: int = WORDS, text_col: str = "text", lang_col: str = "lang", size: int = CHUNK, held: int = HELD, memory: int = MEMORY) -> list[DataFrame]:
    """For each length from 1 on: lang, phrase, n of the phrases at least `least` often; with the phrases of one word
    stands the empty phrase, which has the number of all words."""
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, text_col, lang_col), "pieces")
    out, sent = [], None
    for k in range(1, words + 1):
        own = pieces.mapInArrow(lambda x, k=k, sent=sent: grams(x, k, sent.value if sent else None, size, held), GRAMS)
        out.append(written(own.repartition("lang", "phrase").mapInArrow(lambda x: counted(x, least, memory), GRAMS), f"phrases-{k}"))
        if k < words:
            frequent = np.zeros(FILTER_WORDS, np.uint64)
            bits = out[-1].where("phrase <> ''").mapInArrow(lambda x, k=k: filter_bits(x, k), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
            frequent[bits.column("word").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
            sent = spark.sparkContext.broadcast(frequent)
    return out


def wide(c: Column, digits: int = 20) -> Column:
    return c.cast(f"decimal({digits},0)")


def score(a: Column, parts: Column) -> Column:
    """floor(SCALE * a / parts); the product may pass 64 bits."""
    return F.call_function("div", wide(a) * F.lit(SCALE).cast("decimal(10,0)"), wide(parts))


def phrase_of(words: Column, start: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def collocations(docs: DataFrame, best: int = BEST, least: int = LEAST, words: int = WORDS, covered: int = COVERED, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `words` words."""
    counts = phrase_counts(docs, least, words, **options)
    every = counts[0]
    for c in counts[1:]:
        every = every.unionByName(c)
    own = F.split("phrase", " ")
    candidates = counts[1].withColumn("size", F.lit(2))
    for k, c in enumerate(counts[2:], 3):
        candidates = candidates.unionByName(c.withColumn("size", F.lit(k)))

    cuts = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(
        F.struct(k.alias("k"), F.lit(0).alias("side"), phrase_of(own, 1, k).alias("part")), F.struct(k.alias("k"), F.lit(1).alias("side"), phrase_of(own, k + 1, F.col("size") - k).alias("part"))))))
    requests = candidates.select("lang", "phrase", F.col("n").alias("a"), cuts.alias("c")).select("lang", "phrase", "a", "c.k", "c.side", F.col("c.part").alias("part"))
    answers = requests.join(every.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of_part"), F.col("n").alias("f")), (F.col("lang") == F.col("of_lang")) & (F.col("part") == F.col("of_part")))
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{'lr'[side]}{k}")
    told = answers.groupBy("lang", "phrase", "a").agg(*(of(k, side) for k in range(1, words) for side in (0, 1)))
    each = F.array(*(F.when(F.col(f"l{k}").isNotNull(), F.struct(score(F.col("a"), F.col(f"l{k}") + F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, words)))
    scored = told.select("lang", "phrase", "a", F.array_min(each).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    longer = candidates.where("size > 2")
    lengths = F.sequence(F.lit(2), F.col("size") - 1)
    parts = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: phrase_of(own, i, n))))
    over = longer.select(F.col("lang").alias("in_lang"), F.col("n"), F.explode(F.array_distinct(parts)).alias("part")).groupBy("in_lang", "part").agg(F.max("n").alias("over"))
    kept = scored.join(over, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("part")), "left")
    kept = kept.where(F.col("over").isNull() | (wide(F.col("over")) * 100 < wide(F.col("a")) * covered)).drop("in_lang", "part", "over")

    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
    total = counts[0].where("phrase = ''").select(F.col("lang").alias("of_lang"), F.col("n"))
    return kept.join(total, F.col("lang") == F.col("of_lang")).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({SQL_LOWER.format("coalesce(text, '')")}, '{BREAKS}')) AS piece FROM documents),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, count(*) AS c FROM p GROUP BY ALL),
g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, sum(c)::BIGINT AS f
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM q) s, range(1, {WORDS + 1}) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE k > 1 AND f >= {LEAST}),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM c),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, j, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1 : j], ' ') JOIN g y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[j + 1 : cuts.k], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
parts AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS over
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c WHERE k > 2) s, range(2, {WORDS}) t(m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN n USING (lang) LEFT JOIN parts USING (lang, phrase)
WHERE over IS NULL OR 100::HUGEINT * over < {COVERED} * a::HUGEINT
QUALIFY rank <= {BEST}
"""
QUERIES = {"op12_collocations": op12_collocations}
SQL = {"op12_collocations": OP12_SQL}
