"""Operator 9, toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is lower-cased and cut into words (runs of letters). A word enters the network as a word vector and a
character vector (the means of hashed vectors of its prefixes and of its trigrams), so words never seen are judged by
their characters. The words run through all overlapping windows of `WINDOW` words, one every `STRIDE`; in each, a GRU
reads forwards and one backwards, attention pools their states, and a logistic unit scores the window. A text's score
is its highest window's. Vectors start from the smoothed log-odds of each hash in the training texts; everything is
then trained together, each text through its highest window.

Training takes the labelled rows of at most `max_docs` documents, those with the smallest hashes of doc_id, half of
them toxic if there are so many, as far as their texts come to `max_chars` code points (a document that would go beyond is
left out); documents whose crc32(doc_id) mod 5 is 0 are held out. These bounds are the only ones: scoring reads whole
texts of all documents, in pieces of bounded memory. Labels, language, source and id are no inputs.

Edge cases: null, empty and wordless texts get the score of an empty window; of several labels of a document the
highest counts, null labels and labels of no document don't; a null id is held out; without toxic or without clean
labels all scores are 0; repeated rows are rows; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, small_batches

WINDOW, STRIDE, MAX_DOCS, MAX_CHARS = 32, 16, 2400, 50_000_000
WORD_BITS, CHAR_BITS, DIM, HIDDEN = 15, 17, 4, 8
SCALE = 0x9E3779B97F4A7C15
#: Code points per piece when texts are scored, and windows per pass of the network.
PIECE, PASS = 500_000, 2048

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def mix(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) * np.uint64(SCALE) >> np.uint64(64 - bits)).astype(np.int32)


class Words:
    """The words of some texts: per word the row of its distinct form; per form its word hash and character hashes."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        lengths = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(texts))
        points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        del lowered
        inside = letters()[points]
        edge = inside[1:] != inside[:-1]
        edge = np.flatnonzero(np.concatenate([inside[:1], edge]) if len(inside) else inside).astype(np.int32)
        del inside
        start, length = edge[::2], edge[1::2] - edge[::2]
        self.text_of_word = np.searchsorted(np.cumsum(lengths), start, side="right").astype(np.int32)
        self.count = np.bincount(self.text_of_word, minlength=len(texts))
        h = np.concatenate([self._hashes(points, start[k : k + self.STEP], length[k : k + self.STEP]) for k in range(0, max(1, len(start)), self.STEP)])
        forms, first, form = np.unique(h, return_index=True, return_inverse=True)
        self.form, self.word = form.astype(np.int32), mix(forms, WORD_BITS)
        start, length = start[first], length[first]
        parts = [self._characters(points, start[k : k + self.STEP], length[k : k + self.STEP]) for k in range(0, max(1, len(start)), self.STEP)]
        self.chars, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        self.char_start, self.char_size = np.cumsum(sizes) - sizes, np.maximum(sizes, 1)

    #: Words at a time, which bounds what the hashing takes beside its results.
    STEP = 100_000

    @staticmethod
    def _hashes(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """h_k = h_(k-1) * SCALE + point, for all words side by side."""
        h = np.zeros(len(start), np.uint64)
        order = np.argsort(-length, kind="stable")
        longest, k = -length[order], 0
        while active := int(np.searchsorted(longest, -k, side="left")):
            at = order[:active]
            h[at] = h[at] * np.uint64(SCALE) + points[start[at] + k].astype(np.uint64) + np.uint64(1)
            k += 1
        return h

    @staticmethod
    def _characters(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of prefixes of 2 to 6 letters and of all trigrams with both ends marked, form by form, and their numbers."""
        owner, hashes, n = [], [], len(start)
        p = np.full(n, 7, np.uint64)
        for k in range(6):
            ok = np.flatnonzero(length > k)
            p[ok] = p[ok] * np.uint64(SCALE) + points[start[ok] + k].astype(np.uint64)
            if k >= 1:
                owner.append(ok)
                hashes.append(p[ok])
        total = int(length.sum())
        who = np.repeat(np.arange(n), length)
        at = np.arange(total) - np.repeat(np.cumsum(length) - length, length) + start[who]
        left = np.where(at > start[who], points[np.maximum(at - 1, 0)], 0).astype(np.uint64)
        right = np.where(at + 1 < (start + length)[who], points[np.minimum(at + 1, len(points) - 1)], 0).astype(np.uint64)
        owner.append(who)
        hashes.append(((left * np.uint64(SCALE) + points[at]) * np.uint64(SCALE) + right) ^ np.uint64(0x5555))
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return mix(np.concatenate(hashes), CHAR_BITS)[order], np.bincount(owner, minlength=n)


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first word (within all words) of each window; every text has one at least."""
    each = np.maximum(1, -(-(count - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(count)), each)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
    return text, np.repeat(np.cumsum(count) - count, each) + nth * STRIDE


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Net:
    """Weights: word and character vectors, two GRUs (input, recurrent, bias), attention and output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f, h, d = np.float32, HIDDEN, 2 * DIM
        self.w = {"word": r.normal(0, 0.05, (1 << WORD_BITS, DIM)).astype(f), "char": r.normal(0, 0.05, (1 << CHAR_BITS, DIM)).astype(f), "att": r.normal(0, 0.1, 2 * h).astype(f), "out": r.normal(0, 0.3, 2 * h).astype(f), "bias": np.full(1, -2, f)}
        for k in "fb":
            self.w |= {f"x{k}": r.normal(0, d**-0.5, (d, 3 * h)).astype(f), f"h{k}": r.normal(0, h**-0.5, (h, 3 * h)).astype(f), f"b{k}": np.zeros(3 * h, f)}

    def forms(self, words: Words) -> np.ndarray:
        """Input of each distinct form, and a last row of zeros for the places behind a text."""
        n = len(words.word)
        out = np.zeros((n + 1, 2 * DIM), np.float32)
        out[:n, :DIM] = self.w["word"][words.word]
        if n:
            out[:n, DIM:] = np.add.reduceat(self.w["char"][words.chars], words.char_start, axis=0) / words.char_size[:, None]
        return out

    def run(self, projected: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; at: their rows of the projected inputs (windows x WINDOW)."""
        n, t, h = *at.shape, HIDDEN
        states, tape = np.zeros((t, n, 2 * h), np.float32), []
        for k, steps in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            own, s = (slice(0, h) if k == "f" else slice(h, 2 * h)), np.zeros((n, h), np.float32)
            for i in steps:
                x, u = projected[k][at[:, i]], s @ self.w[f"h{k}"]
                zr = sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
                m = mask[:, i, None]
                new = s + m * z * (c - s)
                if keep:
                    tape.append((k, i, s, z, r, c, u[:, 2 * h :]))
                s = new
                states[i, :, own] = s
        e = np.where(mask.T, states @ self.w["att"], -30)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        logits = pooled @ self.w["out"] + self.w["bias"][0]
        return (logits, states, a, pooled, tape) if keep else logits

    def project(self, forms: np.ndarray) -> dict[str, np.ndarray]:
        return {k: forms @ self.w[f"x{k}"] + self.w[f"b{k}"] for k in "fb"}

    def back(self, words: Words, forms: np.ndarray, at: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss of these windows."""
        h, g = HIDDEN, {k: np.zeros_like(v) for k, v in self.w.items() if k not in ("word", "char")}
        projected = self.project(forms)
        logits, states, a, pooled, tape = self.run(projected, at, mask, keep=True)
        d = ((sigmoid(logits) - target) * weight / weight.sum()).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pool = d[:, None] * self.w["out"]
        d_a = np.einsum("tnh,nh->tn", states, d_pool)
        d_e = a * (d_a - (a * d_a).sum(axis=0)) * mask.T
        g["att"] = np.einsum("tn,tnh->h", d_e, states)
        d_states = a[:, :, None] * d_pool + d_e[:, :, None] * self.w["att"]
        d_proj = {k: np.zeros_like(projected[k]) for k in "fb"}
        carry = {k: np.zeros((at.shape[0], h), np.float32) for k in "fb"}
        for k, i, s, z, r, c, uc in reversed(tape):
            own = slice(0, h) if k == "f" else slice(h, 2 * h)
            ds = carry[k] + d_states[i, :, own]
            m = mask[:, i, None]
            dn = ds * m
            dz, dc = dn * (c - s) * z * (1 - z), dn * z * (1 - c * c)
            dr = dc * uc * r * (1 - r)
            dx, du = np.concatenate([dz, dr, dc], 1), np.concatenate([dz, dr, dc * r], 1)
            g[f"h{k}"] += s.T @ du
            carry[k] = ds * (1 - m) + dn * (1 - z) + du @ self.w[f"h{k}"].T
            np.add.at(d_proj[k], at[:, i], dx)
        d_forms = np.zeros_like(forms)
        for k in "fb":
            g[f"x{k}"], g[f"b{k}"] = forms.T @ d_proj[k], d_proj[k].sum(axis=0)
            d_forms += d_proj[k] @ self.w[f"x{k}"].T
        n = len(words.word)
        g["word"], g["char"] = np.zeros_like(self.w["word"]), np.zeros_like(self.w["char"])
        used = np.flatnonzero(np.abs(d_forms[:n]).sum(axis=1))
        np.add.at(g["word"], words.word[used], d_forms[used, :DIM])
        size = words.char_size[used]
        where = np.repeat(words.char_start[used], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        np.add.at(g["char"], words.chars[where], np.repeat(d_forms[used, DIM:] / size[:, None], size, axis=0))
        return g


def layout(words: Words, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the forms for each place of these windows (the last row behind a text's end), and which places count."""
    end = np.cumsum(words.count)[text]
    place = first[:, None] + np.arange(WINDOW)
    mask = place < end[:, None]
    n = len(words.form)
    at = np.where(mask, words.form[np.minimum(place, max(n - 1, 0))] if n else 0, len(words.word))
    return at, mask


def window_logits(net: Net, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text, first = windows(words.count)
    projected, out = net.project(net.forms(words)), np.zeros(len(text), np.float32)
    for k in range(0, len(text), PASS):
        out[k : k + PASS] = net.run(projected, *layout(words, text[k : k + PASS], first[k : k + PASS]))
    return text, first, out


def log_odds(words: Words, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-odds of the label given that a text holds a word hash or a character hash, shrunk where it is rare."""
    counts = {bits: np.zeros((2, 1 << bits), np.int64) for bits in (WORD_BITS, CHAR_BITS)}
    ends = np.cumsum(words.count)
    for t, (end, n) in enumerate(zip(ends.tolist(), words.count.tolist(), strict=True)):
        own = np.unique(words.form[end - n : end])
        size = words.char_size[own]
        chars = words.chars[np.repeat(words.char_start[own], size) + _runs(size)]
        counts[WORD_BITS][int(toxic[t]), np.unique(words.word[own])] += 1
        counts[CHAR_BITS][int(toxic[t]), np.unique(chars)] += 1
    out = []
    for n, p in counts.values():
        odds = np.log((p + 0.5) / (toxic.sum() + 1)) - np.log((n + 0.5) / ((~toxic).sum() + 1))
        out.append((odds * (p + n) / (p + n + 8.0)).astype(np.float32))
    return out[0], out[1]


def train(texts: list[str], toxic: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 5, seeded: bool = True) -> Net | None:
    """Fits the network to texts and their labels; None without both kinds. seeded: vectors start from log-odds."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return None
    net, words, r = Net(), Words(texts), np.random.default_rng(seed)
    of_words, of_chars = log_odds(words, toxic)
    if seeded:
        net.w["word"][:, 0] += of_words * 0.5
        net.w["char"][:, 0] += of_chars
    mean, square = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    step, batch = 0, int(np.clip(len(texts) // 24, 16, 192))
    for epoch in range(epochs):
        text, first, logits = window_logits(net, words)
        # the highest window of each text; of toxic ones the clearest, so that one hit decides
        order = np.lexsort((logits, text))
        top = order[np.append(np.flatnonzero(np.diff(text[order])), len(order) - 1)]
        r.shuffle(top)
        for k in range(0, len(top), batch):
            own = top[k : k + batch]
            at, mask = layout(words, text[own], first[own])
            used, at = np.unique(at, return_inverse=True)
            sub = _Sub(words, used)
            g = net.back(sub, net.forms(sub), at.reshape(mask.shape), mask, toxic[text[own]].astype(np.float32), np.ones(len(own)))
            step += 1
            lr = rate * (1 - epoch / epochs) + 1e-3
            for key, d in g.items():
                if key in ("word", "char"):
                    rows = np.flatnonzero(np.abs(d).sum(axis=1))
                    d, m, s, w = d[rows], mean[key][rows], square[key][rows], net.w[key][rows]
                    m, s = 0.9 * m + 0.1 * d, 0.99 * s + 0.01 * d * d
                    mean[key][rows], square[key][rows] = m, s
                    net.w[key][rows] = w - lr * m / (np.sqrt(s) + 1e-6)
                else:
                    mean[key] = 0.9 * mean[key] + 0.1 * d
                    square[key] = 0.99 * square[key] + 0.01 * d * d
                    net.w[key] -= (lr * mean[key] / (1 - 0.9**step) / (np.sqrt(square[key] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _runs(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class _Sub:
    """The forms in `used` (the row behind the last form included or not)."""

    def __init__(self, words: Words, used: np.ndarray):
        own = used[used < len(words.word)]
        self.word, self.char_size = words.word[own], words.char_size[own]
        self.chars = words.chars[np.repeat(words.char_start[own], self.char_size) + _runs(self.char_size)]
        self.char_start = np.cumsum(self.char_size) - self.char_size


def score_texts(net: Net | None, texts: list[str]) -> np.ndarray:
    """Score of each text, 0 to 1, in pieces of about PIECE code points."""
    out, k = np.zeros(len(texts)), 0
    while net is not None and k < len(texts):
        end, size = k, 0
        while end < len(texts) and (end == k or size + len(texts[end]) <= PIECE):
            size += len(texts[end])
            end += 1
        text, _, logits = window_logits(net, Words(texts[k:end]))
        best = np.full(end - k, -np.inf)
        np.maximum.at(best, text, logits)
        out[k:end] = sigmoid(best)
        k = end
    return out


def held_out(id_column: str | Column) -> Column:
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", max_chars: int = MAX_CHARS) -> pa.Table:
    """At most max_docs labelled documents of max_chars code points in all that aren't held out, in order of doc_id."""
    own = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    pick = lambda t: own.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2)
    chosen = pick(True).unionByName(pick(False)).withColumnRenamed("doc_id", "l_id")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    # an id that many rows share counts once
    rows = cut(rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic")))
    sizes = sorted((r.h, r.doc_id, r.n) for r in rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.char_length("text").alias("n")).collect())
    total, ids = 0, []
    for _, i, n in sizes:
        if total + n <= max_chars:
            total += n
            ids.append(i)
    return (rows if len(ids) == len(sizes) else rows.where(F.col("doc_id").isin(ids))).toArrow().sort_by("doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, **options) -> Net | None:
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, max_docs)
    return train(rows["text"].to_pylist(), np.array(rows["toxic"].to_pylist(), bool), **options)


def score_documents(docs: DataFrame, net: Net | None, text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """The columns `extra` of docs and score, for every row. The network's size is fixed, so it travels with the task."""
    src = docs.select(*(F.col(c) for c in extra), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                scores = score_texts(net, b.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in extra), pa.array(scores, pa.float64())], names=[*extra, "score"])

    schema = ", ".join([*(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in extra), "score double"])
    return src.mapInArrow(go, schema)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns."""
    net = fit(docs, labels, max_docs)
    names, at = list(docs.columns), docs.columns.index(text_col)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                keep = pa.array(score_texts(net, [t or "" for t in b.column(at).to_pylist()]) < threshold)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in b.columns], names=names)

    return docs.mapInArrow(go, docs.schema)


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_documents(docs, net, extra=("doc_id",))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
