"""Operator 2, MinHash near-dedup by a chosen-path set similarity join.

1. Each text becomes its set of shingles, 128 bits of the set, and `COORDS` minwise tokens. Equal sets are one
   representative (of the smallest doc_id) from here on, summed per task before the shuffle.
2. `TREES` independent trees: at its root a document takes the branch of one minwise token; a node with more than
   `LEAF` documents branches again by two tokens that the node's hash selects, and so on. A pair of similarity s stays
   together in a tree with probability s at the root and 1 - (1 - s)**2 below, so 8 trees miss a pair of 0.85 with
   less than one in a million. Nodes of up to LEAF documents are compared exhaustively on all their tokens, pairs that
   agree in too few of them to be at the threshold (less than 1e-7) fall out. A node of which one child keeps half is
   a group of near copies that tokens can't divide: its documents are chained to its smallest, not paired.
3. The candidates' components are clusters of texts to compare in full, from shingle sets that are made anew from whole
   texts, with exact sizes of all intersections by matrix products over the shingles that two texts share, and links by
   the threshold in whole numbers. A cluster that fits in a task is one task. A larger one is dealt into blocks, and first
   each of its texts is compared with `PIVOTS` of them: those that are linked to the first pivot, directly or through
   another, are its core, one component already. Only pairs with a text outside the core are left, so the blocks of such
   texts meet each other and the core's blocks: a group of N near copies moves N texts, not N squared.
   A task returns its components as stars, never its pairs.
4. The links' components, with equal sets and rows that share doc_id added, give component_id.

So no step emits all pairs of a large group. Texts are shuffled once to find those of clusters, which are written, and
these once for the comparison (in clusters above BLOCK_DOCS once for the core, and once per block of texts outside it).

Recall: a pair of similarity s is missed by all trees with (1 - s)**8 at the root (3e-7 at 0.85, 2.6e-6 at 0.80), and with
1 - (1 - (1 - s)**2)**k more per tree for k levels below it; most pairs are also found through others of their group.
tests/llm measures it on pairs just above the threshold.

Edge cases: a null text is empty; sets without shingles (no words) are linked with nothing and kept; texts of fewer
words than a shingle have their whole sequence as one; rows that share doc_id are one document, linked by each of its
texts; a null doc_id is in the component of its text's group, or has none, and is never kept; an empty table gives no
row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, small_batches, text_of, written
from .components import components
from .shingles import factors_of, set_hashes, shingle_sets, signature

PERCENT, WORDS = 85, 5
TREES, COORDS, LEAF, BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS = 8, 64, 32, 1024, 1_000_000, 8


def least_agreement(percent: int, coords: int) -> int:
    """Agreeing tokens below which a pair of this similarity stays with less than 1e-7: the mean less 5.5 deviations."""
    p = percent / 100
    return max(1, int(np.floor(coords * p - 5.5 * np.sqrt(coords * p * (1 - p)))))


def sketches(docs: DataFrame, words: int, coords: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key (a hash of the text), n (size of the set), h1, h2 (its hash) and sig (its minwise tokens)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = factors_of(coords)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = shingle_sets(part.column("text").to_pylist(), words)
                hashes = [set_hashes(s) for s in sets]
                sigs = np.concatenate([signature(s, factors) for s in sets]) if sets else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * coords), pa.array(sigs)),
                ], names=["doc_id", "text_key", "n", "h1", "h2", "sig"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    return src.mapInArrow(go, "doc_id long, text_key long, n long, h1 long, h2 long, sig array<int>")


def candidate_links(reps: DataFrame, percent: int, trees: int = TREES, coords: int = COORDS, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) between ids whose sets may be similar enough, directly or through others. reps: id, n, sig."""
    nodes = reps.select("id", F.posexplode(F.slice("sig", 1, trees))).select("id", F.xxhash64("pos", "col").alias("node"), F.lit(1 << 62).alias("above"))
    small, dense = None, None
    while True:
        nodes = cut(nodes)
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = cut(nodes.join(sizes, "node"))
        part, rest = sized.where(F.col("size") <= leaf).select("node", "id"), sized.where(F.col("size") > leaf)
        stuck, deep = rest.where(F.col("size") * 2 >= F.col("above")).select("node", "id"), rest.where(F.col("size") * 2 < F.col("above"))
        small, dense = (part, stuck) if small is None else (small.unionByName(part), dense.unionByName(stuck))
        if not deep.limit(1).count():
            break
        branch = F.explode(F.array(F.lit(0), F.lit(1))).alias("j")
        deep = deep.join(reps.select("id", "sig"), "id").select("id", "sig", "node", F.col("size").alias("above"), branch)
        token = F.get("sig", F.pmod(F.xxhash64("node", "j"), F.lit(coords)).cast("int"))
        nodes = deep.select("id", F.xxhash64("node", "j", token).alias("node"), "above")

    members = small.groupBy("node").agg(F.array_sort(F.collect_set("id")).alias("ids")).where("size(ids) > 1").select("ids").distinct()
    firsts = members.select("ids", F.posexplode("ids")).where("pos + 1 < size(ids)").select(F.col("col").alias("a"), F.slice("ids", F.col("pos") + 2, F.size("ids")).alias("rest"))
    pairs = firsts.select("a", F.explode("rest").alias("b")).distinct()
    one = reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    close = pairs.join(one, "a").join(two, "b").where(fits).where(agree >= least_agreement(percent, coords)).select("a", "b")
    heads = dense.groupBy("node").agg(F.min("id").alias("b"))
    chained = dense.join(heads, "node").select(F.col("id").alias("a"), "b").where("a <> b")
    return close.unionByName(chained)


def links_between(sets: list[np.ndarray], percent: int, first: int | None = None, columns: int = 2048) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, by exact counts, of the first sets (None: all) with all sets."""
    m = len(sets)
    first = m if first is None else first
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1  # a shingle of one text is in no intersection
    number = np.cumsum(shared) - 1
    use = shared[token]
    owner, token = owner[use], number[token[use]]
    common = np.zeros((first, m), np.float32)  # whole numbers below 2**24, exact
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    for k in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(token, [k, k + columns])
        part = np.zeros((m, columns), np.float32)
        part[owner[a:b], token[a:b] - k] = 1
        common += part[:first] @ part.T
    common = common.astype(np.int64)
    link = 100 * common >= percent * (sizes[:first, None] + sizes[None, :] - common)
    return link & (sizes[:first] > 0)[:, None] & (sizes > 0)[None, :]


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component (a position) of each set under these links."""
    m = len(sets)
    link = links_between(sets, percent)
    np.fill_diagonal(link, True)
    root = np.arange(m)
    while True:
        new = np.where(link, root[None, :], m).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def sets_of(rows: Iterator[tuple], words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and shingle sets of rows that end with id and text, in order of ids; texts become sets a few at a time. Repeats
    of a row are one."""
    ids, sets, piece = [], [], []
    for *_, x, t in rows:
        if ids and ids[-1] == x:
            continue
        ids.append(x)
        piece.append(t)
        if len(piece) == 64:
            sets += shingle_sets(piece, words)
            piece = []
    return np.array(ids, np.int64), sets + shingle_sets(piece, words)


def compare_blocks(texts: DataFrame, percent: int, words: int) -> DataFrame:
    """From cluster, i, j, id, text: links (a, b) to the smallest id of each component found in (cluster, i, j)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in ("cluster", "i", "j", "id", "text")), strict=True))
        for _, own in groupby(rows, key=lambda r: r[:3]):
            ids, sets = sets_of(own, words)
            root = linked(sets, percent)
            a, b = ids, ids[root]
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return texts.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id").mapInArrow(go, "a long, b long")


def core_of(texts: DataFrame, percent: int, words: int) -> DataFrame:
    """From cluster, i, pivot, id, text, each (cluster, i) with all pivots of the cluster: cluster, id and head of the rows
    that aren't pivots; head is the cluster's first pivot for those of its core, else null."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in ("cluster", "i", "pivot", "id", "text")), strict=True))
        for (cluster, _), own in groupby(rows, key=lambda r: r[:2]):
            own = iter(own)
            first, of_pivots = next(own), []
            while first is not None and first[2] == 0:  # pivots sort first
                of_pivots.append(first)
                first = next(own, None)
            p_ids, p_sets = sets_of(iter(of_pivots), words)
            core = np.zeros(len(p_ids), bool)
            core[0] = True
            near = links_between(p_sets, percent)
            while (more := near[core].any(axis=0) | core).sum() > core.sum():
                core = more
            rest = chain([first] if first is not None else [], own)
            while few := list(islice(rest, 256)):
                ids, sets = sets_of(iter(few), words)
                inside = links_between([*p_sets, *sets], percent, len(p_sets))[core].any(axis=0)[len(p_sets) :]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), cluster)), pa.array(ids), pa.array(np.full(len(ids), p_ids[0]), mask=~inside)], names=["cluster", "id", "head"])

    return texts.repartition("cluster", "i").sortWithinPartitions("cluster", "i", "pivot", "id").mapInArrow(go, "cluster long, id long, head long")


def blocks_needed(docs: Column, shingles: Column, block_docs: int) -> Column:
    return F.ceil(F.greatest(docs / block_docs, shingles / BLOCK_SHINGLES)).cast("int")


def dealt(rows: DataFrame, blocks: Column) -> Column:
    return F.pmod(F.xxhash64("id"), blocks).cast("int")


def full_comparison(clusters: DataFrame, texts: DataFrame, percent: int, words: int, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All links within the clusters (cluster, id, n), up to components: (a, b). texts: id, text."""
    sums = [F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")]
    sizes = cut(clusters.groupBy("cluster").agg(*sums).select("cluster", blocks_needed(F.col("docs"), F.col("shingles"), block_docs).alias("blocks")))
    placed = clusters.join(sizes, "cluster")

    def with_texts(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("id", "c_id").join(texts, F.col("c_id") == F.col("id")).drop("c_id")

    whole = placed.where("blocks = 1").select("cluster", F.lit(0).alias("i"), F.lit(0).alias("j"), "id")
    found = compare_blocks(with_texts(whole), percent, words)
    if not sizes.where("blocks > 1").limit(1).count():
        return found
    large = placed.where("blocks > 1")
    pivots = large.groupBy("cluster", "blocks", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("k")).agg(F.min("id").alias("id"))
    pivots = cut(with_texts(pivots.select("cluster", "blocks", "id")))
    of_block = pivots.select("cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("pivot"), "id", "text")
    members = large.select("cluster", dealt(large, F.col("blocks")).alias("i"), F.lit(1).alias("pivot"), "id")
    told = cut(core_of(of_block.unionByName(with_texts(members)), percent, words))
    found = found.unionByName(told.select(F.col("id").alias("a"), F.col("head").alias("b")))
    # what isn't in the core meets its like, and the core
    left = told.where("head is null").select("cluster", "id")
    if not left.limit(1).count():
        return found
    left = left.join(large.select("id", "n"), "id")
    many = left.groupBy("cluster").agg(*sums).select("cluster", blocks_needed(F.col("docs"), F.col("shingles"), block_docs).alias("left_blocks"))
    pair = F.struct(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    ours = left.join(many, "cluster").withColumn("x", dealt(left, F.col("left_blocks")))
    ours = ours.join(sizes, "cluster").select("cluster", "id", "x", F.explode(F.expr("sequence(0, left_blocks + blocks - 1)")).alias("y")).select("cluster", "id", pair.alias("p"))
    core = told.where("head is not null").select("cluster", "id").join(many, "cluster").join(sizes, "cluster")
    core = core.withColumn("y", F.col("left_blocks") + dealt(core, F.col("blocks"))).select("cluster", "id", "y", F.explode(F.expr("sequence(0, left_blocks - 1)")).alias("x")).select("cluster", "id", pair.alias("p"))
    tiles = with_texts(ours.unionByName(core).select("cluster", "p.i", "p.j", "id"))
    return found.unionByName(compare_blocks(tiles, percent, words))


def near_dedup(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    small_batches(docs.sparkSession)
    rows = cut(sketches(docs, words, COORDS, id_col, text_col))
    keys = ["h1", "h2", "n"]
    best = F.min(F.struct("doc_id", "text_key")).alias("row")
    reps = cut(rows.where("n > 0 and doc_id is not null").groupBy(*keys).agg(best, F.first("sig").alias("sig"))).select(*keys, "sig", F.col("row.doc_id").alias("doc_id"), F.col("row.text_key").alias("text_key"), F.monotonically_increasing_id().alias("id"))
    clusters = components(candidate_links(reps.select("id", "n", "sig"), percent, trees))
    clusters = clusters.select("id", F.col("component_id").alias("cluster")).unionByName(clusters.select(F.col("component_id").alias("id"), F.col("component_id").alias("cluster")).distinct())
    own = cut(clusters.join(reps.select("id", "n", "doc_id", "text_key"), "id"))
    texts = docs.select(F.col(id_col).cast("long").alias("t_id"), text_of(text_col).alias("text")).withColumn("t_key", F.xxhash64("text"))
    texts = own.select("id", "doc_id", "text_key").join(texts, (F.col("doc_id") == F.col("t_id")) & (F.col("text_key") == F.col("t_key"))).select("id", "text")
    texts = written(texts, "clustered")  # texts of clusters only, from which every comparison takes its own
    found = cut(full_comparison(own.select("cluster", "id", "n"), texts, percent, words, block_docs))  # else a task would hold two Python workers

    member = rows.where("n > 0").select("doc_id", *keys).join(reps.select(*(F.col(k).alias(f"r_{k}") for k in keys), "id"), [F.col(k) == F.col(f"r_{k}") for k in keys], "left").select("doc_id", "n", "id")
    heads = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("doc_id", "head")
    if heads.limit(1).count():  # rows that share an id and differ in text
        found = found.unionByName(member.join(heads, "doc_id").select(F.col("id").alias("a"), F.col("head").alias("b")))
    tree = reps.select("id", "doc_id").join(components(found).withColumnRenamed("id", "t_id"), F.col("id") == F.col("t_id"), "left").select("id", "doc_id", F.coalesce("component_id", "id").alias("root"))
    least = tree.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = tree.select("id", "root").join(least, "root").select(F.col("id").alias("t_id"), "component_id")
    out = member.join(named, F.col("id") == F.col("t_id"), "left").select("doc_id", "n", "component_id")
    out = out.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each component, all without words, all with a null id that no document equals."""
    told = near_dedup(docs, percent, words, id_col, text_col)
    ids = told.where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    twice = docs.groupBy(id_col).count().where("count > 1").limit(1).count()
    out = docs.join(ids, docs[id_col].cast("long") == ids["_kept"], "left_semi")
    if twice:  # of rows that share an id, those with words are one document
        src = out.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.regexp_count(text_of(text_col), F.lit(r"[^\x20\x09-\x0D]")) > 0)
        src = src.toDF("row", "_id", "_words")
        first = src.where("_words").groupBy("_id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
        out = first.unionByName(src.where("not _words").select("row.*"))
    return out.unionByName(docs.where(F.col(id_col).isNull()))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
h AS (SELECT doc_id, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, least(doc_id, coalesce(m.least, doc_id)) AS component_id, doc_id <= coalesce(m.least, doc_id) AS kept
FROM n LEFT JOIN m ON m.a = doc_id
"""
QUERIES = {"op2_minhash": op2_minhash}
SQL = {"op2_minhash": OP2_SQL}
