"""Chat formatting, line dedup and exact dedup."""

import collections
import hashlib

import duckdb
import pytest
from cases import LINE, SPACES, drop_lines, empty, rows, table
from pyspark.sql import functions as F

from voxmill.llm import chat_format as C
from voxmill.llm import exact_dedup as X
from voxmill.llm import line_dedup as L
from voxmill.llm import queries as Q

DATA = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equal_to_sql(spark, name):
    got = Q.QUERIES[name](spark, DATA)
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.execute(Q.SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in want[names].astype(object).itertuples(index=False, name=None))


def test_native_plans(spark):
    for name in ("op1_chat_format", "op5_line_dedup", "op10_exact_dedup"):
        plan = Q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("bits,hot", [(1 << 27, 1000), (64, 3), (128, 1000)])
def test_exact_dedup(spark, bits, hot):
    """In one segment and in many, and with groups that come back by the broadcast."""
    data = rows() + [(500, "short ", "en", "s1", 6, *[None] * 7), (499, "s hort", "en", "s1", 6, *[None] * 7)]
    got = X.exact_dedup(table(spark, data), filter_bits=bits, hot=hot).collect()
    groups = collections.defaultdict(list)
    for r in data:
        groups["".join(c for c in r[1] or "" if c not in SPACES)].append((r[0], r[1] or ""))
    assert len(got) == len(data)
    by_hash = collections.defaultdict(list)
    for r in got:
        by_hash[r.text_sha256].append(r)
    for norm, own in groups.items():
        best = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
        found = by_hash[sha(norm)]
        assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in own)
        assert {r.keep_id for r in found} == {best[0]} and {r.group_size for r in found} == {len(own)}
        assert [r.doc_id for r in found if r.kept] == [best[0]]
    assert X.exact_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("bits", [1 << 27, 1 << 10])
def test_bloom_filter(spark, bits):
    """Whatever the number of segments, rows with an equal are found, and most others pass without a shuffle."""
    n = 4000
    h = spark.range(n).select("id", F.xxhash64(F.when(F.col("id") < 300, F.col("id") % 100).otherwise(F.col("id"))).alias("h"))
    seen = X.sift(h, n, filter_bits=bits)
    got = {r.id: r.maybe for r in seen.collect()}
    assert len(got) == n and all(got[k] for k in range(300))
    assert sum(got.values()) < 300 + n * 0.15
    few = h.where(X.segment_of(F.col("h"), 4) == 1)
    plan = X.probe(few, X.repeated_bits(few, 2, 256), 2, 256)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "bit_xor" in plan


def test_all_copies(spark):
    """A table of one text: the whole group comes back by the broadcast."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    got = X.exact_dedup(docs).groupBy("keep_id", "group_size").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()
    assert [tuple(r) for r in got] == [(0, 3000, 3000, 1)]


def test_line_dedup(spark):
    data = rows() + [(None, LINE, None, None, None, *[None] * 7), (700, f"{LINE}\n\n{LINE}\n", None, None, None, *[None] * 7), (700, f"{LINE}\nother", None, None, None, *[None] * 7)]
    for hot in (1000, 3):  # by the shuffle, and by the broadcast of the common lines
        out = L.dedup_lines(table(spark, data), hot=hot)
        assert sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.text)) for r in out.collect()) == drop_lines(data)
    assert out.select("row.*").columns == table(spark).columns
    many = [(k, "\n".join(["some line of more than twenty characters"] * 3 + [f"own {k}"]), *[None] * 10) for k in range(50)]
    assert sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.text)) for r in L.dedup_lines(table(spark, many)).collect()) == drop_lines(many)
    assert L.dedup_lines(empty(spark)).count() == 0


def test_one_line_in_all_rows(spark):
    """A line of every document over many tasks, in a document of which one repeats it many times."""
    docs = spark.range(3000).repartition(16).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{LINE}\nown line of this document "), "id", F.when(F.col("id") == 5, F.repeat(F.lit(f"\n {LINE}"), 4000)).otherwise("")).alias("text"))
    got = L.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped) for r in got] == [(2 + 4000 * (k == 5), (1 + 4000 * (k == 5)) * (k != 2999)) for k in range(3000)]
    assert got[5].text == "own line of this document 5" and got[2999].text.startswith(LINE)


TREE = "tree long, id long, parent long, role string, text string, score double"


def paths(data, keep):
    """(tree, formatted texts) of the chosen branches by plain recursion."""
    out = []
    for tree in {r[0] for r in data}:
        own = {r[1]: r for r in data if r[0] == tree}
        children = collections.defaultdict(list)
        for r in own.values():
            if r[2] in own:
                children[r[2]].append(r[1])
        found = []

        def walk(i, path, total):
            path, total = [*path, i], total + (own[i][5] or 0)  # noqa: B023
            if not children[i]:  # noqa: B023
                found.append((-total, i, path))  # noqa: B023
            for c in children[i]:  # noqa: B023
                walk(c, path, total)

        for r in own.values():
            if r[2] not in own:
                walk(r[1], [], 0)
        for rank, (_, leaf, path) in enumerate(sorted(found)[:keep], 1):
            out.append((tree, leaf, rank, [(own[i][3] or "", own[i][4] or "") for i in path]))
    return sorted(map(repr, out))


def test_reply_trees(spark):
    data = [(1, 0, None, "system", "s", 0.0)] + [(1, k, (k - 1) // 2, "user" if k % 2 else "assistant", f"t{k} \\b</turn># \\", float(k % 5)) for k in range(1, 20)]
    data += [(2, 5, 99, None, None, None), (2, 6, 5, "role: x\n\\c", "a\n: b", 1.0), (None, 1, None, "user", "x", None)]
    data += [(3, k, k - 1 if k else None, "assistant", f"{k}", 0.0) for k in range(70)]
    for keep in (1, 3, None):
        got = C.format_trees(spark.createDataFrame(data, TREE), keep).select("tree", "leaf", "rank", C.read_turns(F.col("formatted")).alias("t")).collect()
        assert sorted(repr((r.tree, r.leaf, r["rank"], [(x.role, x.text) for x in r.t])) for r in got) == paths(data, keep)
    circle = [(4, 1, 2, "user", "x", 0.0), (4, 2, 1, "user", "y", 0.0), (4, 3, None, "user", "z", 0.0)]
    assert [r.leaf for r in C.format_trees(spark.createDataFrame(circle, TREE)).collect()] == [3]
    assert C.format_trees(spark.createDataFrame([], TREE)).count() == 0
    twice = [(5, 1, None, "user", "b", 0.0), (5, 1, None, "user", "a", 0.0)]
    assert [r.formatted for r in C.format_trees(spark.createDataFrame(twice, TREE)).collect()] == ["### user: a</turn>\n"]


def test_loss_mask(spark):
    data = [(1, 0, "user", C.HARD_TEXT), (1, 1, "assistant", C.HARD_TEXT), (1, 2, "assistant", "é👩‍👩‍👧"), (2, None, None, None), (2, 1, "user", "q"), (2, 1, "user", "q")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in C.format_trees(C.as_chains(df)).withColumn("loss", C.read_loss(F.col("formatted"), F.col("loss_spans"))).withColumn("turns", C.read_turns(F.col("formatted"))).collect()}
    assert got[1].loss == C.HARD_TEXT + "é👩‍👩‍👧" and [x.text for x in got[1].turns] == [C.HARD_TEXT, C.HARD_TEXT, "é👩‍👩‍👧"]
    assert got[2].loss == "" and [(x.role, x.text) for x in got[2].turns] == [("", ""), ("user", "q"), ("user", "q")]
    assert got[1].formatted.count("</turn>") == 3 and got[1].formatted.count("###") == 3


def test_chat_with_clashing_columns_and_long_texts(spark, tmp_path):
    """Columns named like the operator's own, a text of a million code points, and a conversation of many turns."""
    long = "\\### Assistant: </turn> \n" * 40_000
    data = [(1, 0, "user", long), (1, 1, "assistant", long), *((2, k, "assistant" if k % 2 else "user", f"turn {k} <#\\>") for k in range(700))]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    for name in ("tree", "id", "parent", "score", "n", "up", "depth", "leaf", "rank", "pos", "formatted"):
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in C.op1_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, -7}
    for conv in (1, 2):
        own = [r for r in data if r[0] == conv]
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == sha("".join(f"{r[2]}\n{r[3]}\n" for r in own))
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))


def test_segments_read_their_own_rows(spark):
    """The passes of a segment read its folder, whatever the number of segments."""
    rows = spark.range(4000).select(F.col("id").alias("row_id"), F.xxhash64("id").alias("h"))
    for segments in (1, 8, 64):
        table = X.segmented(rows, segments)
        assert table.count() == 4000
        plan = table.where("segment = 0")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(segment" in plan
        files = {r.f for r in table.where("segment = 0").select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
        assert files and all("/segment=0/" in f for f in files)
