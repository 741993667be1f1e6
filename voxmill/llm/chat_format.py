r"""Operator 1, chat formatting, in DataFrame functions only.

Messages form reply trees. Iterative self-joins double the distance that each message looks up (a tree of depth d
takes log2 d joins) and add up depth and score; the leaves are ranked by the score of their branch, and the joins are
run backwards over the kept steps to list the messages of each chosen path. Each round is a plan of one join between
written tables, so plans don't grow with depth. Only ids and numbers take part; texts are joined once, at the end. A path is one conversation and one row, so its size bounds a task, not the tree's.

Template of a turn: `### role: text</turn>\n`. In roles and texts `\` becomes `\b`, `<` becomes `\l` and `#` becomes
`\h`; in roles also `:` becomes `\c` and a line break `\n`. So no text can hold a marker, and undoing the letters,
`\b` last, gives the text back. loss_spans lists [start, end) in code points of each assistant text in `formatted`.

Edge cases: a null role or text is empty; a message whose parent is null or not in its tree is a root; of messages
that share tree and id one stays (smallest parent, role, text); messages whose ancestors form a circle have no root
and are on no path; a null tree is a tree of its own; ties of score go to the smaller leaf id; an empty table gives
no row; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shared_path, text_of, written

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))


def escape(text: Column, pairs=ESCAPES) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def unescape(text: Column, pairs=ESCAPES) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[1]), F.lit(p[0])), pairs[::-1], text)


#: A step: a message, the ancestor 2**round above it (null past the root), and depth and score of what lies between.
STEPS = "tree {tree}, id {id}, up {id}, depth long, total double, round int, open boolean"


def climb(nodes: DataFrame, at: str) -> tuple[DataFrame, int]:
    """From tree, id, parent, score: the steps of all rounds, and how many rounds there were. A message is `open` in the
    rounds after which it still has an ancestor to look up; the round that closes it gives its depth (messages on its
    path) and the total score of the path. Each round appends to one table, so every plan scans a table and joins once."""
    kinds = dict(nodes.dtypes)
    schema = STEPS.format(tree=kinds["tree"], id=kinds["id"])

    def keep(df: DataFrame, k: int) -> DataFrame:
        df = df.withColumns({"round": F.lit(k), "open": F.isnotnull("up")})
        df.write.mode("append").partitionBy("round", "open").parquet(at)
        return nodes.sparkSession.read.schema(schema).parquet(at)

    ids = nodes.select(F.col("tree").alias("t"), F.col("id").alias("i"))
    first = nodes.join(ids, nodes["tree"].eqNullSafe(ids["t"]) & (nodes["parent"] == ids["i"]), "left")
    steps, k = keep(first.select("tree", "id", F.col("i").alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total")), 0), 0
    most = steps.count()
    while 2**k <= most and steps.where(F.col("open") & (F.col("round") == k)).limit(1).count():  # longer than all messages: only circles are left
        a = steps.where(F.col("open") & (F.col("round") == k)).drop("round", "open")
        known = steps.where(~F.col("open") | (F.col("round") == k))
        b = known.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        both = a.join(b, a["tree"].eqNullSafe(b["t"]) & (a["up"] == b["i"]))
        k += 1
        steps = keep(both.select("tree", "id", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total")), k)
    return steps, k


def chosen_paths(nodes: DataFrame, keep: int | None = 1) -> DataFrame:
    """Rows of tree, leaf, rank, pos, id: the messages of the `keep` best branches of each tree (None: of all)."""
    steps, rounds = climb(nodes, shared_path(nodes.sparkSession, "steps"))
    parents = nodes.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("u")).distinct()
    top = steps.where(~F.col("open"))
    leaves = top.join(parents, top["tree"].eqNullSafe(parents["t"]) & (top["id"] == parents["u"]), "left_anti")
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "id")))
    if keep is not None:
        leaves = leaves.where(F.col("rank") <= keep)
    path = cut(leaves.select("tree", F.col("id").alias("leaf"), "rank", (F.col("depth") - 1).alias("pos"), "id"))
    for k in reversed(range(rounds)):
        jump = steps.where(F.col("open") & (F.col("round") == k)).select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        path = path.join(jump, path["tree"].eqNullSafe(jump["t"]) & (path["id"] == jump["i"]), "left")
        both = F.array(F.struct("pos", "id"), F.struct((F.col("pos") - 2**k).alias("pos"), F.col("up").alias("id")))
        path = cut(path.select("tree", "leaf", "rank", F.explode(F.filter(both, lambda s: s.id.isNotNull())).alias("s")).select("tree", "leaf", "rank", "s.pos", "s.id"))
    return path


def format_trees(messages: DataFrame, keep: int | None = 1, unique: bool = False) -> DataFrame:
    """From tree, id, parent, role, text, score: tree, leaf, rank, formatted and loss_spans, one row per chosen path.
    unique: tree and id are known to identify a message."""
    messages = messages.select("tree", "id", "parent", "role", "text", "score")
    if not unique:
        own = Window.partitionBy("tree", "id").orderBy("parent", "role", "text")
        messages = messages.withColumn("n", F.row_number().over(own)).where("n = 1").drop("n")
    messages = written(messages, "messages")
    path = chosen_paths(messages.select("tree", "id", "parent", "score"), keep)
    said = messages.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.concat(F.lit(OPEN), escape(text_of("role"), ROLE_ESCAPES), F.lit(MID)).alias("head"), escape(text_of("text")).alias("body"), (text_of("role") == "assistant").alias("learnt"))
    turns = path.join(said, path["tree"].eqNullSafe(said["t"]) & (path["id"] == said["i"]))
    before = Window.partitionBy("tree", "leaf").orderBy("pos")
    length = F.char_length("head") + F.char_length("body") + len(CLOSE)
    turns = turns.withColumn("start", F.sum(length).over(before) - F.char_length("body") - len(CLOSE))
    turn = F.struct("pos", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), F.struct("start", (F.col("start") + F.char_length("body")).alias("end")).alias("span"), "learnt")
    out = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return out.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda x: x.turn), "").alias("formatted"), F.transform(F.filter("turns", lambda x: x.learnt), lambda x: x.span).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as structs of role and text."""
    parts = F.split(formatted, CLOSE, -1)

    def one(part: Column) -> Column:
        line = F.substr(part, F.lit(len(OPEN) + 1))
        role = F.substring_index(line, MID, 1)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substr(line, F.char_length(role) + len(MID) + 1)).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), one)


def read_loss(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")


def as_chains(conversations: DataFrame) -> DataFrame:
    """Turns of a flat conversation as a tree without branches; ties of turn by role and text, null turns first."""
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("id", F.row_number().over(own).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


HARD_TEXT = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    out = format_trees(as_chains(rows.unionByName(hard)), unique=True)
    turns = read_turns(F.col("formatted"))
    joined = F.array_join(F.transform(turns, lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    loss = read_loss(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        F.col("tree").alias("conv_id"), F.size(turns).cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '{HARD_TEXT}' FROM range(2) s(t)),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    14 + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\<#:\n]', '', 'g')) AS chars
  FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
QUERIES = {"op1_chat_format": op1_chat_format}
SQL = {"op1_chat_format": OP1_SQL}
