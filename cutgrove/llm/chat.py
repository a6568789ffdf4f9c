"""Chat formatting over reply trees with built-in functions only.

Iterative self-joins double each message's ancestor pointer (after k rounds it points 2^k messages up), so a tree of
depth d takes about log2(d) joins. The same pointers give every leaf's path score and, walked from large steps to small,
the messages on the path. Branches are ranked by mean message score and every chosen path becomes one conversation.

Template: ``### role: text</turn>`` and a line feed per turn. In texts and roles the characters ``\\ # < :`` are
written ``\\b \\h \\l \\c``, so control strings cannot occur inside a text and the mapping can be undone.

Null texts and roles are empty; a null tree is a tree of its own; a parent that is null or absent makes a root; messages
on a parent cycle have no root and no leaf and are left out, and so are those whose own id is null, as nothing places
them; of messages with one id in a tree the smallest by (parent, role, text, score) counts, so repeated rows are one
message; empty tables give no rows. Ties between branches: smaller leaf id first. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

HEAD, MID, END = "### ", ": ", "</turn>\n"
#: Escapes, undone in this order; a backslash is only ever written as the first character of one of them.
ESCAPES = (("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(b), F.lit(a))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def _unique(messages: DataFrame) -> DataFrame:
    """One row for each (tree, node); the tree is wrapped, because a struct of null equals itself in joins."""
    rest = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    found = messages.filter("node is not null").select(F.struct("tree").alias("tree"), "node", rest.alias("rest"))
    return cut(found.groupBy("tree", "node").agg(F.min("rest").alias("rest")).select("tree", "node", "rest.*"))


def _paths(messages: DataFrame, top_k: int | None) -> DataFrame:
    ids = messages.select("tree", "node")
    known = ids.withColumnRenamed("node", "parent").withColumn("known", F.lit(True))
    jump = messages.select("tree", "node", "parent", "score").join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up0"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    most = ids.groupBy("tree").count().agg(F.max("count")).first()[0] or 1
    rounds = max(1, int(most).bit_length())
    for k in range(rounds):
        other = jump.select("tree", F.col("node").alias(f"up{k}"), F.col(f"up{k}").alias(f"up{k + 1}"), F.col("total").alias("t2"), F.col("depth").alias("d2"))
        jump = jump.join(other, ["tree", f"up{k}"], "left").withColumn("total", F.col("total") + F.coalesce("t2", F.lit(0.0))).withColumn("depth", F.col("depth") + F.coalesce("d2", F.lit(0))).drop("t2", "d2")
        if k % 2:
            jump = cut(jump)  # each round reads the one before twice
    jump = cut(jump).filter(F.col(f"up{rounds}").isNull())
    parents = jump.filter("up0 is not null").select("tree", F.col("up0").alias("node")).distinct()
    leaves = jump.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("depth")).alias("path_score"))
    leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if top_k is not None:
        leaves = leaves.filter(F.col("rank") <= top_k)
    path = leaves.withColumn("node", F.col("leaf"))
    for k in reversed(range(rounds)):
        step = jump.select("tree", "node", F.col(f"up{k}").alias("next"))
        both = F.explode(F.array_compact(F.array("node", "next"))).alias("node")
        path = path.join(step, ["tree", "node"], "left").select("tree", "leaf", "path_score", "rank", both)
    return path.join(jump.select("tree", "node", "depth"), ["tree", "node"])


def reply_paths(messages: DataFrame, top_k: int | None = None) -> DataFrame:
    """(tree, leaf, rank, path_score, node, depth) from messages(tree, node, parent, score): chosen root-to-leaf paths."""
    for c in ("role", "text"):
        messages = messages if c in messages.columns else messages.withColumn(c, F.lit(None).cast("string"))
    return _paths(_unique(messages), top_k).select("tree.tree", "leaf", "rank", "path_score", "node", "depth")


def format_trees(messages: DataFrame, top_k: int | None = None, loss_roles: tuple = ("assistant",)) -> DataFrame:
    """(tree, leaf, rank, path_score, formatted, loss_spans): one conversation per chosen path.

    loss_spans: array of (start, len) in code points of ``formatted``, start from 0, one for each text to learn from.
    """
    messages = _unique(messages)
    turns = _paths(messages, top_k).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    body, head = escape(F.col("text")), F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(MID))
    order = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.select("tree", "leaf", "rank", "path_score", "depth", "role", head.alias("head"), body.alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END))).withColumn("stop", F.sum(F.length("piece")).over(order))
    start = F.col("stop") - len(END) - F.length("body")
    turns = turns.withColumn("span", F.when(F.col("role").isin(*loss_roles), F.struct(start.cast("int").alias("start"), F.length("body").alias("len"))))
    out = turns.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("path_score").alias("path_score"), F.sort_array(F.collect_list(F.struct("depth", "piece", "span"))).alias("turns"))
    return out.select("tree.tree", "leaf", "rank", "path_score", F.array_join("turns.piece", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"))


def linear_messages(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as messages: each row answers the row before it (by turn, then role and text)."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.select(F.col("conv_id").alias("tree"), at.cast("long").alias("node"), "role", "text").select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"))
