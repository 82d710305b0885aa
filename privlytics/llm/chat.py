"""Chat formatting over reply trees.

Messages are (conv_id, node, parent, role, text, score). Jump tables are built by self-joins (each message's 1st, 2nd,
4th, 8th ... ancestor); from every leaf the same tables, used from the longest jump down, enumerate the whole path to the
root in as many joins as the logarithm of the depth. Branches of a conversation are ranked by the sum of their scores, on
ids alone; texts are fetched for the chosen paths, each of which becomes one formatted conversation.

The template is ``<turn ROLE>\\nTEXT</turn>\\n``. Inside roles and texts, a backslash becomes ``\\b``, ``<`` becomes
``\\l`` and ``#`` becomes ``\\h``, inside roles also ``>`` becomes ``\\g``; so ``<`` and ``#`` never stand in content nor ``>``
in a role, and ``unescape`` restores both exactly.
The loss mask covers each assistant text, as spans of code points of the formatted text.

Cases: null text, role: empty. Null conv_id: one conversation of its own. Repeated messages of a linear conversation: each
is a turn, ordered by turn, role, text. Repeated (conv_id, node): one message, the one whose parent, role, text and score
sort first, null before all others. A null node answers nothing and is not answered. A parent that does not exist: the
message is a root. Ties of branch scores: the smallest leaf. Messages on a circle of parents, and those that hang on one,
have no path to a root and are left out. Very long texts are handled like others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#"))
    return F.replace(F.replace(out, F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def linear_tree(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as chains of replies, each turn answering the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (conv_id, node, up): the ancestors at distance 1, 2, 4, ..., as far as there are any; and those further than any path to a root is long."""
    a, b = nodes.alias("a"), nodes.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id"))
    step = a.join(b, same & (F.col("a.parent") == F.col("b.node"))).select("a.conv_id", "a.node", F.col("a.parent").alias("up"))
    out: list[DataFrame] = []
    limit = nodes.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    while (1 << len(out)) < max(2, limit):
        step = materialize(step, "chat-jump")
        if step.isEmpty():
            return out, None
        out.append(step)
        a, b = step.alias("a"), step.alias("b")
        step = a.join(b, same & (F.col("a.up") == F.col("b.node"))).select("a.conv_id", "a.node", F.col("b.up").alias("up"))
    return out, materialize(step, "chat-endless")


def reply_paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, dist) for every root-to-leaf path of distinct (conv_id, node); dist: replies from the node down to the leaf."""
    nodes = materialize(messages.select("conv_id", "node", "parent"), "chat-nodes")
    jumps, endless = _jumps(nodes)
    n, c = nodes.alias("n"), nodes.filter("parent is not null").select("conv_id", "parent").distinct().alias("c")
    leaves = n.join(c, F.col("n.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("n.node") == F.col("c.parent")), "left_anti")
    if endless is not None:
        m, e = leaves.select("conv_id", "node").alias("m"), endless.select("conv_id", "node").alias("e")
        leaves = m.join(e, F.col("m.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("m.node") == F.col("e.node")), "left_anti")
    paths = leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist"))
    for k, step in reversed([*enumerate(jumps)]):
        p, j = paths.alias("p"), step.alias("j")
        above = p.join(j, F.col("p.conv_id").eqNullSafe(F.col("j.conv_id")) & (F.col("p.node") == F.col("j.node"))).select("p.conv_id", "p.leaf", F.col("j.up").alias("node"), (F.col("p.dist") + (1 << k)).alias("dist"))
        paths = materialize(paths.unionByName(above), "chat-paths")
    return paths


def format_chats(messages: DataFrame, branches: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: conv_id, leaf, branch_score, formatted, loss_spans array<struct<start,end>>; all paths if ``branches`` is None."""
    first = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    messages = materialize(messages.groupBy("conv_id", "node").agg(first).select("conv_id", "node", "m.*"), "chat-messages")
    paths = reply_paths(messages)
    p, n = paths.alias("p"), messages.select("conv_id", "node", "score").alias("n")
    same = lambda b: F.col("p.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & F.col("p.node").eqNullSafe(F.col(f"{b}.node"))
    scores = p.join(n, same("n")).groupBy("p.conv_id", "p.leaf").agg(F.sum(F.coalesce("n.score", F.lit(0.0))).alias("branch_score"))
    if branches is not None:
        rank = Window.partitionBy("conv_id").orderBy(F.col("branch_score").desc(), "leaf")
        scores = scores.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= branches).drop("rank")
    c = materialize(scores, "chat-branches").alias("c")
    chosen = p.join(c, F.col("p.conv_id").eqNullSafe(F.col("c.conv_id")) & F.col("p.leaf").eqNullSafe(F.col("c.leaf"))).select("p.*", "c.branch_score").alias("p")
    full = chosen.join(messages.alias("m"), same("m")).select("p.conv_id", "p.leaf", "p.branch_score", "p.dist", "m.role", "m.text")
    turn = F.struct((-F.col("dist")).alias("depth"), "role", "text")
    return _render(full.groupBy("conv_id", "leaf", "branch_score").agg(F.collect_list(turn).alias("turns")), loss_role)


def _render(paths: DataFrame, loss_role: str) -> DataFrame:
    head = lambda t: F.concat(F.lit("<turn "), escape_role(F.coalesce(t["role"], F.lit(""))), F.lit(">\n"))
    body = lambda t: escape(F.coalesce(t["text"], F.lit("")))
    parts = paths.withColumn("turns", F.array_sort("turns")).withColumn("parts", F.transform("turns", lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), (t["role"] == loss_role).alias("loss"))))
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, t: F.struct(
            (acc["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + F.lit(len("</turn>\n"))).alias("at"),
            F.when(t["loss"], F.concat(acc["out"], F.array(F.struct((acc["at"] + F.char_length(t["head"])).alias("start"), (acc["at"] + F.char_length(t["head"]) + F.char_length(t["body"])).alias("end"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return parts.select("conv_id", "leaf", "branch_score", F.array_join(F.transform("parts", lambda t: F.concat(t["head"], t["body"], F.lit("</turn>\n"))), "").alias("formatted"), spans.alias("loss_spans"))


def parse_chats(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back: array<struct<role,text>>."""
    turns = F.filter(F.split(formatted, "</turn>\n", -1), lambda x: x != "")
    return F.transform(turns, lambda x: F.struct(unescape(F.regexp_extract(x, r"(?s)^<turn ([^>]*)>\n", 1)).alias("role"), unescape(F.regexp_extract(x, r"(?s)^<turn [^>]*>\n(.*)$", 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
