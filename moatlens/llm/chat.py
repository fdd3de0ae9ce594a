"""Chat formatting of reply trees.

Messages (conversation, message, parent, score) form trees. Iterative
self-joins double the reach of every message's ancestor link, so a path of n
messages takes log2(n) joins; branches (root to leaf) are ranked by the summed
score and each chosen branch is formatted as one conversation.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` per turn. Control strings
inside roles and texts are escaped reversibly: ``<``, any number of
backslashes, ``|`` gains one backslash, so ``<|`` never occurs inside a field;
a line feed in a role becomes ``<|nl|>`` after that.

Defined cases: a null role or text is empty, a null score 0; a parent that is
not in its conversation makes a root; messages that reach no root (a cycle)
are on no path; equal scores go to the smaller leaf; of rows that repeat a
message id the first by (role, text) counts; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moatlens.llm.common import written

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def thread(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows ordered by turn as a tree in which each message answers the one before it."""
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    n = F.row_number().over(order).cast("long")
    return turns.select(F.col(conv).cast("long").alias("conv_id"), n.alias("msg_id"),
                        F.when(n > 1, n - 1).alias("parent_id"), F.lit(0.0).alias("score"),
                        F.col(role).alias("role"), F.col(text).alias("text"))


def _links(messages: DataFrame) -> DataFrame:
    m = messages.select("conv_id", "msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    up = m.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("p"))
    j = m.join(up, m.conv_id.eqNullSafe(F.col("c")) & (m.parent_id == F.col("p")), "left")
    return j.select("conv_id", F.col("msg_id").alias("node"), F.col("p").alias("anc"), F.lit(1).cast("long").alias("dist"), F.col("score").alias("gain"))


def branches(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """(conv_id, leaf_id, msg_id, depth, branch_score) for the ``keep`` best branches (None: all) of each conversation.

    Doubling: link k of a message leads 2**k messages up, or past the root
    (null). The number of rounds follows from the largest conversation.
    """
    links = _links(messages)
    most = messages.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 1
    rounds = max(1, int(most - 1).bit_length())
    links = written(links, "chat-links")
    jump, ended = [links.where("anc is not null")], links.where("anc is null")
    for _ in range(rounds):
        # only messages whose link is not past the root yet are joined again
        a, b = jump[-1].alias("a"), jump[-1].unionByName(ended).alias("b")
        j = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.anc") == F.col("b.node")))
        links = written(j.select("a.conv_id", "a.node", F.col("b.anc").alias("anc"), (F.col("a.dist") + F.col("b.dist")).alias("dist"),
                                 (F.col("a.gain") + F.col("b.gain")).alias("gain")), "chat-links")
        jump.append(links.where("anc is not null"))
        ended = ended.unionByName(links.where("anc is null"))
    leaves = messages.select("conv_id", "msg_id").join(
        messages.where("parent_id is not null").select(F.col("conv_id").alias("c"), F.col("parent_id").alias("p")).distinct(),
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg_id") == F.col("p")), "left_anti")
    # messages in or below a cycle never end
    ends = ended.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "dist", "gain")
    best = leaves.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg_id") == F.col("n"))).select(
        "conv_id", F.col("msg_id").alias("leaf_id"), F.col("dist").alias("length"), F.col("gain").alias("branch_score"))
    if keep is not None:
        rank = Window.partitionBy("conv_id").orderBy(F.desc("branch_score"), "leaf_id")
        best = best.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= keep).drop("r")
    paths = best.select("conv_id", "leaf_id", "branch_score", "length", F.col("leaf_id").alias("msg_id"), F.lit(0).cast("long").alias("up"))
    for k in range(rounds, -1, -1):
        link = jump[k].select(F.col("conv_id").alias("c"), "node", "anc")
        j = paths.join(link, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg_id") == F.col("node")))
        more = j.select("conv_id", "leaf_id", "branch_score", "length", F.col("anc").alias("msg_id"), (F.col("up") + (1 << k)).alias("up"))
        paths = written(paths.unionByName(more), "chat-paths")
    return paths.select("conv_id", "leaf_id", "msg_id", (F.col("length") - F.col("up") - 1).alias("depth"), "branch_score")


def formatted(messages: DataFrame, keep: int | None = 1, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, leaf_id, branch_score, n_turns, segments, formatted) per chosen branch.

    ``segments`` cuts the conversation where the loss mask changes: (text,
    loss); ``formatted`` is their texts, joined.
    """
    first = Window.partitionBy("conv_id", "msg_id").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first(), "parent_id")
    msgs = written(messages.select("conv_id", "msg_id", "parent_id", "score", "role", "text")
                   .withColumn("r", F.row_number().over(first)).where("r = 1").drop("r"), "chat-messages")
    path = branches(msgs, keep)
    texts = msgs.select(F.col("conv_id").alias("c"), F.col("msg_id").alias("m"), "role", "text")
    j = path.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("msg_id") == F.col("m")))
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    turn = F.struct("depth", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"), (role == loss_role).alias("loss"))
    g = j.select("conv_id", "leaf_id", "branch_score", turn.alias("turn")).groupBy("conv_id", "leaf_id", "branch_score").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"))
    no = F.lit(False)
    cut = lambda t: F.array(F.struct(t["head"].alias("text"), no.alias("loss")),
                            F.struct(t["body"].alias("text"), t["loss"].alias("loss")),
                            F.struct(F.lit(END + "\n").alias("text"), no.alias("loss")))
    g = g.select("conv_id", "leaf_id", "branch_score", F.size("turns").cast("long").alias("n_turns"),
                 F.flatten(F.transform("turns", cut)).alias("segments"))
    return g.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parsed(conversation: Column) -> Column:
    """A formatted conversation back as an array of (role, text)."""
    tail = F.length(F.lit(END + "\n"))
    parts = F.slice(F.split(conversation, r"<\|im_start\|>"), 2, 2_000_000_000)
    body = F.transform(parts, lambda p: F.left(p, F.length(p) - tail))
    return F.transform(body, lambda b: F.struct(
        unescape(F.replace(F.substring_index(b, "\n", 1), F.lit(LINE), F.lit("\n"))).alias("role"),
        unescape(F.substr(b, F.length(F.substring_index(b, "\n", 1)) + 2)).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
