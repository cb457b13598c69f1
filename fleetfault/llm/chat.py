"""Reply trees to training conversations, in DataFrame functions only.

A tree's messages name their parent.  Iterative self-joins double the reach of every
message (parent, grandparent, ...), so a path of n messages takes log2(n) joins and gives
each leaf its root, depth and score.  Branches are ranked by the mean score of their
messages; only the chosen ones are expanded, by the same tables from the longest reach
down, and each is formatted as one conversation.

Template: an assistant's turn is ``<s>text</s>``, any other ``[INST]role\\ntext[/INST]``,
with the role URL-encoded.  Control strings inside texts get a ``~`` after their first
character, after any number of ``~`` that are there, so escaping is undone exactly and no
text can close its turn.  The loss mask covers what stands between ``<s>`` and ``</s>``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetfault.operators.ordering import ordered_text, top_rows, with_position
from fleetfault.session import materialize

ASSISTANT = "assistant"
_CONTROL = r"(~*/?(?:s>|INST\]))"
_TURN = r"(?s)<s>.*?</s>|\[INST\].*?\[/INST\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]){_CONTROL}", "$1~$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])~{_CONTROL}", "$1$2")


def marked(role: Column, text: Column) -> Column:
    """One turn in the template; a null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), escape(F.coalesce(text, F.lit("")))
    other = F.concat(F.lit("[INST]"), F.url_encode(role), F.lit("\n"), text, F.lit("[/INST]"))
    return F.when(role == ASSISTANT, F.concat(F.lit("<s>"), text, F.lit("</s>"))).otherwise(other)


def turns_of(formatted: Column) -> Column:
    """Read a formatted conversation back: ``array<struct<role, text, loss>>``, unescaped."""

    def turn(part: Column) -> Column:
        loss = part.startswith("<s>")
        body = F.substring(part, F.lit(7), F.length(part) - 13)
        head = F.substring_index(body, "\n", 1)
        text = F.when(loss, F.substring(part, F.lit(4), F.length(part) - 7)).otherwise(
            F.substring(body, F.length(head) + 2, F.length(body))
        )
        return F.struct(
            F.when(loss, F.lit(ASSISTANT)).otherwise(F.url_decode(head)).alias("role"), unescape(text).alias("text"), loss.alias("loss")
        )

    return F.transform(F.regexp_extract_all(formatted, F.lit(f"({_TURN})"), F.lit(1)), turn)


def _reach(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of ``(tree, node, up, score, depth)``: table i has the messages with an ancestor
    2**i messages up, and sums score and number of the messages from there down.  And one table
    of all messages that end at a root, with sums over their whole path."""
    tables, ended = [], []
    current = materialize(nodes.select("tree", "node", F.col("parent").alias("up"), "score", F.lit(1).cast("long").alias("depth")))
    # A path longer than the table is a cycle and never ends.
    for _ in range(math.ceil(math.log2(current.count() + 1)) + 1):
        active = current.where("up is not null")
        tables.append(active)
        ended.append(current.where("up is null").select("tree", "node", "score", "depth"))
        if active.isEmpty():
            break
        all_ended = reduce(DataFrame.unionByName, ended)
        reached = active.unionByName(all_ended.withColumn("up", F.lit(None).cast("long"))).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("s2"), F.col("depth").alias("d2"))
        # Only messages that have not reached their root are joined again.
        current = materialize(
            active.join(reached, ["tree", "up"]).select(
                "tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("s2")).alias("score"), (F.col("depth") + F.col("d2")).alias("depth")
            )
        )
    return tables, reduce(DataFrame.unionByName, ended)


def best_branches(nodes: DataFrame, k: int = 1) -> DataFrame:
    """``(tree, leaf, branch_score, place, node)``: the messages of the ``k`` best branches of each tree.

    ``nodes``: ``(tree, node, parent, score)``, a node once per tree, score double.  A parent
    that is not in the tree counts as none; null scores as 0; ties go to the lowest leaf.
    Messages on or below a cycle of parents belong to no branch.
    """
    known = nodes.select("tree", F.col("node").alias("parent"))
    roots = nodes.join(known.withColumn("there", F.lit(True)), ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")
    )
    roots = materialize(roots)
    tables, ended = _reach(roots)
    leaves = ended.join(
        roots.where("parent is not null").select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti"
    )
    scored = leaves.select("tree", F.col("node").alias("leaf"), (F.col("score") / F.col("depth")).alias("branch_score"), "depth")
    members = top_rows(scored, ["tree"], [F.col("branch_score").desc(), F.col("leaf")], k).select(
        "tree", "leaf", "branch_score", F.col("leaf").alias("node"), (F.col("depth") - 1).alias("place")
    )
    for power in range(len(tables) - 1, -1, -1):
        here, there = F.struct("node", "place"), F.struct(F.col("up").alias("node"), (F.col("place") - 2**power).alias("place"))
        members = (
            members.join(tables[power].select("tree", "node", "up"), ["tree", "node"], "left")
            .select("tree", "leaf", "branch_score", F.explode(F.when(F.col("up").isNotNull(), F.array(here, there)).otherwise(F.array(here))).alias("m"))
            .select("tree", "leaf", "branch_score", "m.*")
        )
    return members


def format_trees(nodes: DataFrame, k: int = 1) -> DataFrame:
    """``(tree, leaf, branch_score, formatted)``: each chosen branch as one conversation.

    ``nodes``: ``(tree, node, parent, score, role, text)`` with non-null ``tree`` and ``node``.
    """
    said = nodes.select("tree", "node", marked(F.col("role"), F.col("text")).alias("turn"))
    turns = best_branches(nodes.select("tree", "node", "parent", "score"), k).join(said, ["tree", "node"])
    return ordered_text(turns, ["tree", "leaf", "branch_score"], "place", "turn", "formatted", sep="")


def chains(conversations: DataFrame) -> DataFrame:
    """Nodes of plain conversations ``(conv_id, turn, role, text)``: each turn answers the one before.

    Turns are put in order by ``turn`` (null first), then role and text, so ties and repeated
    rows are turns of their own; a null ``conv_id`` is a conversation like others.
    """
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "turn", "role", "text")
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    placed = with_position(rows, ["tree"], order, "node")
    return placed.select(
        "tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )
