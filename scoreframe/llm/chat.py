"""Chat formatting of reply trees: enumerate paths, rank branches, format, read back.

A forest of messages names each message's parent. Iterative self-joins double
the reach of every step: after round ``k`` a leaf knows its first ``2**k``
ancestors, so a path of ``n`` messages takes ``log2(n)`` rounds and every
(leaf, ancestor) pair is made once. Branches of a tree are ranked by score, and
each chosen path becomes one conversation.

Template, one turn after another::

    ### role: text</turn>\\n

Inside roles and texts a backslash is doubled and a backslash is put into
``##``, ``</`` and, in roles, ``: `` (colon, blank), so the control strings
``###``, ``</turn>`` and the end of a role occur as marks only; dropping each
backslash before the character that it protects gives the text back.

The loss mask is a list of [start, end) code points over the assistant's texts.

Null roles and texts are empty. Rows without a conversation id make one
conversation without id. Ties in the order are broken by role and text, and
repeated rows are turns of their own. Messages whose parent is missing are
roots. A cycle has no root and no leaf and yields nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.scale import fits
from .base import saved

# The marks of the template.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, "#(?=#)", r"#\\")
    return F.regexp_replace(out, "<(?=/)", r"<\\")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), ":(?= )", r":\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


# --- trees ----------------------------------------------------------------------


def chains(rows: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages of linear conversations as trees: every turn answers the one before."""
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    by_turn = Window.partitionBy("tree").orderBy(F.col(order).asc_nulls_first(), "role", "text")
    numbered = rows.select(
        name.alias("tree"), F.col(key).alias("name"), F.col(order), role.alias("role"),
        text.alias("text"),
    ).withColumn("node", F.row_number().over(by_turn).cast("long"))
    return numbered.select(
        "tree", "name", "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role", "text", F.length("text").cast("double").alias("score"),
    )


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every leaf with itself and all its ancestors.

    ``up`` is the number of steps from the leaf.
    """
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = saved(nodes.join(known, ["tree", "parent"]).select("tree", "node", "parent"), "chat-jump")
    leaves = nodes.join(
        jump.select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti"
    )
    reach = saved(
        leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")),
        "chat-paths",
    )
    step, tallest = 1, messages.count()
    while step <= tallest and not jump.isEmpty():
        # From the part that the last rounds reached to twice as far.
        further = reach.join(jump, ["tree", "node"]).select(
            "tree", "leaf", F.col("parent").alias("node"), (F.col("up") + step).alias("up")
        )
        reach = saved(reach.unionByName(further), "chat-paths")
        next_ = jump.select("tree", F.col("node").alias("parent"), F.col("parent").alias("top"))
        jump = saved(
            jump.join(next_, ["tree", "parent"]).select("tree", "node", F.col("top").alias("parent")),
            "chat-jump",
        )
        step *= 2
    return reach


def choose(reach: DataFrame, messages: DataFrame, branches: int) -> DataFrame:
    """(tree, leaf, rank): the best branches of each tree, by mean score of their
    messages, then length, then leaf."""
    scored = reach.join(messages.select("tree", "node", "score"), ["tree", "node"])
    total = scored.groupBy("tree", "leaf").agg(
        F.avg("score").alias("score"), F.count("*").alias("turns")
    )
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("turns"), "leaf")
    return (
        total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
        .select("tree", "leaf", "rank")
    )


# --- format ---------------------------------------------------------------------


def format_paths(
    messages: DataFrame, branches: int = 1, learned: str = ASSISTANT
) -> DataFrame:
    """(name, leaf, rank, formatted, loss_spans): one row per chosen path.

    ``messages``: tree, name, node, parent, role, text, score.
    """
    reach = paths(messages)
    chosen = choose(reach, messages, branches)
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(AFTER_ROLE))
    places = saved(reach.join(chosen, ["tree", "leaf"]), "chat-places")
    # The texts stay where they are while the places are few.
    known = F.broadcast(places) if fits(places) else places
    turns = (
        messages.select("tree", "node", "name", "role", "text").join(known, ["tree", "node"])
        .select("tree", "name", "leaf", "rank", "up", head.alias("head"),
                escape(F.col("text")).alias("body"), (F.col("role") == learned).alias("learn"))
    )
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = F.concat("head", "body", F.lit(CLOSE))
    start = F.coalesce(F.sum(F.length("whole")).over(before), F.lit(0)) + F.length("head")
    placed = turns.withColumn("whole", whole).withColumn("start", start)
    span = F.struct(F.col("start"), (F.col("start") + F.length("body")).alias("end"))
    joined = placed.groupBy("tree", "leaf").agg(
        F.first("name").alias("name"), F.first("rank").alias("rank"),
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "whole"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("learn"), span))).alias("loss_spans"),
    )
    text = F.concat_ws("", F.transform("turns", lambda t: t["whole"]))
    return joined.select("name", "leaf", "rank", text.alias("formatted"), "loss_spans")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, body = part[len(OPEN):].partition(AFTER_ROLE)
        out.append((unescape(role), unescape(body)))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each formatted conversation, from its text and its loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted"), batch.column("loss_spans")):
                text = text.as_py()
                turns, learned = parse(text), hashlib.sha256()
                whole = hashlib.sha256()
                for role, body in turns:
                    whole.update(f"{role}\n{body}\n".encode())
                chars = 0
                for span in spans.as_py():
                    plain = unescape(text[span["start"] : span["end"]])
                    chars += len(plain)
                    learned.update(plain.encode())
                rows.append((len(turns), whole.hexdigest(), chars, learned.hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            yield pa.RecordBatch.from_arrays(
                [batch.column("name")]
                + [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                ["name", *names],
            )

    return formatted.select("name", "formatted", "loss_spans").mapInArrow(
        run,
        "name long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long",
    )
