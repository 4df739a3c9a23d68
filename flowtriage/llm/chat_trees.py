"""Chat formatting from reply trees.

Paths from roots to leaves are found by self-joins that double the distance
they cover, branches are ranked by score, and every chosen path is written as
one conversation with a loss mask over the assistant's turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtriage.llm.common import cut

ASSISTANT = "assistant"
BRANCHES = 1

_HEAD, _MIDDLE, _END = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    """Write backslashes and control strings so that none is left and each can be read back."""
    text = F.regexp_replace(text, r"\\", r"\\\\")
    text = F.regexp_replace(text, r"#(?=##)", r"\\h")
    return F.regexp_replace(text, r"<(?=/turn>)", r"\\l")


def escape_role(role: Column) -> Column:
    """A role may not hold the end of its own mark, either."""
    return F.regexp_replace(escape(role), ":", r"\\c")


_ESCAPES = {"\\": "\\", "h": "#", "l": "<", "c": ":"}


def unescape(text: str) -> str:
    return re.sub(r"\\([\\hlc])", lambda m: _ESCAPES[m[1]], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns = []
    for part in formatted.split(_END)[:-1]:
        role, _, text = part.removeprefix(_HEAD).partition(_MIDDLE)
        turns.append((unescape(role), unescape(text)))
    return turns


def paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths of ``nodes`` (node, parent): rows (leaf, node, up).

    ``up`` counts the steps from the leaf.  A parent that is no node makes a
    root.  Each round joins the paths with pointers to ancestors twice as far
    as in the round before, so a chain of n turns takes log2(n) rounds; both
    tables are checkpointed.  Leaves below a cycle have no root and no path.
    """
    ids = nodes.select("node")
    jump = cut(nodes.where("parent IS NOT NULL").join(ids.withColumnRenamed("node", "parent"), "parent").select("node", F.col("parent").alias("far")))
    roots = nodes.join(jump.select("node"), "node", "left_anti").select("node")
    parents = jump.select(F.col("far").alias("node")).distinct()
    found = cut(ids.join(parents, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).alias("up")))
    most, step = nodes.count(), 1
    while step <= most and not jump.isEmpty():
        further = found.join(jump, "node").select("leaf", F.col("far").alias("node"), (F.col("up") + step).alias("up"))
        found = cut(found.unionAll(further))
        other = jump.select(F.col("node").alias("far"), F.col("far").alias("farther"))
        jump = cut(jump.join(other, "far").select("node", F.col("farther").alias("far")))
        step *= 2
    rooted = found.join(roots, "node").select("leaf").distinct()
    return found.join(rooted, "leaf")


def format_trees(nodes: DataFrame, branches: int = BRANCHES) -> DataFrame:
    """Write the best ``branches`` paths of every reply tree as conversations.

    ``nodes`` has tree, node, parent, role, text, score; node ids (text) are
    unique over all trees.  A path's score is the sum over its nodes; ties go
    to the smaller leaf.  Null roles and texts are empty, null scores zero.
    Of rows with one node id the least stays.  A turn is written as
    ``### role: text</turn>`` and a line end.  Roles and texts are escaped
    (backslash, ``###``, ``</turn>``), so the marks are unambiguous and every
    turn can be read back.  One conversation is one cell, so it must fit one.

    Returns tree, leaf, branch (from 1), formatted, and loss_spans: start and
    end, in characters, of the assistant's escaped texts.
    """
    empty = F.lit("")
    unique = nodes.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct("tree", "parent", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"),
                       F.coalesce("score", F.lit(0.0)).alias("score"))).alias("n")
    ).select("node", "n.*")
    unique = cut(unique)
    found = paths(unique.select("node", "parent"))
    slim = unique.select("node", "tree", "score")
    scored = found.join(slim, "node").groupBy("leaf").agg(F.min("tree").alias("tree"), F.sum("score").alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    best = scored.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches)
    turns = found.join(best.select("leaf", "tree", "branch"), "leaf").join(unique.select("node", "role", "text"), "node")
    head = F.concat(F.lit(_HEAD), escape_role(F.col("role")), F.lit(_MIDDLE))
    pieces = turns.select(
        "leaf", "tree", "branch", (-F.col("up")).alias("at"), "role", head.alias("head"), escape(F.col("text")).alias("body")
    ).withColumn("size", F.length("head") + F.length("body") + len(_END))
    before = Window.partitionBy("leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head")
    placed = pieces.withColumn("start", start.cast("bigint"))
    piece = F.struct("at", F.concat("head", "body", F.lit(_END)).alias("piece"), "role", "start", (F.col("start") + F.length("body")).alias("end"))
    rows = placed.groupBy("leaf", "tree", "branch").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda p: p["role"] == ASSISTANT), lambda p: F.struct(p["start"], p["end"]))
    return rows.select(
        "tree", "leaf", "branch", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans")
    )


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees without branches.

    Every row answers the one before it in the order of turn, role and text,
    nulls first; equal turns and repeated rows all take part.  A null conv_id
    is one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("_row", F.row_number().over(order))
    name = lambda row: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("/"), row.cast("string"))
    row = F.col("_row")
    return numbered.select(
        F.col("conv_id").alias("tree"), name(row).alias("node"), F.when(row > 1, name(row - 1)).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"),
    )


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for tree, formatted, spans in zip(batch["tree"], batch["formatted"], batch["loss_spans"]):
            digest = hashlib.sha256()
            turns = parse(formatted)
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            rows.append((tree, len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and hashes."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select("tree", "formatted", "loss_spans").mapInPandas(_read_back, schema)
