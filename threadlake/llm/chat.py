"""Chat formatting over reply trees.

Messages are nodes that point to their parent. Pointer doubling, a self-join per round over the nodes that have not come to their root yet, gives every node its
root, depth and score sum, so that a path of n messages takes log2(n) rounds. Branches (leaves) are ranked by score within their root, and only the chosen paths
are then enumerated, by the ancestors at distances of powers of two that the rounds have found, and formatted as one conversation each. Trees that are paths
need neither.

Template: ``<|role|>`` and a line end before each text, ``<|end|>`` and a line end after it. Inside roles and texts a backslash is doubled and each
control string gets a backslash after its first character, so that no text can end a turn, and unescaping gives the text back.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.session import Scratch

CONTROL = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]")
END = "<|end|>\n"
_CONTROL = re.compile("|".join(map(re.escape, (*CONTROL, "\\"))))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """Undo ``escape``: a doubled backslash is one, a single one goes."""
    return re.sub(r"\\(\\?)", lambda m: m[1], text)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the spans of the texts that the loss is taken over."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{escape(role).replace(chr(10), chr(92) + 'n')}|>\n", escape(text)
        if role == learn:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def _role(text: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"\\": "\\", "n": "\n"}.get(m[1], ""), text)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        close = formatted.index("|>\n", at)
        end = formatted.index(END, close)
        turns.append((_role(formatted[at + 2 : close]), unescape(formatted[close + 3 : end])))
        at = end + len(END)
    return turns


def _doubled(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Levels of pointer doubling over (id, parent, score). Level n has (id, anc, depth, total) of all nodes at least 2**(n - 1) deep: ``anc`` is ``depth`` steps up, at most 2**n.

    Whoever comes less far up than 2**n stands at its root and is done: it is in no later level. ``total`` is summed from the node to its root, or
    to just below ``anc`` if the node isn't done. What is on or below a cycle is never done; when a level's step is no shorter than all nodes in a row, only such nodes are left.
    """
    far = nodes.select("id", F.coalesce("parent", "id").alias("anc"), F.col("parent").isNotNull().cast("long").alias("depth"), F.col("score").alias("total"))
    levels = [scratch.table(far, "level-0")]
    count = levels[0].count()
    for n in range(60):
        going = levels[n].where(F.col("depth") == 2**n)
        if 2**n >= count or going.isEmpty():
            break
        known = functools.reduce(DataFrame.unionByName, [done(level, k) for k, level in enumerate(levels)], going)
        known = known.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        levels.append(scratch.table(going.join(known, "anc").select("id", F.col("anc2").alias("anc"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total")), f"level-{n + 1}"))
    return levels


def done(level: DataFrame, n: int) -> DataFrame:
    """The nodes of level ``n`` whose ``anc`` is their root."""
    return level.where(F.col("depth") < 2**n)


def best_paths(nodes: DataFrame, branches: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """(root, branch, depth, id) of the ``branches`` best root-to-leaf paths of each tree of ``nodes`` (id, parent, score).

    ``parent`` is null at roots, a null score is 0. A branch's score is the sum over its path; ties go to the longer path, then the lesser leaf. Nodes
    without an id, below a parent that is no node, or on or below a cycle have no root and are on no path. Ids are to be unique.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "paths")
    nodes = scratch.table(nodes.where("id is not null").select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "nodes")
    levels = _doubled(nodes, scratch)
    known = functools.reduce(DataFrame.unionByName, [done(level, n) for n, level in enumerate(levels)]).withColumnRenamed("anc", "root")
    leaves = scratch.table(known.join(nodes.where("parent is not null").select(F.col("parent").alias("id")).distinct(), "id", "left_anti"), "leaves")
    # a tree with one leaf is a path: all its nodes, with nothing to rank and no round to go
    lone = scratch.table(leaves.groupBy("root").agg(F.count("*").alias("n")).where("n = 1").select("root"), "lone")
    whole = known.join(lone, "root").select("root", F.lit(1).alias("branch"), "id", "depth")
    rank = Window.partitionBy("root").orderBy(F.desc("total"), F.desc("depth"), "id")
    on = leaves.join(lone, "root", "left_anti").withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches).select("root", "branch", "id", "depth")
    # from each chosen leaf up: the steps of the levels' lengths reach every node of its path once
    on = scratch.table(on, "on-0")
    for n, level in enumerate([] if on.isEmpty() else levels):
        step = level.where(F.col("depth") == 2**n).select("id", F.col("anc").alias("to"))
        new = on.join(step, "id").select("root", "branch", F.col("to").alias("id"), (F.col("depth") - 2**n).alias("depth"))
        on = scratch.table(on.unionByName(new), f"on-{n + 1}")
        scratch.drop(f"on-{n}")
    out = scratch.table(on.unionByName(whole), "paths")
    scratch.drop("nodes", "leaves", "lone", *[f"level-{n}" for n in range(len(levels))], *[f"on-{n}" for n in range(len(levels) + 1)])
    return out


FORMATTED = "conv_id long, branch int, formatted string, mask array<struct<start:long,end:long>>"


def _format(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            text, mask = format_turns([(t["role"], t["text"]) for t in r["turns"]])
            out.append({"conv_id": r["conv_id"], "branch": r["branch"], "formatted": text, "mask": [{"start": a, "end": b} for a, b in mask]})
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("branch", pa.int32()), ("formatted", pa.string()), ("mask", pa.list_(span))]))


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """One formatted conversation per chosen path. ``messages``: conv_id, id, parent (null at a root), role, text, score.

    Null roles and texts are empty, a null score is 0. Rows that repeat an id are one message: the one with the greatest score, then the least conv_id, parent (null first), role and
    text. Messages without an id, below a parent that is no message, or on or below a cycle have no root and are in no conversation. Trees of
    one conversation are formatted apart, each as its root's conv_id says. An empty table gives an empty result.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    first = F.struct((-F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("low"), "conv_id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = messages.where("id is not null").groupBy("id").agg(F.min(first).alias("m"))
    kept = scratch.table(kept.select("m.conv_id", "id", "m.parent", "m.role", "m.text", (-F.col("m.low")).alias("score")), "messages")
    paths = best_paths(kept, branches, scratch)
    turns = paths.join(kept.select("id", "conv_id", "role", "text"), "id").groupBy("root", "branch").agg(F.min_by("conv_id", "depth").alias("conv_id"), F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    return turns.select("conv_id", "branch", "turns").mapInArrow(_format, FORMATTED)


def chains(conversations: DataFrame) -> DataFrame:
    """Messages of a table (conv_id, turn, role, text): each turn replies to the one before it, and longer assistant replies score more.

    Rows of a conversation are ordered by turn; repeated turns by role, then text. Null conversation ids form one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order).cast("long"))
    key = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), n.cast("string"))
    return rows.select("conv_id", key(F.col("n")).alias("id"), F.when(F.col("n") > 1, key(F.col("n") - 1)).alias("parent"), "role", "text", F.when(F.col("role") == "assistant", F.length(F.coalesce("text", F.lit("")))).otherwise(0).cast("double").alias("score"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            text = r["formatted"]
            turns = parse_turns(text)
            loss = "".join(unescape(text[m["start"] : m["end"]]) for m in r["mask"])
            out.append((r["conv_id"], len(turns), sha("".join(f"{role}\n{said}\n" for role, said in turns)), len(loss), sha(loss), len(text)))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])


def digests(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation reads back as."""
    return formatted.select("conv_id", "formatted", "mask").mapInArrow(_digest, DIGEST)
