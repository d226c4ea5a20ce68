"""Operator 12: chat texts from reply trees.

Messages name the message they answer. Iterative self-joins follow these links: in each round a message's link is joined with the link
of the message it leads to, so links double in length and a tree of depth d takes log2(d) rounds; on the way the scores of the
path are added up. Leaves are ranked by the score of their branch. The paths of the chosen leaves come from the same
tables of links, longest first, and each is formatted as one conversation, turn by turn from rows sorted by path, so a task
holds one conversation at a time. No column of texts takes part in the self-joins.

The template (FIXED marks below) escapes its own control strings inside texts by a backslash after their first character,
and backslashes by another, so `turns_of` gives back every role and text. The loss mask is the list of spans of assistants' texts.

Defined results: null text and null role are empty; a message whose parent is null or not in its tree starts a tree of its
own there, and competes with the others of that tree; messages in a circle have no root and are left out; of messages with
one name in a tree the first by (parent, role, text, score) is taken; null names are left out; a null score counts 0; a null tree is
a tree like others; ties of branches go to the smaller leaf; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import discard, stored, table

#: Marks before and after a turn's text, by role; other roles are named within marks.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
NAMED, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", NAMED, TEXT, END]
START = "<s>"

_TO_ESCAPE = re.compile("|".join(map(re.escape, ["\\", *CONTROLS])))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn(role: str, text: str) -> tuple[str, str, str]:
    """A turn in three parts: what stands before its text, the escaped text, what stands after it."""
    before, after = MARKS.get(role) or (NAMED + escape(role) + TEXT, END)
    return before, escape(text), after


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn."""
    at, out = len(START), []
    while at < len(formatted):
        role = next((r for r, (before, _) in MARKS.items() if before and formatted.startswith(before, at)), None)
        if role is None and formatted.startswith(NAMED, at):
            mid = formatted.index(TEXT, at)
            role, at, after = unescape(formatted[at + len(NAMED) : mid]), mid + len(TEXT), END
        else:
            role = role or "assistant"
            before, after = MARKS[role]
            at += len(before)
        end = formatted.index(after, at)
        out.append((role, unescape(formatted[at:end])))
        at = end + len(after)
    return out


def branches(messages: DataFrame, top: int = 1, tree: str = "tree", node: str = "node", parent: str = "parent", score: str = "score") -> DataFrame:
    """tree, leaf, branch_rank, branch_score, node, depth: the messages on each tree's `top` best root-to-leaf paths, depth from 0.

    messages: a row for each (tree, node)."""
    rows = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"))
    same = F.col("a.tree").eqNullSafe(F.col("b.tree"))
    names = rows.select("tree", F.col("node").alias("up"))
    a, b = rows.alias("a"), names.alias("b")
    links = a.join(b, same & (F.col("a.parent") == F.col("b.up")), "left").select("a.tree", "a.node", "b.up", F.col("a.score").alias("total"), F.lit(1).cast("long").alias("hops"))
    moving = stored(links, "links")
    # in a circle links never end: beyond the number of a tree's messages nothing else is left
    longest = moving.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    inner = moving.where(F.col("up").isNotNull()).select("tree", "up").distinct().alias("b")
    every, jumps, ended = [moving], [], moving.where(F.col("up").isNull())
    while True:  # jumps[k]: links over 2**k messages; those that end above the root are done and go no further
        moving = moving.where(F.col("up").isNotNull())
        jumps.append(moving)
        if 2 ** (len(jumps) - 1) >= longest or moving.isEmpty():
            break
        a, b = moving.alias("a"), moving.union(ended).alias("b")
        both = a.join(b, same & (F.col("a.up") == F.col("b.node")))
        moving = stored(both.select("a.tree", "a.node", "b.up", (F.col("a.total") + F.col("b.total")).alias("total"), (F.col("a.hops") + F.col("b.hops")).alias("hops")), "links")
        every.append(moving)
        ended = ended.union(moving.where(F.col("up").isNull()))
    leaves = ended.alias("a").join(inner, same & (F.col("a.node") == F.col("b.up")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    chosen = leaves.withColumn("branch_rank", rank).where(F.col("branch_rank") <= top)
    chosen = stored(chosen.select("tree", F.col("node").alias("leaf"), "branch_rank", F.col("total").alias("branch_score"), "node", (F.col("hops") - 1).alias("depth"), (F.col("hops") - 1).alias("_long")), "leaves")
    path = chosen.where("false")
    for k in reversed(range(len(jumps))):  # longest links first: every 2**k-th message of the paths over 2**k links, so a path costs twice its length
        a = path.union(chosen.where(F.col("_long").between(2**k, 2 ** (k + 1) - 1))).alias("a")
        b = jumps[k].select("tree", F.col("node").alias("_node"), "up").alias("b")
        both = F.array(F.struct(F.col("a.node").alias("node"), F.col("a.depth").alias("depth")), F.struct(F.col("b.up").alias("node"), (F.col("a.depth") - 2**k).alias("depth")))
        path = a.join(b, same & (F.col("a.node") == F.col("b._node")), "left").select("a.tree", "a.leaf", "a.branch_rank", "a.branch_score", F.inline(F.filter(both, lambda x: x["node"].isNotNull())), "a._long").select(*chosen.columns)
    out = stored(path.union(chosen.where("_long = 0")).drop("_long"), "paths")
    discard(*every, chosen)
    return out


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_NAMES = ["tree", "leaf", "branch_rank", "branch_score"]


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each path; rows come path by path, in the order of depth."""
    name, parts, spans, size, n = None, [], [], 0, 0
    for batch in batches:
        types = [batch.schema.field(c).type for c in _NAMES]

        def done() -> pa.RecordBatch:
            values = [*name, n, "".join(parts), spans]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [*types, pa.int64(), pa.string(), _LOSS], strict=True)], names=[*_NAMES, "n_turns", "formatted", "loss"])  # noqa: B023

        for *of, depth, role, text in zip(*(batch.column(c).to_pylist() for c in (*_NAMES, "depth", "role", "text")), strict=True):
            if depth == 0:
                if n:
                    yield done()
                name, parts, spans, size, n = of, [START], [], len(START), 0
            made = turn(role or "", text or "")
            if role == "assistant":
                spans.append({"start": size + len(made[0]), "end": size + len(made[0]) + len(made[1])})
            parts += made
            size += sum(map(len, made))
            n += 1
    if n:
        yield done()


def formatted(messages: DataFrame, top: int = 1, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str = "score") -> DataFrame:
    """tree, leaf, branch_rank, branch_score, n_turns, formatted, loss (spans of assistants' texts, in code points) for each chosen path."""
    whole = messages.where(F.col(node).isNotNull()).select(F.col(tree).alias("tree"), F.col(node).alias("node"), *(F.col(c).alias(n) for c, n in ((parent, "parent"), (role, "role"), (text, "text"), (score, "score"))))
    whole = whole.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")
    whole = stored(whole, "messages")
    paths = branches(whole, top)
    a, b = paths.alias("a"), whole.select("tree", "node", "role", "text").alias("b")
    rows = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.node") == F.col("b.node"))).select("a.*", "b.role", "b.text")
    rows = rows.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "depth").select(*_NAMES, "depth", "role", "text")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in _NAMES)
    return rows.mapInArrow(_formatted, f"{kinds}, n_turns long, formatted string, loss array<struct<start:long,end:long>>")


def replies(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as trees of one branch: each turn answers the one before; equal turns by role and text."""
    place = F.row_number().over(Window.partitionBy(conv).orderBy(order, role, text)).cast("long")
    rows = turns.select(F.col(conv).alias("tree"), place.alias("node"), F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.withColumns({"parent": F.when(F.col("node") > 1, F.col("node") - 1), "score": F.lit(0.0)})


_READ = pa.schema([("tree", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of what a formatted conversation holds, read from its text and its spans alone."""
    for batch in batches:
        rows = []
        for key, whole, spans in zip(*(batch.column(c).to_pylist() for c in ("tree", "formatted", "loss")), strict=True):
            turns = turns_of(whole)
            loss = [unescape(whole[s["start"] : s["end"]]) for s in spans]
            digest = lambda parts: reduce(lambda h, p: h.update(p.encode("utf-8", "surrogatepass")) or h, parts, hashlib.sha256()).hexdigest()
            rows.append((key, len(turns), digest(f"{r}\n{t}\n" for r, t in turns), sum(map(len, loss)), digest(loss), len(whole)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ.types, strict=True)] if rows else [pa.array([], t) for t in _READ.types], schema=_READ)


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    tried = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tried).alias("text"))
    out = formatted(replies(own.union(more))).select("tree", "formatted", "loss")
    return out.mapInArrow(read_back, "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("tree", "conv_id")


def op12_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    controls = "|".join(map(re.escape, ["\\", *CONTROLS]))
    added = f"len(regexp_extract_all({{}}, {quote(controls)}))"
    around = " ".join(f"WHEN role = {quote(r)} THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
sized AS (SELECT *, length(text) + {added.format('text')} + CASE {around} ELSE {len(NAMED + TEXT + END)} + length(role) + {added.format('role')} END AS size FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, (sum(size) + {len(START)})::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""
