"""Conversations as a forest of shared turns.

A conversation is formatted turn by turn. Conversations with the same initial
turns share the nodes of a prefix tree, each a run of turns in which no
conversation ends or parts from the others; the packed sequence has each node's
characters once, depth first. Every node carries the position of its first
character in its conversations (``position``) and the intervals of the packed
sequence that its characters may attend to: those of its ancestors, beside its
own up to each character.

A node is named by the digest of all turns up to its end, and its path has the
digest at the first turn of each node down to it. Sorted by path, the distinct
nodes stand in depth first order, so a prefix sum of their lengths gives their
places: a range sort, a running sum per partition, and a sum per partition for
the driver. However many conversations share a turn, it is one row, and no task
holds a tree. A node that ends where a conversation ends is no deeper than that
conversation is long, and for each that ends in a fork there is a conversation
of its own that goes on: paths and intervals together are no longer than twice
the input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from engrama.llm.hashing import thrifty
from engrama.llm.shared import drop, stash

#: The strings that the template gives a meaning.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|none|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left in the result; ``unescape`` undoes it.

    Backslashes are doubled, and each control string gets one behind its first
    character.
    """
    return _CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


#: What stands before and after a turn's text, by role.
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": ("<|text|>", "</s>"), "system": ("<<SYS>> ", " <</SYS>>")}


def format_turn(role: str | None, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text stands in it."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = "<|role|>" + ("<|none|>" if role is None else escape(role)) + "<|text|>", "</s>"
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


_TURN = re.compile(
    "|".join(
        [rf"(?P<{role}>{re.escape(a)}(?P<{role}_text>.*?){re.escape(b)})" for role, (a, b) in MARKS.items()]
        + [r"(?P<other><\|role\|>(?P<name><\|none\|>|.*?)<\|text\|>(?P<other_text>.*?)</s>)"]
    ),
    re.DOTALL,
)


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """Roles and texts of a formatted conversation: the inverse of formatting."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = next((r for r in MARKS if m[r] is not None), None)
        if role:
            out.append((role, unescape(m[f"{role}_text"])))
        else:
            out.append((None if m["name"] == "<|none|>" else unescape(m["name"]), unescape(m["other_text"])))
        at = m.end()
    return out


def prefix_digests(turns: list[dict]) -> list[bytes]:
    """A digest of each initial run of turns: that of the run before it, the role and the text."""
    out, last = [], b""
    for t in turns:
        role = b"\x00" if t["role"] is None else b"\x01" + t["role"].encode()
        last = hashlib.blake2b(last + len(role).to_bytes(8, "big") + role + (t["text"] or "").encode(), digest_size=16).digest()
        out.append(last)
    return out


def _with_digests(kind: pa.DataType) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = pa.array([prefix_digests(t) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), batch.column(1), digests], names=["conv_id", "turns", "prefixes"])

    return rows


def conversations(rows: DataFrame) -> DataFrame:
    """Rows of turns as ``conv_id``, ``turns`` (in order) and ``prefixes``, a digest of each initial run of turns.

    Turns are ordered by ``turn``, nulls first; ties and repeated rows by role
    and text, all kept. A null text counts as empty. Rows without ``conv_id``
    are one conversation.
    """
    turn = F.struct(rows["turn"].alias("turn"), rows["role"].alias("role"), F.coalesce(rows["text"], F.lit("")).alias("text"))
    whole = rows.select(rows["conv_id"].alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    slim = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    kind = rows.schema["conv_id"].dataType
    return slim.mapInArrow(thrifty(_with_digests(to_arrow_type(kind))), f"conv_id {kind.simpleString()}, turns array<struct<role:string,text:string>>, prefixes array<binary>")


def ends(convs: DataFrame) -> DataFrame:
    """``conv_id``, ``ends``: after which of its turns (from 0) a node ends, because some conversation does or several go on differently.

    Per initial run of turns two digests and a flag are kept, combined before they are shuffled.
    """
    steps = convs.select("conv_id", F.posexplode(F.arrays_zip("prefixes", F.slice("prefixes", F.lit(2), F.size("prefixes")).alias("following"))).alias("at", "z")).select("conv_id", "at", F.col("z.prefixes").alias("prefix"), F.col("z.following").alias("following"))
    told = steps.groupBy("prefix").agg(F.min("following").alias("a"), F.max("following").alias("b"), F.bool_or(F.col("following").isNull()).alias("last")).filter("last or a != b").select("prefix")
    return steps.select("conv_id", "at", "prefix").join(told, "prefix").groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("ends"))


_NODE = "last boolean, node binary, path binary, above array<binary>, text string, position long, turns array<bigint>, losses array<struct<start:bigint,`end`:bigint>>"


def _node_rows(kind: pa.DataType) -> Callable:
    """(conv_id, turns, prefixes, ends) to a row per node; turns and losses are counted from its first character."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("conv_id", kind), ("last", pa.bool_()), ("node", pa.binary()), ("path", pa.binary()), ("above", pa.list_(pa.binary())), ("text", pa.string()), ("position", pa.int64()), ("turns", pa.list_(pa.int64())), ("losses", pa.list_(span))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, turns, prefixes, ends in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                path, above, position, first = b"", [], 0, 0
                for end in ends:
                    path += prefixes[first]
                    text, starts, losses = "", [], []
                    for turn in turns[first : end + 1]:
                        formatted, a, b = format_turn(turn["role"], turn["text"])
                        starts.append(len(text))
                        if turn["role"] == "assistant":
                            losses.append({"start": len(text) + a, "end": len(text) + b})
                        text += formatted
                    out.append((conv, end + 1 == len(turns), prefixes[end], path, list(above), text, position, starts, losses))
                    above.append(prefixes[end])
                    position, first = position + len(text), end + 1
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return rows


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, length) to where each node begins in its partition."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        lengths = batch.column("length").to_pylist()
        starts = []
        for n in lengths:
            starts.append(at)
            at += n
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("length"), pa.array([part] * len(starts), pa.int32()), pa.array(starts, pa.int64())], names=["node", "length", "part", "start"])


def placed(nodes: DataFrame) -> DataFrame:
    """``node``, ``start``, ``end`` of distinct nodes (node, path, length) in the packed sequence.

    The driver gets one sum per partition.
    """
    local = stash(nodes.select("path", "node", "length").repartitionByRange("path").sortWithinPartitions("path").select("node", "length").mapInArrow(_running, "node binary, length long, part int, start long"))
    sums = local.groupBy("part").agg(F.sum("length").alias("n")).collect()
    before, at = [], 0
    for r in sorted(sums, key=lambda r: r["part"]):
        before.append((r["part"], at))
        at += r["n"]
    first = local.sparkSession.createDataFrame(before, "part int, before long")
    start = F.col("start") + F.col("before")
    return local.join(F.broadcast(first), "part").select("node", start.alias("start"), (start + F.col("length")).alias("end"))


def pack(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the packed forest, and the leaf of each conversation.

    Nodes: ``start``, ``end`` (places of its characters in the packed sequence),
    ``text`` (those characters), ``position`` (position id of the first),
    ``turns`` (where its turns begin), ``attends`` (intervals of its ancestors,
    root first) and ``losses`` (intervals of assistants' texts). Character i of
    a node has position id ``position + i`` and attends to ``attends`` and to
    its own node up to itself. Sorted by ``start`` the texts make up the
    sequence. Leaves: ``conv_id``, ``start`` of the node in which it ends.

    Equal turns after equal turns are there once, in repeated conversations
    too. Very long texts and conversations stay whole, a conversation in one
    task. An empty table gives no nodes and no leaves.
    """
    convs = stash(conversations(rows))
    kind = convs.schema["conv_id"].dataType
    cuts = ends(convs).withColumnRenamed("conv_id", "__of")
    cut = convs.join(cuts, F.col("conv_id").eqNullSafe(F.col("__of"))).select("conv_id", "turns", "prefixes", "ends")
    held = stash(cut.mapInArrow(thrifty(_node_rows(to_arrow_type(kind))), f"conv_id {kind.simpleString()}, {_NODE}"))
    nodes = stash(held.dropDuplicates(["node"]).drop("conv_id", "last"))
    places = stash(placed(nodes.withColumn("length", F.length("text").cast("long"))))
    above = nodes.select(F.col("node").alias("of"), F.explode("above").alias("node"))
    spans = above.join(places, "node").groupBy("of").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("attends"))
    whole = nodes.join(places, "node").join(spans.withColumnRenamed("of", "node"), "node", "left")
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    losses = F.transform("losses", lambda x: F.struct((F.col("start") + x["start"]).alias("start"), (F.col("start") + x["end"]).alias("end")))
    turns = F.transform("turns", lambda x: F.col("start") + x)
    forest = stash(whole.select("start", "end", "text", "position", turns.alias("turns"), F.coalesce("attends", empty).alias("attends"), losses.alias("losses")))
    leaves = stash(held.filter("last").select("conv_id", "node").join(places, "node").select("conv_id", "start"))
    drop(convs, held, nodes, places)
    return forest, leaves


def read_back(nodes: list[dict]) -> tuple[str, str]:
    """A conversation's formatted text, and the text under its loss mask, from the nodes on its path."""
    path = sorted(nodes, key=lambda n: n["position"])
    loss = "".join(unescape(n["text"][x["start"] - n["start"] : x["end"] - n["start"]]) for n in path for x in n["losses"])
    return "".join(n["text"] for n in path), loss


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for nodes in batch.column(1).to_pylist():
            formatted, loss = read_back(nodes)
            turns = parse(formatted)
            listed = "".join(f"{role or ''}\n{text}\n" for role, text in turns)
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            out["formatted_chars"].append(len(formatted))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], names=["conv_id", *out])


def digests(forest: DataFrame, leaves: DataFrame) -> DataFrame:
    """Per conversation, read back from ``pack``'s tables: ``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    The intervals of the leaf and its own name the nodes; their positions give
    the order. A null role counts as an empty one in ``turns_sha256``.
    """
    own = forest.select("start", F.concat(F.col("attends.start"), F.array("start")).alias("path"))
    wanted = leaves.join(own, "start").select("conv_id", F.explode("path").alias("start"))
    held = wanted.join(forest.select("start", "text", "position", "losses"), "start").groupBy("conv_id").agg(F.collect_list(F.struct("start", "text", "position", "losses")).alias("nodes"))
    kind = leaves.schema["conv_id"].dataType.simpleString()
    return held.mapInArrow(thrifty(_digest_rows), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
