"""Chat formatting on a prefix tree of conversations.

Conversations that share their first turns share a path in a tree whose
nodes are turns.  The tree is emitted depth-first in packs of about
``PACK`` tokens: every node once in a pack, with the position ids it has in
its own conversation and the token intervals it may attend to (its
ancestors' and its own, from which a causal mask follows).  A token is one
code point of the formatted text.

The tree is never gathered.  A conversation is the list of its prefix
digests; equal conversations are one list; the lists are range-sorted, which
is depth-first order, and each list emits the turns beyond what it shares
with the list before it.  A pack ends at its token limit or with its
partition; the next one repeats the path it needs once.  So a first turn
shared by a third of all conversations costs one copy a pack, and no task
sees more than its range.

A conversation of more tokens than a pack shares a pack with no other (the
sharing one would pass the limit too), so it needs no list: it is a pack of its
own, a row for each turn, streamed in order.  Lists, stacks and paths thus
hold at most ``limit`` tokens (a turn has 32 or more: 2,048 turns at ``PACK``),
and no row or worker holds a longer conversation.  One conversation is streamed by
one task, as the SHA-256 over its turns needs their order.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>``.  Control strings of
this and other common templates inside a role or text get a backslash after
their first character (one more, if there are some), so they never read as
marks and the escape can be undone.  The loss mask covers the text of
assistant turns alone.

Defined results: rows are ordered by turn (NULL first), then role and text;
NULL roles and texts are empty; rows that repeat are turns of their own; the
rows with a NULL conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

PACK = 65_536
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# FIXED VALUES: control strings of chat templates, split after their first character.
_CONTROL = (r"(?:(?<=<)(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|</?SYS>>)"
            r"|(?<=\[)(\\*)(/?INST\]))")
_ADD = re.compile(_CONTROL)
_DROP = re.compile(_CONTROL.replace(r"(\\*)", r"\\(\\*)"))
OWN_ID = -7
OWN_TEXT = "</s>[INST] ok [/INST]"


def escape(s: str) -> str:
    return _ADD.sub(lambda m: f"\\{m.group()}", s)


def unescape(s: str) -> str:
    return _DROP.sub(lambda m: m.group()[1:], s)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """(segment, start and end of the text in it)."""
    head, body = f"{START}{escape(role)}{SEP}", escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parsed(segment: str) -> tuple[str, str]:
    """(role, text) of a segment."""
    if not (segment.startswith(START) and segment.endswith(END)):
        raise ValueError("not a segment")
    role, _, text = segment[len(START):-len(END)].partition(SEP)
    return unescape(role), unescape(text)


# --- turns and paths --------------------------------------------------------

def _chain(limit: int):
    """Turns in order -> their number, place and segment; leaf and path on a conversation's last turn.

    Turns are held back until their conversation ends or passes the limit, then one by one; a
    conversation beyond the limit (``alone``) has its leaf for a path.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["ckey", "turn_no", "at", "size", "segment", "text_from", "text_to", "loss", "alone", "leaf", "nodes",
                "sizes"]
        key, digest, n, at, alone, nodes, sizes, held = None, b"", 0, 0, False, [], [], []

        def ended():
            leaf = digest.hex()
            return [*((*h, alone, None, None, None) for h in held[:-1]),
                    (*held[-1], alone, leaf, [leaf] if alone else nodes, sizes)]

        for pdf in batches:
            out = []
            for k, role, text in zip(pdf["ckey"], pdf["role"], pdf["text"]):
                if k != key:
                    if held:
                        out += ended()
                    key, digest, n, at, alone, nodes, sizes, held = k, b"", 0, 0, False, [], [], []
                role, text = role or "", text or ""
                r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(digest + len(r).to_bytes(8, "big") + r + t).digest()[:16]
                segment, a, b = formatted(role, text)
                if alone:
                    out += [(*h, alone, None, None, None) for h in held]
                    held = []
                held.append((k, n, at, len(segment), segment, a, b, role == "assistant"))
                n, at = n + 1, at + len(segment)
                if at > limit:
                    alone, nodes, sizes = True, [], []
                else:
                    nodes.append(digest.hex())
                    sizes.append(len(segment))
            if out:
                yield pd.DataFrame(out, columns=cols)
        if held:
            yield pd.DataFrame(ended(), columns=cols)
    return run


_CHAINED = ("ckey string, turn_no int, at long, size int, segment string, text_from int, text_to int, loss boolean, "
            "alone boolean, leaf string, nodes array<string>, sizes array<int>")


def _depth_first(limit: int):
    """Sorted paths -> the nodes each adds to its pack, with places, positions and attention."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["leaf", "ckey", "part", "pack", "turn_no", "seg", "parent", "depth", "start", "size", "position",
                "attend", "path"]
        stack: list = []  # (node, seg, end position, attended intervals) down to the last conversation's leaf
        pack, seg, at, lone = 0, 0, 0, 0
        for pdf in batches:
            out = []
            for leaf, ckey, part, alone, nodes, sizes in zip(pdf["leaf"], pdf["ckey"], pdf["part"], pdf["alone"],
                                                             pdf["nodes"], pdf["sizes"]):
                if alone:
                    out.append((leaf, ckey, -1 - part, lone, -1, -1, -1, -1, -1, 0, 0, None, None))
                    lone += 1
                    continue
                same = 0
                while same < min(len(stack), len(nodes)) and stack[same][0] == nodes[same]:
                    same += 1
                if at and at + int(sum(sizes[same:])) > limit:
                    pack, seg, at, same = pack + 1, 0, 0, 0
                del stack[same:]
                for i in range(same, len(nodes)):
                    _, parent, position, seen = stack[-1] if stack else ("", -1, 0, [])
                    n = int(sizes[i])
                    attend = ([*seen[:-1], (seen[-1][0], at + n)] if seen and seen[-1][1] == at
                              else [*seen, (at, at + n)])
                    stack.append((nodes[i], seg, position + n, attend))
                    out.append((leaf, ckey, part, pack, i, seg, parent, i, at, n, position, attend, None))
                    seg, at = seg + 1, at + n
                # the conversation itself: the segments of its path
                out.append((leaf, ckey, part, pack, -1, -1, -1, -1, -1, 0, 0, None, [s[1] for s in stack]))
            yield pd.DataFrame(out, columns=cols)
    return run


_PLACED = ("leaf string, ckey string, part int, pack int, turn_no int, seg int, parent int, depth int, start long, "
           "size int, position long, attend array<struct<start:long,end:long>>, path array<int>")


class Packed:
    """``segments``: the packs, one row for each node in them (part, pack, seg, parent, depth, start,
    size, position, attend, loss, text); ``paths``: (leaf, part, pack, path) of each distinct conversation;
    ``members``: (conv_id, leaf) of every conversation.  A negative part marks packs of one conversation
    beyond the limit, whose path is NULL: all segments of its pack, in order."""

    def __init__(self, segments: DataFrame, paths: DataFrame, members: DataFrame):
        self.segments, self.paths, self.members = segments, paths, members


def pack(spark: SparkSession, conversations: DataFrame, limit: int = PACK) -> Packed:
    n = shuffle_partitions(spark)
    kind = conversations.schema["conv_id"].dataType.simpleString()
    src = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("ckey"), "turn",
                               "role", "text")
    turns = (src.repartition(n, "ckey").sortWithinPartitions("ckey", "turn", "role", "text")
                .select("ckey", "role", "text").mapInPandas(_chain(limit), _CHAINED))
    turns = staged(spark, turns, "chat-turns")
    convs = turns.filter(F.col("leaf").isNotNull()).select("ckey", "leaf", "alone", "nodes", "sizes")
    members = convs.select(F.expr(f"cast(nullif(ckey, 'null') as {kind})").alias("conv_id"), "leaf")
    distinct = convs.groupBy("leaf").agg(F.min("ckey").alias("ckey"), F.first("alone").alias("alone"),
                                         F.first("nodes").alias("nodes"), F.first("sizes").alias("sizes"))
    ordered = distinct.repartitionByRange(n, "nodes").sortWithinPartitions("nodes")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    placed = staged(spark, ordered.select("leaf", "ckey", "part", "alone", "nodes", "sizes")
                    .mapInPandas(_depth_first(limit), _PLACED), "chat-places")
    said = turns.select("ckey", "turn_no", "at", "size", "segment", "text_from", "text_to", "loss", "alone")
    shared = placed.filter("seg >= 0").join(said.filter("not alone").drop("at", "size"), ["ckey", "turn_no"])
    whole = (placed.filter("part < 0").select("ckey", "part", "pack").join(said.filter("alone"), "ckey")
                   .withColumns({"seg": F.col("turn_no"), "parent": F.col("turn_no") - 1, "depth": F.col("turn_no"),
                                 "start": F.col("at"), "position": F.col("at"),
                                 "attend": F.array(F.struct(F.lit(0).cast("long").alias("start"),
                                                            (F.col("at") + F.col("size")).alias("end")))}))
    at = F.col("start")
    loss = F.when(F.col("loss"), F.array(F.struct((at + F.col("text_from")).alias("start"),
                                                  (at + F.col("text_to")).alias("end"))))
    loss = loss.otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    cols = ["part", "pack", "seg", "parent", "depth", "start", "size", "position", "attend", loss.alias("loss"),
            F.col("segment").alias("text")]
    segments = shared.select(*cols).unionByName(whole.select(*cols))
    return Packed(staged(spark, segments, "chat-packs"),
                  placed.filter("seg < 0").select("leaf", "part", "pack", "path"), members)


# --- reading back -----------------------------------------------------------

def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of conversations in order -> their digests, streamed."""
    cols = ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    leaf, state = None, None

    def done():
        n, a, chars, b, size = state
        return (leaf, n, a.hexdigest(), chars, b.hexdigest(), size)

    for pdf in batches:
        out = []
        for k, text, start, loss in zip(pdf["leaf"], pdf["text"], pdf["start"], pdf["loss"]):
            if k != leaf:
                if leaf is not None:
                    out.append(done())
                leaf, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, body = parsed(text)
            state[0] += 1
            state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                said = unescape(text[span["start"] - start:span["end"] - start])
                state[2] += len(said)
                state[3].update(said.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
        yield pd.DataFrame(out, columns=cols)
    if leaf is not None:
        yield pd.DataFrame([done()], columns=cols)


def read_back(spark: SparkSession, packed: Packed) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the packs alone."""
    segments = packed.segments.select("part", "pack", "seg", "text", "start", "loss")
    steps = packed.paths.filter("part >= 0").select("leaf", "part", "pack", F.posexplode("path").alias("i", "seg"))
    whole = packed.paths.filter("part < 0").select("leaf", "part", "pack")
    rows = steps.join(segments.filter("part >= 0"), ["part", "pack", "seg"]).unionByName(
        whole.join(segments.filter("part < 0"), ["part", "pack"]).withColumn("i", F.col("seg")))
    rows = rows.repartition(shuffle_partitions(spark), "leaf").sortWithinPartitions("leaf", "i")
    digests = rows.select("leaf", "text", "start", "loss").mapInPandas(
        _read, "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
               "formatted_chars long")
    return packed.members.join(digests, "leaf").drop("leaf")


def with_own(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The table with conversation -7, whose texts are control strings."""
    c = conversations.select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(OWN_ID, 0, "user", OWN_TEXT), (OWN_ID, 1, "assistant", OWN_TEXT)],
                                "conv_id long, turn long, role string, text string")
    return c.unionByName(own.select(*[F.col(f.name).cast(f.dataType) for f in c.schema]))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = with_own(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return read_back(spark, pack(spark, conversations))
