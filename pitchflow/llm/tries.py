"""Prefix tries of conversations: sorted, built as compressed (Patricia) trees part by part, joined at the seams, then expanded.

Conversations are sequences of turns; a turn goes by the first 128 bits of the SHA-256 of its role and text, so texts are
never sorted or shuffled. Equal sequences become one row with a count. The distinct sequences are sorted, and each part of the
sorted table is read once with a stack that holds only the branch and end points of the current path. A point's sums are
known when the path leaves it; the nodes with one child on the edge above it follow by sums along the edge. Nodes that go on
in a neighbouring part are told as shares, which are added up afterwards: they are no more than a common prefix per seam.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchflow.llm.tables import Scratch, word_count

#: Characters of one turn in a key.
TURN = 32
#: Conversation ids that agree but for so many bits are written out together.
CHUNK_BITS = 12
#: Nodes told at once.
NODES = 20_000
NO_IDS = hashlib.sha256(b"").hexdigest()


def turn_hash(role: str, text: str) -> Column:
    """The identity of a turn: nulls count as empty, and the role's length keeps role and text apart."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256), 1, TURN)


def ordered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id``, ``hashes``, ``words``: each conversation's turns by number, null first; equal numbers by the turn's hash.

    Rows without a conversation are left out. A conversation of n turns is one row of 40 n bytes.
    """
    told = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), turn_hash(role, text).alias("hash"), word_count(F.col(text)).alias("words")).alias("t"))
    lists = told.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return lists.select("conv_id", F.col("ts.hash").alias("hashes"), F.col("ts.words").alias("words"))


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversation c begins with the first h turns of conversation c - c % ``every``, then come its own after its first h; h is crc32(c) % ``most``.

    A first conversation is asked for by fewer than ``2 * every`` others, so the join has no hot key.
    """
    own = turns.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("int")})
    heads = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, most - 1).alias(f"head_{c}") for c in ("hashes", "words")])
    both = own.join(heads, "base", "left")

    def together(name: str) -> Column:
        head = F.coalesce(F.col(f"head_{name}"), F.slice(name, 1, 0))
        return F.concat(F.slice(head, F.lit(1), F.col("h")), F.slice(F.col(name), F.col("h") + 1, F.greatest(F.size(name), F.lit(1)))).alias(name)

    return both.select("conv_id", together("hashes"), together("words"))


def sequences(convs: DataFrame) -> DataFrame:
    """``key``, ``words``, ``n``, ``conv_id``, ``ends``: the distinct sequences with their number, smallest id and the hash of their ids.

    Ids of equal sequences are first written out in chunks of up to 4,096 neighbouring numbers; the chunks of one sequence then
    stream in order through one SHA-256, which has to be sequential, without being held.
    """
    keyed = convs.select("conv_id", F.array_join("hashes", "").alias("key"), "words").withColumn("id", F.substring(F.sha2("key", 256), 1, TURN))
    ids = F.array_sort(F.collect_list("conv_id"))
    chunks = keyed.groupBy("id", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.first("key").alias("key"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.array_join(ids.cast("array<string>"), ",").alias("text"), F.count(F.lit(1)).alias("n")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[Any] | None = None
        made: list[list[Any]] = []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.list_(pa.int64())), pa.array([m[3] for m in made], pa.int64()), pa.array([m[4] for m in made], pa.int64()), pa.array([m[5].hexdigest() for m in made], pa.string())], names=["key", "words", "n", "conv_id", "ends"])

        for batch in batches:
            for id_, _, key, words, conv, text, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and now[0] == id_:
                    now[3] += n
                    now[5].update(b"," + text.encode())
                    continue
                now = [id_, key, words, n, conv, hashlib.sha256(text.encode())]
                made.append(now)
                if len(made) > NODES:
                    last = made.pop()
                    yield told()
                    made = [last]
        if made:
            yield told()

    ordered = chunks.repartition("id").sortWithinPartitions("id", "chunk").select("id", "chunk", "key", "words", "conv_id", "text", "n")
    return ordered.mapInArrow(run, "key string, words array<long>, n long, conv_id long, ends string")


# ---------------------------------------------------------------- the compressed tree of one part


@dataclass
class Point:
    """A branch or end point on the current path: its depth, members, and what its finished subtrees hold."""

    depth: int
    n: int = 0
    conv_id: int | None = None
    ends: str = NO_IDS
    children: int = 0
    leaves: int = 0
    saved: int = 0

    def add(self, n: int, conv_id: int | None) -> None:
        self.n += n
        if conv_id is not None:
            self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)


class Part:
    """Reads the sorted sequences of one part of the table and tells the nodes that its path leaves.

    ``before`` and ``after``: what the first sequence shares with the last of the part before, and the last
    with the first of the part after, in turns; -1 if there is no such part. Nodes of these shared prefixes are told as shares.
    """

    def __init__(self, before: int, after: int):
        self.shared, self.after = before, after
        self.stack = [Point(0)]
        self.key, self.words = "", []
        self.ids = [hashlib.sha256(b"").digest()[:16]]
        self.out: list[tuple[Any, ...]] = []

    def _tell(self, depth: int, p: Point, children: int, leaves: int, saved: int, ends: str, parent: bytes | None, parent_conv: int | None, share: bool) -> None:
        point = share or children != 1 or ends != NO_IDS or depth == 0
        self.out.append((self.ids[depth] if point else None, parent, parent_conv, p.conv_id, depth, p.n, children, leaves, saved, ends, share, self.words[depth - 1] if share and depth else 0, self.ids[: depth + 1] if share else None))

    def _leave(self, p: Point, above: int, parent: Point) -> None:
        """Tells ``p`` and the nodes on its edge, down from depth ``above`` (left out), and adds ``p`` to ``parent``."""
        parent.add(p.n, p.conv_id)
        whole = max(above, self.shared)  # nodes deeper than this are known in full
        children, leaves, saved, ends = p.children, p.leaves, p.saved, p.ends
        for depth in range(p.depth, whole, -1):
            saved += (p.n - 1) * self.words[depth - 1]
            leaves += not children
            up = self.ids[depth - 1] if depth == whole + 1 else None
            self._tell(depth, p, children, leaves, saved, ends, up, None if up else p.conv_id, False)
            children, ends = 1, NO_IDS
        if whole == above:
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved
            return
        for depth in range(min(whole, p.depth), above, -1):
            self._tell(depth, p, children, leaves, saved, ends, self.ids[depth - 1], None, True)
            children, leaves, saved, ends = 0, 0, 0, NO_IDS

    def _close(self, depth: int) -> None:
        """Leaves every point below ``depth``, which becomes a branch point if it is none."""
        while self.stack[-1].depth > depth:
            p = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth))
            self._leave(p, self.stack[-1].depth, self.stack[-1])
        self.shared = min(self.shared, depth)

    def add(self, key: str, words: list[int], n: int, conv_id: int, ends: str, first: bool) -> None:
        """The next sequence."""
        length, kept = len(key) // TURN, 0 if first else common(self.key, key)
        if not first:
            self._close(kept)
        del self.ids[kept + 1 :]
        digest = hashlib.sha256(key[: kept * TURN].encode())
        for at in range(kept, length):
            digest.update(key[at * TURN : (at + 1) * TURN].encode())
            self.ids.append(digest.copy().digest()[:16])
        self.key, self.words = key, words
        if length > self.stack[-1].depth:
            self.stack.append(Point(length))
        last = self.stack[-1]
        last.add(n, conv_id)
        last.ends = ends

    def end(self) -> None:
        """Leaves what is left of the path, the root last."""
        self.shared = max(self.shared, self.after)
        shared = self.shared
        while len(self.stack) > 1:
            p = self.stack.pop()
            self._leave(p, self.stack[-1].depth, self.stack[-1])
        root = self.stack[0]
        self._tell(0, root, root.children, root.leaves + (not root.children and shared < 0), root.saved, root.ends, None, None, shared >= 0)


def common(a: str, b: str) -> int:
    """Turns that two keys share at their beginning."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * TURN] == b[: middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


NODE = "node binary, parent binary, parent_conv_id long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, share boolean, words long, path array<binary>"
_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.binary())]


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the parts, from rows of part, before, after, key, words, n, conv_id, ends, sorted by part and key."""
    part, number = None, None

    def told(p: Part) -> pa.RecordBatch:
        rows, p.out = p.out, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=[x.split()[0] for x in NODE.split(", ")])

    for batch in batches:
        for at, before, after, key, words, n, conv, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first = at != number
            if first:
                if part is not None:
                    part.end()
                    yield told(part)
                part, number = Part(before, after), at
            part.add(key, words, n, conv, ends, first)
            if len(part.out) > NODES:
                yield told(part)
    if part is not None:
        part.end()
        yield told(part)


# ---------------------------------------------------------------- all parts


def _seams(placed: DataFrame) -> DataFrame:
    """``part``, ``before``, ``after``: a row for each part that has rows, of what its ends share with its neighbours."""
    edges = placed.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()  # two keys for each part
    edges.sort()
    shared = [common(a["high"], b["low"]) for a, b in zip(edges, edges[1:])]
    rows = [(e["part"], before, after) for e, before, after in zip(edges, [-1, *shared], [*shared, -1])]
    return placed.sparkSession.createDataFrame(rows, "part int, before int, after int")


def _joined(shares: DataFrame) -> DataFrame:
    """Nodes that several parts hold shares of, from these: sums of the shares, then sums over the shared nodes below each."""
    merged = shares.groupBy("node").agg(
        F.first("parent", ignorenulls=True).alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.min(F.when(F.col("ends_sha256") != NO_IDS, F.col("ends_sha256"))).alias("ends"), F.first("words").alias("words"), F.first("path").alias("path"),
    )
    below = merged.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("more"))
    full = merged.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    full = full.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")})
    sums = full.select(F.explode("path").alias("node"), "n_leaves", "saved_tokens").groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    out = full.drop("n_leaves", "saved_tokens").join(sums, "node")
    return out.select("node", "parent", F.lit(None).cast("long").alias("parent_conv_id"), "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"))


def prefix_trie(convs: DataFrame, parts: int | None = None) -> DataFrame:
    """Every node of the trie of ``convs`` (``conv_id``, ``hashes``, ``words``), the textless root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes
    in the subtree), ``saved_tokens`` (over the subtree, members less one times the words of the last turn) and ``ends_sha256`` (of the ids that
    end there). An empty table has no nodes. ``parts``: of the sorted table; the number of shuffle partitions if not given.
    """
    spark = convs.sparkSession
    scratch = Scratch(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.write(sequences(convs).repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "sequences")
    rows = placed.join(F.broadcast(_seams(placed)), "part")  # three numbers for each part
    ordered = rows.repartition(parts, "part").sortWithinPartitions("part", "key").select("part", "before", "after", "key", "words", "n", "conv_id", "ends")
    nodes = scratch.write(ordered.mapInArrow(_nodes, NODE), "nodes")
    scratch.drop("sequences")
    joined = scratch.write(_joined(nodes.where("share")), "joined")
    known = nodes.where("not share").drop("share", "words", "path")
    points = known.where("node is not null").select("node", "conv_id").unionByName(joined.select("node", "conv_id"))
    told = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tops = known.where("parent is not null").unionByName(joined)
    above = points.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    with_parents = tops.join(above, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    return known.where("parent is null").select(told).unionByName(with_parents.select(told))
