"""Best-fit packing of token pieces by exact-complement hashing.

Documents become pieces of 1 to ``cap`` tokens. Only the counts per length, at most ``cap``
numbers, come to the driver. There a plan of patterns (lists of lengths that share a sequence,
and how often) is made: sums of one, two and three available lengths are indexed, and for each
longest piece a combination that fills its gap exactly is consumed as often as availability
allows; what is left goes best-fit, longest first. The pieces, ranked within their lengths,
then find their pattern, sequence and offset by their rank alone.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchflow.llm.pieces import PATTERN
from pitchflow.llm.tables import key_name, materialize
from pitchflow.llm.token_counts import byte_letters

CAP = 2_048
#: Parts into which each length's pieces are dealt to be ranked, so that a hot length is no hot task.
PARTS = 1_024
#: Words beyond this length are left to the library, whose merging takes n log n.
LONG_WORD = re.compile(r"\S{2000}|\s{2000}")

# ---------------------------------------------------------------- tokens


class Encoder:
    """Token ids as ``tokenizers`` gives them, in 32-bit numbers.

    A byte-level file whose ids follow its merges is run by ``tiktoken``, which takes the same
    vocabulary as ranks, gives the same ids and is about three times as fast. Other files, texts
    with strings that are tokens wherever they stand, and texts with very long words go to
    ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.fast = self._ranked(json.load(f))

    @staticmethod
    def _ranked(spec: dict) -> tiktoken.Encoding | None:
        """The file's vocabulary by rank, or None if it is not plain byte-level BPE with ids in order of its merges."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not spec.get("normalizer") and not model.get("ignore_merges")
        if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        byte = {letter: i for i, letter in enumerate(byte_letters())}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        first = {model["vocab"].get(letter, -1) for letter in byte}
        if merged != sorted(set(merged)) or -1 in first or merged and max(first) > merged[0]:
            return None
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[x] for x in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(merged) + 256 else None

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(a in text for a in self.added) or LONG_WORD.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker. Spark runs a worker per core, so the library's own threads are off."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def cuts(length: int, cap: int = CAP) -> list[tuple[int, int]]:
    """start, length of the pieces of a document: whole if it fits, else the first piece takes the rest."""
    if length <= cap:
        return [(0, length)]
    rest = length % cap
    return ([(0, rest)] if rest else []) + [(at, cap) for at in range(rest, length, cap)]


def token_pieces(df: DataFrame, key: str, text: str, tokenizer: str, *, cap: int = CAP, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if wanted, ``ids`` of every piece.

    A document is the ids of its text and ``end_id``. ``tokenizer`` is the path of a ``tokenizers``
    file, present on every machine. Null texts count as empty: one piece that is ``end_id`` alone.
    """
    end = np.asarray([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows: list[list] = [[] for _ in range(6)]
            for i, text in enumerate(texts):
                ids = np.append(encode(text.as_py() or ""), end).astype("<u4", copy=False)
                for p, (start, n) in enumerate(cuts(len(ids), cap)):
                    part = ids[start : start + n]
                    for column, value in zip(rows, (i, p, start, n, zlib.crc32(part), part.astype(np.int32) if with_ids else None), strict=True):
                        column.append(value)
            out = [keys.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5])]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(rows[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


# ---------------------------------------------------------------- the plan


class Sums:
    """Which lengths are available how often, and which sums pairs of them have."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.copy()
        there = (self.n > 0).astype(np.int64)
        self.pairs = np.convolve(there, there)  # ordered pairs of available lengths by sum

    def take(self, pattern: tuple[int, ...], times: int) -> None:
        for x in pattern:
            self.n[x] -= times
        for x in set(pattern):
            if self.n[x] == 0:  # gone: its pairs leave the index
                there = np.flatnonzero(self.n > 0)
                self.pairs[x + there] -= 2
                self.pairs[2 * x] -= 1

    def often(self, pattern: tuple[int, ...]) -> int:
        return min(int(self.n[x]) // pattern.count(x) for x in set(pattern))

    def pair(self, total: int, spare: np.ndarray) -> tuple[int, int, int]:
        """The two lengths of this sum that are available most often, and how often."""
        top = min(total - 1, len(spare) - 1)
        a = np.arange((total + 1) // 2, top + 1)
        if not len(a):
            return 0, 0, 0
        many = np.minimum(spare[a], np.where(2 * a == total, spare[total - a] // 2, spare[total - a]))
        many = np.where(2 * a == total, spare[a] // 2, many)
        i = int(np.argmax(many))
        return int(a[i]), int(total - a[i]), int(many[i])

    def fill(self, first: int, gap: int) -> tuple[int, ...]:
        """One, two or three available lengths that sum to the gap beside ``first``; () if there are none."""
        spare = self.n.copy()
        spare[first] -= 1
        if spare[gap] > 0:
            return (gap,)
        if self.pairs[gap] > 0 and (got := self.pair(gap, spare))[2] > 0:
            return got[:2]
        a = np.arange(1, gap - 1)
        a = a[(spare[a] > 0) & (self.pairs[gap - a] > 0)]
        for x in a[np.argsort(-spare[a], kind="stable")].tolist():
            spare[x] -= 1
            got = self.pair(gap - x, spare)
            spare[x] += 1
            if got[2] > 0:
                return (x, *got[:2])
        return ()


def plan(counts: dict[int, int], cap: int = CAP) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each; together they use every count up."""
    n = np.zeros(cap + 1, np.int64)
    for length, count in counts.items():
        n[length] += count
    sums, out = Sums(n), []
    for first in range(cap, 0, -1):
        while sums.n[first] > 0:
            rest = sums.fill(first, cap - first) if first < cap else ()
            if not rest and first < cap:
                break
            pattern = (first, *rest)
            times = sums.often(pattern)
            sums.take(pattern, times)
            out.append((pattern, times))
    return out + best_fit({i: int(sums.n[i]) for i in np.flatnonzero(sums.n).tolist()}, cap)


def best_fit(counts: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the open sequences with the smallest gap that takes it."""
    groups: dict[int, list[list]] = defaultdict(list)  # by gap: [pattern, how many]
    gaps: list[int] = []

    def add(pattern: tuple[int, ...], times: int) -> None:
        gap = cap - sum(pattern)
        if gap not in groups or not groups[gap]:
            bisect.insort(gaps, gap)
        groups[gap].append([pattern, times])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = cap // length
                if left >= each:
                    add((length,) * each, left // each)
                if left % each:
                    add((length,) * (left % each), 1)
                break
            group = groups[gaps[at]]
            pattern, times = group[-1]
            used = min(left, times)
            if used == times:
                group.pop()
                if not group:
                    gaps.pop(at)
            else:
                group[-1][1] -= used
            add((*pattern, length), used)
            left -= used
    return [(pattern, times) for found in groups.values() for pattern, times in found]


# ---------------------------------------------------------------- placing


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each place in a pattern: the length, the first rank that it takes, its first sequence, its offset."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], base, offset))
            taken[length] += times
            offset += length
        base += times
    table = np.asarray(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "base", "offset"), table.T, strict=True))


def ranked(pieces: DataFrame, order: list[str], parts: int = PARTS) -> DataFrame:
    """``pieces`` with ``rank``, from 0 within each length. A length's pieces are dealt into parts by a hash."""
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "part").orderBy(*order)
    placed = dealt.withColumn("place", F.row_number().over(within) - 1)
    return placed.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place")).drop("part", "before", "place")


def pack_pieces(pieces: DataFrame, order: list[str], cap: int = CAP) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``length`` must be from 1 to ``cap``; ``order`` breaks ties.

    ``pieces`` is read several times and should be a written table. Driver and tasks hold the
    plan, whose size depends on ``cap`` and not on the number of pieces. An empty table gives no rows.
    """
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = pieces.sparkSession.sparkContext.broadcast(intervals(plan(counts, cap)))
    rows = ranked(pieces, order)
    at_length, at_rank = rows.columns.index("length"), rows.columns.index("rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        first = np.searchsorted(t["length"], np.arange(cap + 2))
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (at_length, at_rank))
            # intervals are ordered by length and rank: one search over both at once
            i = np.searchsorted(t["length"] * (1 << 44) + t["rank"], length * (1 << 44) + rank, "right") - 1
            assert (i >= first[length]).all()
            columns = [c for k, c in enumerate(batch.columns) if k != at_rank]
            names = [c for k, c in enumerate(batch.schema.names) if k != at_rank]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(t["base"][i] + rank - t["rank"][i]), pa.array(t["offset"][i])], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "rank")
    return rows.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(df: DataFrame, key: str, text: str, tokenizer: str, *, cap: int = CAP, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32`` [, ``ids``], ``sequence_id``, ``offset``.

    Every token of every text is in exactly one place; sequences hold at most ``cap`` tokens. Null
    texts count as empty. Rows with equal keys, also repeated rows, are packed as documents of
    their own. An empty table gives no rows; only ``key`` and ``text`` of ``df`` are read. A key named like a new column gets an
    underscore in front.
    """
    docs = df.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    pieces = materialize(token_pieces(docs, "doc", "text", tokenizer, cap=cap, end_id=end_id, with_ids=with_ids), "pieces")
    names = ["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", "offset"]
    return pack_pieces(pieces, ["doc", "piece", "ids_crc32"], cap).select(F.col("doc").alias(key_name(key, *names)), *names)
