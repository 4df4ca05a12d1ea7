"""SimHash near-dedup: anchor-point covering of 64-bit fingerprints.

Two fingerprints that differ in at most 3 bits differ in at most 1 bit in one of their 32-bit
halves. On each half the anchors are the words of the perfect [31, 26] Hamming code (the top bit
of the half is left out), which has covering radius 1: every half lies within 1 of exactly one
anchor, its home. Each fingerprint is replicated to every anchor within radius + 1 = 2 of it, at
most 16 a half, so a pair within 1 always meets at the home anchor of either. Per anchor the
fingerprints that live there are compared with all that reach it, over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchflow.llm.components import components
from pitchflow.llm.tables import free_name, key_name, materialize, order_of, row_id

SEED = 42
N_WINDOW = 3
MAX_BITS = 3
#: Members of an anchor beyond which its home members are dealt to several tasks.
BLOCK = 2_048
#: Groups of up to so many members are compared all groups at once.
FEW = 8

# ---------------------------------------------------------------- fingerprints


def _counts(data: bytes, n: int) -> np.ndarray:
    """XXH64 of each n-word window of the text, repeats included."""
    words = data.lower().split()  # bytes: only A-Z change, and only the six ASCII spaces separate
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(n, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, n: int = N_WINDOW) -> int:
    """Bit i is 1 if set in over half of the hashes; 0 for a text without words."""
    hashes = _counts((text or "").encode("utf-8", "surrogatepass"), n)
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str, *extra: str, n: int = N_WINDOW) -> DataFrame:
    """The columns ``extra`` of ``df`` and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(extra))
            fps = np.fromiter((fingerprint(x.as_py(), n) for x in values), np.uint64, len(values))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(extra))], pa.array(fps.view(np.int64))], names=[*extra, "fp"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*extra).schema)
    return df.select(*extra, text).mapInArrow(run, f"{fields}, fp long")


# ---------------------------------------------------------------- anchors


def syndromes(halves: np.ndarray) -> np.ndarray:
    """XOR of the places (1 to 31) of the set bits: 0 for a code word, else the place that is wrong."""
    low = halves & np.uint32(0x7FFFFFFF)
    out = np.zeros(len(low), np.uint32)
    for place in range(1, 32):
        out ^= ((low >> np.uint32(place - 1)) & np.uint32(1)) * np.uint32(place)
    return out


def _flip(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Flips the bit at each place from 1 to 31; place 0 flips nothing."""
    bit = np.where(places > 0, np.left_shift(np.uint32(1), np.maximum(places, 1) - np.uint32(1)), np.uint32(0))
    return words ^ bit.astype(np.uint32)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, anchor, home of every anchor within covering radius + 1 of a half of each fingerprint.

    A word with syndrome s has its home at distance 1 (0 if s = 0), and the code words at
    distance 2 are those that flip places a and b with a xor b = s, 15 pairs. A code word has no
    other code word within 2.
    """
    rows, found, home = [], [], []
    index = np.arange(len(fps))
    for half in (0, 1):
        part = ((fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        s, tag = syndromes(part), np.int64(half) << np.int64(32)
        rows.append(index)
        found.append(_flip(part, s).astype(np.int64) | tag)
        home.append(np.ones(len(fps), bool))
        for a in range(1, 32):
            b = s ^ np.uint32(a)
            use = (s > 0) & (b > a) & (b < 32)
            rows.append(index[use])
            found.append(_flip(_flip(part[use], np.full(use.sum(), a, np.uint32)), b[use]).astype(np.int64) | tag)
            home.append(np.zeros(use.sum(), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        row, anchor, home = anchors(fps.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[row]), pa.array(home)], names=["anchor", "fp", "home"])


# ---------------------------------------------------------------- comparing


def _near(fps: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one anchor: each linked member with the first member of its cluster there."""
    label = np.arange(len(fps))
    own = np.flatnonzero(home)
    for at in range(0, len(own), 64):
        block = own[at : at + 64]
        close = np.bitwise_count(fps[block][:, None] ^ fps[None, :]) <= max_bits
        for row in close:
            labels = label[row]
            if labels.min() != labels.max():
                label[np.isin(label, labels)] = labels.min()
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def _group_links(group: np.ndarray, fps: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of whole groups; ``group`` numbers them in order. Those of up to FEW members go all at once."""
    left, right = [], []
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((starts, [len(group)])))
    few = np.repeat(size <= FEW, size)
    for d in range(1, FEW):
        same = (group[d:] == group[:-d]) & few[d:] & (home[d:] | home[:-d])
        i = np.flatnonzero(same)
        i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= max_bits]
        left.append(fps[i + d])
        right.append(fps[i])
    for at, n in zip(starts[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        x, y = _near(fps[at : at + n], home[at : at + n], max_bits)
        left.append(x)
        right.append(y)
    return left, right


def _compare(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by anchor and part; the last group of a batch waits for the next one."""
    kept: list[np.ndarray] = []
    for columns, last in _with_last(batches):
        if kept:
            columns = [np.concatenate((k, c)) for k, c in zip(kept, columns, strict=True)] if columns else kept
        if not columns or not len(columns[0]):
            continue
        anchor, part, fps, home = columns
        new = np.concatenate(([False], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])))
        end = len(anchor) if last else int(np.flatnonzero(np.concatenate(([True], new[1:])))[-1])
        left, right = _group_links(np.cumsum(new[:end]), fps[:end].view(np.uint64), home[:end], max_bits) if end else ([], [])
        kept = [c[end:] for c in columns]
        if sum(map(len, left)):
            yield _pairs(left, right)


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], bool]]:
    for batch in batches:
        yield [c.to_numpy(zero_copy_only=False) for c in batch.columns], False
    yield [], True


def _pairs(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])


def near_fingerprints(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose components are those of all near pairs.

    Per anchor a link for each linked member, not one for each pair (but for groups of up to FEW).
    The home members and the members of a crowded anchor are cut into parts by a hash, and each
    part of the one meets each part of the other in a group of its own, so groups stay small.
    """
    if max_bits > 3:
        raise ValueError("two halves and radius + 1 cover differences of at most 3 bits")
    reached = materialize(distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long, home boolean"), "anchors")
    crowds = materialize(reached.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).withColumn("parts", F.ceil(F.col("n") / block).cast("int")).drop("n"), "crowds")
    few = reached.join(crowds.select("anchor"), "anchor", "left_anti").withColumn("part", F.lit(0))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    many = reached.join(crowds, "anchor").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = many.withColumn("part", F.col("other") * F.col("parts") + F.col("own")).withColumn("home", F.col("home") & (F.col("own") == F.col("other")))
    lives = many.where(F.col("home") & (F.col("own") != F.col("other"))).withColumn("part", F.col("own") * F.col("parts") + F.col("other"))
    columns = ["anchor", "part", "fp", "home"]
    dealt = few.select(columns).unionByName(met.select(columns)).unionByName(lives.select(columns))
    ordered = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "fp")
    return ordered.mapInArrow(lambda it: _compare(it, max_bits), "a long, b long")


def _grouped(df: DataFrame, key: str, text: str, n: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (key, fp) of ``df``, and of each fingerprint: its component and the smallest key and first row there.

    What joins on a component or fingerprint is a written table, so AQE can split hot ones.
    """
    rows = df.select(F.col(key).alias("key"), order_of(key).alias("doc"), row_id(key, text).alias("uid"), F.col(text).alias("text"))
    fps = materialize(fingerprints(rows, "text", "key", "doc", "uid", n=n), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("key").alias("first"), F.min(F.struct("doc", "uid")).alias("head")), "distinct-fps")
    links = near_fingerprints(distinct, max_bits).distinct()
    by_fp = components(links, "a", "b").withColumnRenamed("node", "fp")
    return fps.select("key", "fp"), materialize(distinct.join(by_fp, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")


def simhash_components(df: DataFrame, key: str, text: str, *, n: int = N_WINDOW, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``df``: ``key``, ``fingerprint`` (16 hexadecimal digits), ``component_id``.

    ``component_id`` is the smallest key that links of at most ``max_bits`` differing bits reach.
    Texts of under ``n`` words hash as a whole; null and empty texts have fingerprint zero and are
    linked like others. Equal fingerprints are merged before anything is compared. Null keys are
    never the smallest unless the whole component has none; repeated rows give repeated rows; an
    empty table gives none; other columns of ``df`` are not read. ``key`` must be a whole number; named like a new column it gets an underscore in front.
    """
    fps, named = _grouped(df, key, text, n, max_bits)
    # components of fingerprints are named by a fingerprint; name them by their smallest key instead
    smallest = materialize(named.groupBy("component").agg(F.min("first").alias("component_id")), "smallest-keys")
    ids = materialize(named.join(smallest, "component").select("fp", "component_id"), "fp-ids")
    out = fps.join(ids, "fp")
    return out.select(F.col("key").alias(key_name(key, "fingerprint", "component_id")), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(df: DataFrame, key: str, text: str, *, n: int = N_WINDOW, max_bits: int = MAX_BITS) -> DataFrame:
    """Of each component one row of ``df``, with all columns: that with the smallest key.

    Rows with one key, or none, and different texts are rows of their own; null keys come after all
    others, and among equal keys the texts decide. Of rows that repeat key and text one stays. An
    empty table gives no rows; ``key`` must be a whole number.
    """
    _, named = _grouped(df, key, text, n, max_bits)
    uid = free_name(df, "uid")
    heads = named.groupBy("component").agg(F.min("head").alias("head")).select(F.col("head.uid").alias(uid))
    return df.withColumn(uid, row_id(key, text)).join(heads, uid, "left_semi").dropDuplicates([uid]).drop(uid)


__all__ = ["anchors", "fingerprint", "fingerprints", "near_fingerprints", "simhash_components", "simhash_dedup"]
