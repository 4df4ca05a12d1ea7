"""Phrase mining with compressed position bitmaps: shift, AND and popcount, depth-first in parts that hold whole phrases.

A phrase belongs to its rarest word, the first one if it comes twice. Each place of a word sends a window to that word's
part: the place and up to four words on either side, as far as none is rarer. So a part gets every occurrence of its phrases, and
counts nothing for others. In a part each word has a bitmap of its positions, kept as its blocks of 16 positions that are not empty.
The bitmap of a phrase holds the positions where it ends: that of a phrase and one more word is the phrase's, shifted by one, without
the first positions of windows, AND the word's. Its popcount is the number of occurrences; what is too rare is not extended, which
loses nothing, as a phrase is no more frequent than its parts. What is sent is at most a window for each word of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchflow.llm.tables import Scratch

#: Positions of a block, of a shard, and of a pass in which a part is mined; the last bounds memory.
BITS, POSITIONS, PASS = 16, 1 << 20, 1 << 19
#: Shards are numbered in steps, so that a shard's number and a word's place in it make a number of their own.
POSITIONS_AT_MOST = 1 << 20
#: Stands for what no phrase goes across: breaks and words that are too rare. Larger than any word's number.
NONE = (1 << 31) - 1
#: Words of the longest phrase.
LONGEST = 5
#: Shards' worth of words that a task holds, however many languages they are of.
OPEN = 4
#: Blocks that are extended at once; bounds memory.
AT_ONCE = 1 << 15
#: Words of the corpus for each part.
PART = 1 << 20
#: A more frequent word has several parts, by shard, whose counts are summed up.
PIECE = 1 << 22
UNKNOWN = "und"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_BREAKS + b"\t", b"\n" * len(_BREAKS) + b" ")


class _Words(dict):
    """Numbers words as they come. The empty string is what stands between two spaces."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _fresh() -> _Words:
    return _Words({b"": 0, b"\n": 1})


def numbered(text: str, words: _Words) -> np.ndarray:
    """The numbers of a text's words, and 1 between pieces."""
    data = text.encode("utf-8", "replace").lower().translate(_TABLE)
    ids = np.fromiter(map(words.__getitem__, data.replace(b"\n", b" \n ").split(b" ")), np.int32)
    return ids[ids != 0]


# ---------------------------------------------------------------- bitmaps


def _masks(positions: np.ndarray, n_blocks: int) -> np.ndarray:
    """The bits of these positions, block by block."""
    out = np.zeros(n_blocks, np.uint16)
    np.bitwise_or.at(out, positions // BITS, (1 << (positions % BITS)).astype(np.uint16))
    return out


def bitmaps(ids: np.ndarray, starts: np.ndarray, context: int) -> dict[str, Any]:
    """Bitmaps of the words (0, 1, ...) at these positions. Phrases that end in the first ``context`` positions are not counted.

    ``counts``: own positions of each word. ``blocks``: how many blocks of each word are not empty; ``block``, ``bits``: these, word by
    word. ``starts``: bits of the positions at which pieces begin; ``own``: bits of own positions.
    """
    n_blocks = -(-max(len(ids), 1) // BITS)
    order = np.argsort(ids, kind="stable")
    word, block = ids[order], order // BITS
    bits = (1 << (order % BITS)).astype(np.uint16)
    at = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])])) if len(ids) else np.empty(0, np.int64)
    return {
        "counts": np.bincount(ids[context:], minlength=int(ids.max(initial=-1)) + 1).astype(np.int64),
        "blocks": np.bincount(word[at], minlength=int(ids.max(initial=-1)) + 1).astype(np.int32), "block": block[at].astype(np.int32), "bits": np.bitwise_or.reduceat(bits, at) if len(at) else bits,
        "starts": _masks(np.flatnonzero(starts), n_blocks), "own": _masks(np.arange(context, len(ids)), n_blocks),
    }


class Miner:
    """Extends phrases. ``word``, ``block``, ``bits``: the bitmaps of the words; a phrase with fewer than ``least`` occurrences is not extended."""

    def __init__(self, word: np.ndarray, block: np.ndarray, bits: np.ndarray, starts: np.ndarray, own: np.ndarray, least: int = 1):
        n_blocks = len(starts)
        order = np.argsort(block, kind="stable")  # by block, for the AND
        self.word, self.bits = word[order].astype(np.int64), bits[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=n_blocks))]).astype(np.int64)
        self.starts, self.own, self.least, self.n_words = starts, own, least, int(word.max(initial=0)) + 1
        self.singles = word.astype(np.int64), block.astype(np.int64), bits

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Phrase, word, block and bits of all one-word extensions: the bitmaps shifted by one and cut at pieces, AND those of the words."""
        shifted = np.concatenate([(bits << 1).astype(np.uint16), bits >> (BITS - 1)])
        block, phrase = np.concatenate([block, block + 1]), np.concatenate([phrase, phrase])
        inside = (shifted != 0) & (block < len(self.starts))
        shifted, block, phrase = shifted[inside], block[inside], phrase[inside]
        shifted &= ~self.starts[block]
        inside = shifted != 0
        shifted, block, phrase = shifted[inside], block[inside], phrase[inside]
        n = self.at[block + 1] - self.at[block]
        from_ = np.repeat(np.arange(len(block)), n)
        there = np.arange(len(from_)) - np.repeat(np.cumsum(n) - n, n) + self.at[block][from_]
        both = shifted[from_] & self.bits[there]
        hit = np.flatnonzero(both)
        return phrase[from_[hit]], self.word[there[hit]], block[from_[hit]], both[hit]

    def mine(self, phrases: np.ndarray, which: np.ndarray, block: np.ndarray, bits: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of words and their counts, depth-first: some phrases, all their extensions, then the next phrases.

        ``phrases``: a row of words each; ``which``, ``block``, ``bits``: their bitmaps, phrase by phrase.
        """
        edges = [0]
        if len(which):
            first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            last = 0
            for at in np.append(first[1:], len(which)).tolist():
                # phrases go together while they are few blocks; a single phrase of more is cut by blocks below
                if at - edges[-1] > AT_ONCE and last > edges[-1]:
                    edges.append(last)
                last = at
            edges.append(len(which))
        for low, high in zip(edges, edges[1:]):
            found = [self.extend(which[at : min(at + AT_ONCE, high)], block[at : min(at + AT_ONCE, high)], bits[at : min(at + AT_ONCE, high)]) for at in range(low, high, AT_ONCE)]
            old, word, blk, got = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(word):
                continue
            # the bits of a block may come in two rows, its own and those shifted in; neither repeats the other's
            order = np.argsort(old * self.n_words + word, kind="stable")
            old, word, blk, got = old[order], word[order], blk[order], got[order]
            at = np.concatenate([[True], (old[1:] != old[:-1]) | (word[1:] != word[:-1])])
            new, first = np.cumsum(at) - 1, np.flatnonzero(at)
            enough = np.add.reduceat(np.bitwise_count(got).astype(np.int64), first) >= self.least
            if not enough.all():
                keep = enough[new]
                old, word, blk, got, at = old[keep], word[keep], blk[keep], got[keep], at[keep]
                if not len(word):
                    continue
                new, first = np.cumsum(at) - 1, np.flatnonzero(at)
            longer = np.concatenate([phrases[old[at]], word[at][:, None]], axis=1)
            count = np.add.reduceat(np.bitwise_count(got & self.own[blk]).astype(np.int64), first)
            # a phrase of which no end counts gets 0 here, but longer ones may begin with it
            yield longer, count
            if longer.shape[1] < longest:
                yield from self.mine(longer, new, blk, got, longest)


# ---------------------------------------------------------------- shards


_SHARD = "shard long, lang string, words array<string>, counts array<long>, size int, context int, ids binary"
_WINDOWS = "part int, whole boolean, windows int, size int, data binary"
_PHRASES = ", ".join(f"w{i + 1} long" for i in range(LONGEST)) + ", n long"


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _packed(ids: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 31, one byte of each after the other."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<i4").ravel()


class _Open:
    """A language's shard that is being filled."""

    def __init__(self) -> None:
        self.words, self.parts, self.held, self.context = _fresh(), [], 0, 0

    def made(self, shard: int, lang: str) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        said = ids - 2  # -1 between pieces
        there = np.bincount(said[said >= 0], minlength=len(self.words) - 2) > 0
        place = np.append(np.cumsum(there) - 1, -1)[said]  # the break takes the last one
        counts = np.bincount(place[self.context :] + 1, minlength=int(there.sum()) + 1)[1:]
        words = [w.decode("utf-8", "replace") for w, yes in zip(list(self.words)[2:], there.tolist(), strict=True) if yes]
        binary = pa.array([_codec().compress(_packed(place + 1), asbytes=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([lang]), pa.array([words], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([len(ids)], pa.int32()), pa.array([self.context], pa.int32()), binary], names=[x.split()[0] for x in _SHARD.split(", ")])


def shards(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """A row for each shard of up to ``POSITIONS`` words of one language: its distinct words, and their places in it (0 between pieces) one after the other.

    Documents fill shards as they come. A piece that goes on in the next shard takes its last words along as
    context, so that no phrase is lost and none is counted twice.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(lang), F.lit(UNKNOWN)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId() << 40, {}
        for batch in batches:
            for said, name in zip(batch.column(0), batch.column(1), strict=True):
                name = name.as_py()
                now = held.setdefault(name, _Open())
                ids = np.append(numbered(said.as_py(), now.words), np.int32(1))
                while True:
                    room = POSITIONS - now.held
                    now.parts.append(ids[:room])
                    now.held += len(ids[:room])
                    if len(ids) < room:
                        break
                    yield now.made(shard, name)
                    shard += POSITIONS_AT_MOST
                    tail, rest = ids[max(0, room - LONGEST + 1) : room], ids[room:]
                    breaks = np.flatnonzero(tail == 1)
                    tail = tail[breaks[-1] + 1 :] if len(breaks) else tail
                    old, now = now, _Open()
                    held[name] = now
                    if len(rest) > POSITIONS:
                        now.words = old.words  # a long text keeps its numbers; they begin anew with its last shard
                    else:
                        known = list(old.words)
                        both = np.array([now.words[known[i]] for i in np.concatenate([tail, rest]).tolist()], np.int32)
                        tail, rest = both[: len(tail)], both[len(tail) :]
                    now.context = now.held = len(tail)
                    now.parts, ids = [tail], rest
                if sum(x.held for x in held.values()) > OPEN * POSITIONS:
                    fullest = max(held, key=lambda x: held[x].held)
                    yield held.pop(fullest).made(shard, fullest)
                    shard += POSITIONS_AT_MOST
        for name, now in held.items():
            if now.held:
                yield now.made(shard, name)
                shard += POSITIONS_AT_MOST

    return rows.mapInArrow(run, _SHARD)


def _numbers(column: pa.Array, i: int) -> list[np.ndarray]:
    """The fields of the structs in row ``i``."""
    found = column[i].values
    return [found.field(k).to_numpy(zero_copy_only=False) for k in range(found.type.num_fields)]


def windows(r: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a shard's words, numbered by rarity: place, words to the left and to the right, and the first end that counts.

    To the left all words are more frequent, to the right none is rarer, so each phrase has its place in one window only. The
    end is told as its distance to the place; ends in the first ``context`` words are the last shard's. Windows without phrases are left out.
    """
    reach = LONGEST - 1
    pad = np.concatenate([np.full(reach, NONE, r.dtype), r, np.full(reach, NONE, r.dtype)])
    left, right = np.zeros(len(r), np.uint8), np.zeros(len(r), np.uint8)
    before, after = r < NONE, r < NONE
    for k in range(1, reach + 1):
        before = before & (pad[reach - k : reach - k + len(r)] < r)
        after = after & (pad[reach + k : reach + k + len(r)] <= r)
        left += before
        right += after
    end = np.zeros(len(r), np.uint8)
    end[:context] = np.minimum(context - np.arange(min(context, len(r))), LONGEST)
    at = np.flatnonzero((left + right > 0) & (end <= right))
    return at, left[at], right[at], end[at]


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1 ... (n of them), one after the other."""
    n = n.astype(np.int64)
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def _mixed(x: np.ndarray) -> np.ndarray:
    """31 bits that look random."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)


def sent(bound: DataFrame, n_parts: int) -> DataFrame:
    """The windows of each shard for each part, packed. ``whole``: the part holds every window of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, names = _codec(), [x.split()[0] for x in _WINDOWS.split(", ")]
        for batch in batches:
            shard, size, context, ids, known = batch.columns
            for i in range(batch.num_rows):
                place, number, f = _numbers(known, i)
                places = _unpacked(np.frombuffer(codec.decompress(ids[i].as_buffer(), 4 * size[i].as_py()), np.uint8))
                numbers, often = np.full(max(int(places.max(initial=0)), int(place.max(initial=0)) + 1) + 1, NONE, np.int64), np.zeros(len(place), np.int64)
                numbers[place + 1] = number
                r = numbers[places]
                at, left, right, end = windows(r, context[i].as_py())
                if not len(at):
                    continue
                # a very frequent word's windows go to several parts, a shard's to one of them
                order = np.argsort(number)
                often = f[order][np.searchsorted(number[order], r[at])]
                pieces = -(-often // PIECE)
                salt = np.int64(_mixed(np.array([shard[i].as_py() + 1]))[0]) % pieces
                part = _mixed(r[at] * 4_096 + salt) % n_parts * 2 + (pieces == 1)
                order = np.argsort(part, kind="stable")
                at, left, right, end, part = at[order], left[order], right[order], end[order], part[order]
                heads = left * 25 + right * 5 + end
                n = left.astype(np.int64) + right + 1
                words = r[_spread(at - left, n)]
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                edges, till = np.append(first, len(part)), np.concatenate([[0], np.cumsum(n)])
                data = [codec.compress(heads[a:b].tobytes() + _packed(words[till[a] : till[b]]), asbytes=True) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                columns = [pa.array(part[first] // 2, pa.int32()), pa.array(part[first] % 2 == 1), pa.array(np.diff(edges), pa.int32()), pa.array(np.diff(till[edges]), pa.int32()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return bound.select("shard", "size", "context", "ids", "known").mapInArrow(run, _WINDOWS)


def passes(left: np.ndarray, right: np.ndarray, end: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """A part's windows in passes of about ``PASS`` words, none of which shares a phrase with another: left, right, end, words.

    Windows go by their words; those of a word with too many by the next word too, and what ends at the word by the one before.
    """
    n = left.astype(np.int64) + right + 1
    first = np.cumsum(n) - n
    if len(words) <= PASS:
        yield left, right, end, words
        return
    pivot = words[first + left]
    order = np.argsort(pivot, kind="stable")
    left, right, end, n, first, pivot = left[order], right[order], end[order], n[order], first[order], pivot[order]
    edge = np.append(np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1])), len(pivot)).tolist()
    held, low = np.concatenate([[0], np.cumsum(n)]), 0
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if a > low and held[b] - held[low] > PASS:
            yield left[low:a], right[low:a], end[low:a], words[_spread(first[low:a], n[low:a])]
            low = a
        if held[b] - held[a] > PASS:
            on, off = np.flatnonzero(right[a:b] > 0) + a, np.flatnonzero((left[a:b] > 0) & (end[a:b] == 0)) + a
            of = np.concatenate([on, off])
            cut = np.concatenate([right[on], np.zeros(len(off), right.dtype)])
            ends = np.concatenate([np.maximum(end[on], 1), np.zeros(len(off), end.dtype)])
            beside = np.concatenate([words[first[on] + left[on] + 1].astype(np.int64) * 2, words[first[off] + left[off] - 1].astype(np.int64) * 2 + 1])
            size = left[of].astype(np.int64) + cut + 1
            turn = _mixed(beside) % int(-(-int(size.sum()) // PASS))
            for k in np.unique(turn).tolist():
                some = np.flatnonzero(turn == k)
                yield left[of[some]], cut[some], ends[some], words[_spread(first[of[some]], size[some])]
            low = b
    if low < len(pivot):
        yield left[low:], right[low:], end[low:], words[_spread(first[low:], n[low:])]


def mined(left: np.ndarray, right: np.ndarray, end: np.ndarray, words: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Phrases of 2 to ``LONGEST`` words around the places of these windows, and their counts if at least ``least``."""
    n = left.astype(np.int64) + right + 1
    first = np.cumsum(n) - n
    numbers, ids, often = np.unique(words, return_inverse=True, return_counts=True)
    keep = often >= least
    numbers, ids = numbers[keep], np.where(keep, np.cumsum(keep) - 1, len(numbers))[ids]
    starts = np.zeros(len(words), bool)
    starts[first] = True
    maps = bitmaps(ids, starts, 0)
    word = np.repeat(np.arange(len(maps["blocks"])), maps["blocks"])
    known = word < len(numbers)  # what is too rare ends phrases
    begin = _masks(_spread(first, left.astype(np.int64) + 1), len(maps["starts"]))
    own = _masks(_spread(first + left + end, right.astype(np.int64) + 1 - end), len(maps["starts"]))
    miner = Miner(word[known], maps["block"][known], maps["bits"][known], maps["starts"], own, least)
    which, block, bits = miner.singles
    bits = bits & begin[block]
    some = np.flatnonzero(bits)
    for phrases, counts in miner.mine(np.arange(len(numbers))[:, None], which[some], block[some], bits[some], LONGEST):
        enough = counts >= least
        if enough.any():
            yield numbers[phrases[enough]].astype(np.int64), counts[enough]


def counted(rows: DataFrame, least: int) -> DataFrame:
    """``w1`` .. ``w5`` (null beyond the phrase), ``n``: the phrases of each part, only those with at least ``least`` occurrences if it is whole."""
    names = [x.split()[0] for x in _PHRASES.split(", ")]

    def run(part: pa.Table) -> pa.Table:
        codec, heads, words = _codec(), [], []
        for whole, n, size, data in zip(*(part[x].combine_chunks() for x in ("whole", "windows", "size", "data")), strict=True):
            n, size = n.as_py(), size.as_py()
            raw = np.frombuffer(codec.decompress(data.as_buffer(), n + 4 * size), np.uint8)
            heads.append(raw[:n])
            words.append(_unpacked(raw[n:]))
        head, words, enough = np.concatenate(heads), np.concatenate(words), least if whole.as_py() else 1
        out = []
        for x in passes(head // 25, head // 5 % 5, head % 5, words):
            for phrases, counts in mined(*x, enough):
                n = phrases.shape[1]
                out.append(pa.table([*(pa.array(phrases[:, k]) if k < n else pa.nulls(len(counts), pa.int64()) for k in range(LONGEST)), pa.array(counts)], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()) for _ in names], names=names)

    return rows.groupBy("part", "whole").applyInArrow(run, _PHRASES)


# ---------------------------------------------------------------- phrases of a corpus


def frequent_phrases(docs: DataFrame, text: str, lang: str, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (``id``, ``lang``, ``word``, ``f``) and phrases (``ids``, ``f``) with at least ``least`` occurrences, and ``lang``, ``n``: all occurrences of words.

    What shards have of a word meets once: a window adds it up and leaves it by shard, so that each shard gets its own frequent
    words, no more than it has positions. Words are numbered by falling ``f``. No join is broadcast, at any size, as all sides grow with the corpus.
    """
    table = scratch.write(shards(docs, text, lang), "shards")
    sizes = scratch.write(table.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    local = table.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("lang", "shard", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    same = Window.partitionBy("lang", "word")
    summed = local.withColumns({"f": F.sum("n").over(same), "first": F.min(F.col("shard") + F.col("place")).over(same)}).where(F.col("f") >= least)
    known = scratch.write(summed.select("lang", "shard", "place", "first", "f", F.when(F.col("first") == F.col("shard") + F.col("place"), F.col("word")).alias("word")), "known")
    words = numbered_words(known.where("word is not null").select("first", "lang", "word", "f"), scratch)
    lists = known.select("shard", "place", "first", "f").join(words.select("first", "id").hint("merge"), "first").groupBy("shard").agg(F.collect_list(F.struct("place", "id", "f")).alias("known"))
    bound = table.select("shard", "size", "context", "ids").join(lists.hint("merge"), "shard")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    ids = [f"w{i + 1}" for i in range(LONGEST)]
    told = counted(sent(bound, -(-total // PART) or 1), least).groupBy(*ids).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    phrases = scratch.write(told.select(F.array_compact(F.array(*ids)).alias("ids"), "f"), "phrases")
    scratch.drop("shards", "known")
    return words.drop("first"), phrases, sizes


def numbered_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``words`` with ``id``: 0, 1 ... from the most frequent to the rarest. Only a count for each partition comes to the driver."""
    order = [F.desc("f"), F.asc("first")]
    sorted_ = words.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.write(sorted_.withColumn("at", F.monotonically_increasing_id()), "words")
    part = F.shiftright("at", 33).cast("int")
    counts = dict(placed.groupBy(part).count().collect())
    before, n = [], 0
    for k in range(max(counts, default=0) + 1):
        before.append(n)
        n += counts.get(k, 0)
    return placed.withColumn("id", F.get(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), part) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at")


def score() -> Column:
    """floor(1000 a n / (l r)) in exact decimals: any a to 10 ** 15, n, l and r to 10 ** 16."""
    return F.expr("cast(1000 as decimal(4,0)) * (cast(a as decimal(15,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")


def collocations(docs: DataFrame, text: str, lang: str, *, least: int = 100, top: int = 2_000) -> DataFrame:
    """The ``top`` phrases of 2 to 5 words of each language by score: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A to Z are lower-cased; pieces end at ``.,;:!?`` and line breaks, words at spaces and tabs. ``a``: occurrences of the phrase,
    at least ``least``. Cut after k words its parts have ``l`` and ``r`` occurrences; the score is the least floor(1000 a n / (l r)) of the cuts, the
    first of equals. Phrases inside a longer one that is no rarer are dropped. Ranked by score and a, largest first, then by
    phrase (bytes). A null text is empty, a null language is ``und``; rows that repeat count again; an empty table has no phrases.
    """
    scratch = Scratch(docs.sparkSession)
    words, phrases, sizes = frequent_phrases(docs, text, lang, least, scratch)
    parts = phrases.unionByName(words.select(F.array("id").alias("ids"), "f"))
    size = F.size("ids")
    # a phrase inside a longer one that is no rarer is also inside one of one word more
    inner = phrases.where(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "f").distinct()
    kept = phrases.join(inner, ["ids", "f"], "left_anti")
    cuts = kept.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    left = parts.select(F.col("ids").alias("left"), F.col("f").alias("l"))
    right = parts.select(F.col("ids").alias("right"), F.col("f").alias("r"))
    cut = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, size)}).join(left, "left").join(right, "right")
    named = words.select(F.col("id"), "lang", "word")
    language = cut.join(named.select("id", "lang"), F.get("ids", F.lit(0)) == F.col("id")).drop("id").join(sizes, "lang")
    scored = language.withColumn("score", score())
    best = scored.groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelt = best.select("ids", F.posexplode("ids").alias("place", "id")).join(named.select("id", "word"), "id").groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    told = best.join(spelt, "ids").select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return told.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
