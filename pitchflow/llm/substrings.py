"""Substring dedup: recurring passages are confirmed, compiled into Aho-Corasick automata and located.

1. Scout. Of each window's 8-word grams the one with the least hash is its anchor, so equal
   windows have equal anchors. Anchors that occur once in the corpus belong to windows that occur
   once; the others are marked in their documents.
2. Deal. Around each mark the words of the windows that it anchors (a span) are cut out and dealt
   to shards by anchor, so a shard gets every window of its anchors from all documents. A task
   sends the words of equal spans once; its other places go by the span's 128-bit hash.
3. Confirm and locate. The windows that stand at several places are the shard's passages. They
   become an automaton over word numbers, all spans are streamed through it, and each hit
   is an occurrence. A place of a span has the occurrences of its words; all but a passage's
   first are windows to remove.
4. Remove. The found windows go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchflow.llm.tables import LAST, key_name, materialize, order_of, row_id

WINDOW = 20
GRAM = 8
#: Rows kept per task before it sums up what it has.
HELD_ROWS = 4_000_000
#: Bytes of distinct spans kept per task before they are handed on.
HELD_BYTES = 64 << 20
#: Words that are dealt with at once, whole anchors only, and windows that one automaton may hold:
#: of anchors with more the windows are taken by hash in several passes.
SHARD_WORDS = 150_000
PASS_WINDOWS = 60_000
#: Anchors with more than one in so many of all occurrences, at most this many, are split by window.
HOT_PART = 2_000
HOT_LEAST = 256
#: Words hashed at once.
CHUNK = 200_000

# ---------------------------------------------------------------- hashes of word sequences


class _Powers:
    """Random values of bytes, and powers of an odd number and of its inverse, modulo 2**64."""

    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self):
        self.of_byte = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            for name, x in (("up", self.base), ("down", self.inverse)):
                steps = np.full(2 * n, x, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


_powers = _Powers()


def gram_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words of space-joined words."""
    data = np.frombuffer(joined, np.uint8)
    _powers.grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_powers.of_byte[data] * _powers.up[: len(data)], out=sums[1:])
    a, b = starts[: len(starts) - k + 1], ends[k - 1 :]
    h = (sums[b] - sums[a]) * _powers.down[a]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    step, low = 1, values
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[: len(low) - (width - step)], low[width - step :]) if step < width else low


class Words:
    """Words of several documents (or parts of one), one after another, and the anchors of their windows."""

    def __init__(self, parts: list[list[bytes]], window: int = WINDOW, gram: int = GRAM):
        self.joined = b" ".join([b" ".join(p) for p in parts])
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        lengths = np.fromiter((len(w) for p in parts for w in p), np.int64, int(n.sum()))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.first = np.cumsum(n) - n
        self.window = window
        good = np.concatenate([np.arange(f, f + m - window + 1) for f, m in zip(self.first.tolist(), n.tolist(), strict=True)] or [np.zeros(0, np.int64)])
        if not len(good):
            self.anchor = self.low = self.high = self.part = np.zeros(0, np.int64)
            self.value = np.zeros(0, np.int64)
            return
        h = gram_hashes(self.joined, self.starts, self.ends, gram)
        width = window - gram + 1
        least = sliding_min(h, width)[good]
        owner = np.full(len(good), -1)
        for d in range(width - 1, -1, -1):  # the leftmost of equal ones stays
            owner = np.where(h[good + d] == least, good + d, owner)
        new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        #: Of each anchor: its word, its hash, the first and last window that it anchors, its document.
        self.anchor, self.low = owner[new], good[new]
        self.high = good[np.concatenate((new[1:], [len(good)])) - 1]
        self.value = h[self.anchor].view(np.int64)
        self.part = np.searchsorted(self.first, self.low, "right") - 1

    def span(self, low: int, high: int) -> bytes:
        """The words of the windows from ``low`` to ``high``."""
        return self.joined[self.starts[low] : self.ends[high + self.window - 1]]


def chunked(texts: pa.Array, wanted: np.ndarray) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """Words of the wanted texts, with the row and the first word of each part; long texts go in overlapping parts."""
    parts: list[list[bytes]] = []
    rows: list[int] = []
    begins: list[int] = []
    held = 0
    for row in wanted.tolist():
        words = (texts[row].as_py() or b"").split()
        for at in range(0, max(len(words) - WINDOW + 1, 0), CHUNK):
            part = words[at : at + CHUNK + WINDOW - 1]
            parts.append(part)
            rows.append(row)
            begins.append(at)
            held += len(part)
            if held >= CHUNK:
                yield Words(parts), np.asarray(rows), np.asarray(begins)
                parts, rows, begins, held = [], [], [], 0
    if parts:
        yield Words(parts), np.asarray(rows), np.asarray(begins)


# ---------------------------------------------------------------- 1. scout


def _scout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, text -> anchors. Those that a task meets more than once are known to recur: each becomes a
    mark at once, and one row with the count stands for all of them."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def summed() -> pa.RecordBatch:
        value, uid, at = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(value, kind="stable")
        value, uid, at = value[order], uid[order], at[order]
        starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        count = np.diff(np.concatenate((starts, [len(value)])))
        many = np.repeat(count > 1, count)
        lone, group = ~many, starts[count > 1]
        spread = value ^ (uid * np.int64(0x2545F491) + at * np.int64(0x9E3779B1))
        columns = [
            np.concatenate((value[lone], value[group], spread[many])),
            np.concatenate((value[lone], value[group], value[many])),
            np.concatenate((uid[lone], uid[group], uid[many])),
            np.concatenate((at[lone], at[group], at[many])),
            np.concatenate((np.ones(lone.sum(), np.int64), count[count > 1], np.zeros(many.sum(), np.int64))),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["spread", "value", "uid", "at", "n"])

    for batch in batches:
        uids = batch.column(0).to_numpy()
        for words, rows, begins in chunked(batch.column(1), np.arange(batch.num_rows)):
            held.append((words.value, uids[rows[words.part]], words.anchor - words.first[words.part] + begins[words.part]))
        if sum(len(x[0]) for x in held) >= HELD_ROWS:
            yield summed()
    if held:
        yield summed()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors ordered by value -> marks (n null), frequent anchors (uid null), the number of anchors (both)."""
    held: list[np.ndarray] = []
    total = 0
    for columns, last in _then_end(batches):
        if columns:
            known = columns[3] == 0
            if known.any():
                yield _mark_batch(columns[1][known], columns[2][known])
            columns = [c[~known] for c in columns]
        if held:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)] if columns else held
        if not columns or not len(columns[0]):
            held = []
            continue
        value, uid, at, n = columns
        starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        end = len(value) if last else int(starts[-1])
        held = [c[end:] for c in columns]
        starts = starts[starts < end]
        if not len(starts):
            continue
        sums = np.add.reduceat(n[:end], starts)
        total += int(sums.sum())
        again = (np.repeat(sums, np.diff(np.concatenate((starts, [end])))) > 1) & (n[:end] == 1)
        yield _mark_batch(uid[:end][again], at[:end][again])
        often = sums >= HOT_LEAST
        if often.any():
            yield _mark_batch(None, value[starts[often]], sums[often])
    if total:
        yield _mark_batch(None, None, np.asarray([total]))


def _mark_batch(uid: np.ndarray | None, at: np.ndarray | None, n: np.ndarray | None = None) -> pa.RecordBatch:
    size = len(next(x for x in (uid, at, n) if x is not None))
    return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if x is None else pa.array(x) for x in (uid, at, n)], names=["uid", "at", "n"])


def _then_end(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], bool]]:
    for batch in batches:
        if batch.num_rows:
            yield [c.to_numpy(zero_copy_only=False) for c in batch.columns], False
    yield [], True


# ---------------------------------------------------------------- 2. spans of marked anchors

_SPAN = pa.schema([("shard", pa.int64()), ("doc", pa.int64()), ("uid", pa.int64()), ("low", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("many", pa.bool_()), ("span", pa.binary())])


def _halves(spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit hash of each span as two signed numbers."""
    both = np.frombuffer(b"".join(map(xxhash.xxh128_digest, spans)), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _spans(batches: Iterator[pa.RecordBatch], hot: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """uid, doc, text, marks -> spans, the words of each distinct one once a task, at its earliest place there.

    The later places of a span within the task have its hash in place of the words (and a shard
    that only spreads them). Spans of hot anchors are cut into their single windows,
    which go by their own hash.
    """
    first: dict[bytes, tuple[int, int, int, int]] = {}
    later: list[tuple[bytes, int, int, int]] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if first:
            spans, many = list(first), {x[0] for x in later}
            columns = [pa.array(x, pa.int64()) for x in zip(*first.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, _halves(spans)), pa.array([x in many for x in spans]), pa.array(spans, pa.binary())], schema=_SPAN)
        if later:
            doc, uid, low = (np.asarray(x, np.int64) for x in zip(*(x[1:] for x in later), strict=True))
            spread = -1 - ((uid * np.int64(0x2545F491) + low * np.int64(0x9E3779B1)) & np.int64(LAST >> 1))
            h1, h2 = _halves([x[0] for x in later])
            yield pa.RecordBatch.from_arrays([*map(pa.array, (spread, doc, uid, low, h1, h2)), pa.nulls(len(low), pa.bool_()), pa.nulls(len(low), pa.binary())], schema=_SPAN)
        first.clear()
        later.clear()
        size = 0

    def add(span: bytes, shard: int, doc: int, uid: int, low: int) -> None:
        nonlocal size
        found = first.get(span)
        if found is None:
            first[span] = (shard, doc, uid, low)
            size += len(span)
        elif (doc, uid, low) < found[1:]:
            first[span] = (shard, doc, uid, low)
            later.append((span, *found[1:]))
        elif (doc, uid, low) > found[1:]:
            later.append((span, doc, uid, low))

    for batch in batches:
        uids, docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        for words, rows, begins in chunked(batch.column(2), np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False))):
            place = words.anchor - words.first[words.part] + begins[words.part]
            for part, row in enumerate(rows.tolist()):
                a, b = np.searchsorted(words.part, [part, part + 1])
                mine = np.asarray(marks[row].values.to_numpy(zero_copy_only=False))
                shift = int(begins[part] - words.first[part])
                doc, uid = int(docs[row]), int(uids[row])
                for i in (np.flatnonzero(np.isin(place[a:b], mine)) + a).tolist():
                    low, high, value = int(words.low[i]), int(words.high[i]), int(words.value[i])
                    if value in hot:
                        for s in range(low, high + 1):
                            window = words.span(s, s)
                            add(window, xxhash.xxh64_intdigest(window) >> 1, doc, uid, s + shift)
                    else:
                        add(words.span(low, high), value & LAST, doc, uid, low + shift)
            if size >= HELD_BYTES or len(later) >= HELD_ROWS:
                yield from out()
    yield from out()


# ---------------------------------------------------------------- 3. confirm and locate


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _numbered(spans: list[bytes]) -> list[tuple[int, ...]]:
    number = _Numbers().__getitem__
    return [tuple(map(number, s.split(b" "))) for s in spans]


def occurrences(texts: list[tuple[int, ...]], repeated: list[bool], limit: int = PASS_WINDOWS) -> Iterator[list[tuple[int, int, int]]]:
    """text, offset, passage of every occurrence of a passage, one list for each pass.

    Passages are the windows that stand in several texts or in one that is ``repeated``.
    """
    passes = max(1, -(-sum(len(t) - WINDOW + 1 for t in texts) // limit))
    for number in range(passes):
        windows: dict[tuple[int, ...], int] = {}  # each with the place in the order of all at which it came first
        recurring: set[int] = set()
        seen = 0
        for words, again in zip(texts, repeated, strict=True):
            for i in range(len(words) - WINDOW + 1):
                window = words[i : i + WINDOW]
                if passes == 1 or hash(window) % passes == number:
                    first = windows.setdefault(window, seen)
                    if again or first != seen:
                        recurring.add(first)
                    seen += 1
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        passage = 0
        for window, first in windows.items():
            if first in recurring:
                automaton.add_word(window, passage)
                passage += 1
        del windows, recurring
        if passage:
            automaton.make_automaton()
            yield [(t, end + 1 - WINDOW, found) for t, words in enumerate(texts) for end, found in automaton.iter(words)]


def _runs(offsets: list[int]) -> list[tuple[int, int]]:
    """Offsets as runs: first, number."""
    out: list[tuple[int, int]] = []
    for o in sorted(offsets):
        if out and o == out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((o, 1))
    return out


_FOUND = pa.schema([("uid", pa.int64()), ("low", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("runs", pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])))])


def locate(spans: list[bytes], places: list[tuple[int, int, int]], many: list[bool], h1: list[int], h2: list[int]) -> list[tuple]:
    """Rows of ``_FOUND`` for whole anchors: the windows to remove at each given place (doc, uid, low), and, without
    a place, all occurrences in each span that has more places than those given."""
    groups: dict[bytes, list[int]] = {}
    for i, span in enumerate(spans):
        groups.setdefault(span, []).append(i)
    texts, members = _numbered(list(groups)), list(groups.values())
    more = [any(many[i] for i in group) for group in members]
    first = [min(places[i] for i in group) for group in members]
    everywhere: dict[int, list[int]] = {}
    gone: dict[int, list[int]] = {}
    for hits in occurrences(texts, [len(g) > 1 or m for g, m in zip(members, more, strict=True)]):
        earliest: dict[int, tuple[int, int, int]] = {}
        for t, offset, passage in hits:
            doc, uid, low = first[t]
            place = (doc, uid, low + offset)
            if passage not in earliest or place < earliest[passage]:
                earliest[passage] = place
        for t, offset, passage in hits:
            if more[t]:
                everywhere.setdefault(t, []).append(offset)
            for i in members[t]:
                doc, uid, low = places[i]
                if (doc, uid, low + offset) > earliest[passage]:
                    gone.setdefault(i, []).append(offset)
    out = [(places[i][1], places[i][2], None, None, _runs(offsets)) for i, offsets in gone.items()]
    return out + [(None, None, h1[members[t][0]], h2[members[t][0]], _runs(offsets)) for t, offsets in everywhere.items()]


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by shard; each automaton is made from whole anchors. Rows without words pass through."""
    held: list[pa.RecordBatch] = []

    def done(table: pa.Table) -> pa.RecordBatch:
        places = list(zip(*(table.column(i).to_pylist() for i in (1, 2, 3)), strict=True))
        found = locate(table.column(7).to_pylist(), places, table.column(6).to_pylist(), table.column(4).to_pylist(), table.column(5).to_pylist())
        uid, low, h1, h2, runs = zip(*found, strict=True) if found else ((),) * 5
        runs = [[{"at": a, "n": n} for a, n in r] for r in runs]
        return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip((uid, low, h1, h2, runs), _FOUND, strict=True)], schema=_FOUND)

    for batch in batches:
        later = batch.filter(batch.column(7).is_null())
        if later.num_rows:
            yield pa.RecordBatch.from_arrays([*(later.column(i) for i in (2, 3, 4, 5)), pa.nulls(later.num_rows, _FOUND.field("runs").type)], schema=_FOUND)
        batch = batch.filter(batch.column(7).is_valid())
        step = max(1, SHARD_WORDS // (WINDOW + GRAM))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            if sum(x.num_rows for x in held) < step:
                continue
            table = pa.Table.from_batches(held)
            shard = table.column(0).to_numpy()
            end = int(np.searchsorted(shard, shard[-1]))  # the last anchor may go on
            if end:
                yield done(table.slice(0, end))
                held = table.slice(end).to_batches()
    if held:
        yield done(pa.Table.from_batches(held))


# ---------------------------------------------------------------- 4. remove


def kept_words(text: bytes | None, windows: list[dict] | None) -> tuple[int, list[bytes]]:
    """Number of words, and the words that no given run of windows covers."""
    words = (text or b"").split()
    if not windows:
        return len(words), words
    edge = np.zeros(len(words) + 1, np.int64)
    for w in windows:
        edge[min(w["low"], len(words))] += 1
        edge[min(w["low"] + w["n"] + WINDOW - 1, len(words))] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return len(words), [w for w, c in zip(words, covered.tolist(), strict=True) if not c]


def _remove(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, digests, texts = [], [], [], []
        for text, windows in zip(batch.column(1), batch.column(2), strict=True):
            n, kept = kept_words(text.as_py(), windows.as_py())
            joined = b" ".join(kept)
            counts.append(n)
            removed.append(n - len(kept))
            digests.append(hashlib.sha256(joined).hexdigest())
            texts.append(joined if with_text else None)
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        if with_text:
            columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(columns)])


def substring_dedup(df: DataFrame, key: str, text: str, *, with_text: bool = False) -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_words``, ``n_removed``, ``kept_sha256`` [, ``kept_text``].

    Removes each word that is covered by 20 consecutive words which also start earlier: in a
    document with a smaller key, or earlier in the same one. Kept words are joined by one space.

    A null text has no words. A null key counts as larger than all others. Rows with one key, or
    none, and different texts are documents of their own, in an order that their texts decide. Rows
    that repeat key and text do not count as each other's earlier copy.
    An empty table gives no rows. ``key`` must be a whole number; other columns are not read. A key named like a new column gets an
    underscore in front.
    """
    base = df.select(row_id(key, text).alias("uid"), order_of(key).alias("doc"), F.col(text).cast("binary").alias("text"))
    anchors = base.select("uid", "text").mapInArrow(_scout, "spread long, value long, uid long, at long, n long")
    met = anchors.repartition("spread").sortWithinPartitions("value").select("value", "uid", "at", "n")
    found = materialize(met.mapInArrow(_marks, "uid long, at long, n long"), "anchors")

    # at most HOT_PART anchors can have more than one in HOT_PART of all occurrences
    total = found.where("uid is null and at is null").agg(F.sum("n")).first()[0] or 0
    often = found.where("uid is null and at is not null").where(F.col("n") > max(HOT_LEAST, total // HOT_PART))
    hot = frozenset(r["at"] for r in often.collect())

    marks = found.where("uid is not null").groupBy("uid").agg(F.collect_set("at").alias("marks"))
    marked = base.join(marks, "uid", "left").select("uid", "doc", "text", "marks")
    spans = marked.mapInArrow(lambda it: _spans(it, hot), "shard long, doc long, uid long, low long, h1 long, h2 long, many boolean, span binary")
    located = spans.repartition("shard").sortWithinPartitions("shard").mapInArrow(_locate, "uid long, low long, h1 long, h2 long, runs array<struct<at:long,n:long>>")
    located = materialize(located, "located")
    # a place that went by its span's hash has the occurrences of the span; both sides are read from a table, so AQE can split a hot span
    at_hash = located.where("runs is null").select("uid", "low", "h1", "h2").join(located.where("uid is null").select("h1", "h2", "runs"), ["h1", "h2"])
    runs = located.where("uid is not null and runs is not null").select("uid", "low", "runs").unionByName(at_hash.select("uid", "low", "runs"))
    windows = runs.select("uid", F.explode(F.transform("runs", lambda r: F.struct((F.col("low") + r["at"]).alias("low"), r["n"].alias("n")))).alias("w"))
    removed = windows.groupBy("uid").agg(F.collect_set("w").alias("windows"))
    fields = "doc long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    out = base.join(removed, "uid", "left").select(F.when(F.col("uid") < 0, F.col("doc")).alias("doc"), "text", "windows").mapInArrow(lambda it: _remove(it, with_text), fields)
    kind = df.schema[key].dataType.simpleString()
    return out.withColumn("doc", F.col("doc").cast(kind)).withColumnRenamed("doc", key_name(key, "n_words", "n_removed", "kept_sha256", "kept_text"))
