"""Token counts by heap-and-linked-list byte-pair merging.

A piece of n symbols loses one symbol with each merge, so its tokens are n minus the merges; no
token identifiers are looked up or emitted. Adjacent pairs wait in a heap by rank, symbols in a
doubly linked list; the lowest rank (leftmost first) is popped again and again. That is
n log n for a piece of any length.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchflow.llm.pieces import Parts
from pitchflow.llm.tables import fresh

def byte_letters() -> list[str]:
    """The letter that the vocabulary file writes for each byte: printable ones stand for themselves."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Counter:
    """Counts tokens as the byte-level BPE of a tokenizer file gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer is needed")
        self.prefix = spec["pre_tokenizer"].get("add_prefix_space", False)
        number: dict[str, int] = {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        for letter in byte_letters():
            number.setdefault(letter, len(number))
        for a, b in merges:
            for symbol in (a, b, a + b):
                number.setdefault(symbol, len(number))
        #: Rank and result of each pair of symbols; symbols are numbers of our own, the bytes first.
        self.merge = {(number[a], number[b]): (rank, number[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.parts = Parts(lambda some: [self.count_piece(p.encode("utf-8", "surrogatepass")) for p in some], sum)

    def count_piece(self, piece: bytes) -> int:
        """Initial symbols minus merges of one piece."""
        symbol = list(piece)
        n = len(symbol)
        if n < 2:
            return n
        merge = self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[0], i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (rank := merge.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if symbol[i] == a else n
            if j >= n or symbol[j] != b or symbol[i] != a:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = merge[a, b][1], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if rank := merge.get((symbol[i], symbol[k])):
                    heapq.heappush(heap, (rank[0], i, symbol[i], symbol[k]))
            h = before[i]
            if h >= 0 and (rank := merge.get((symbol[h], symbol[i]))):
                heapq.heappush(heap, (rank[0], h, symbol[h], symbol[i]))
        return left

    def count_run(self, text: str) -> int:
        """Tokens of a text in which special strings are not looked for."""
        if self.prefix and text and not text[0].isspace():
            text = " " + text
        return self.parts(text)

    def count(self, text: str | None) -> int:
        """Tokens of a text; each special string in it is one."""
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.count_run(text)
        return sum(map(self.count_run, self.special.split(text))) + len(self.special.findall(text))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker, which Spark uses for many tasks."""
    return Counter(path)


def token_counts(df: DataFrame, text: str, tokenizer: str, *, limit: int = 512) -> DataFrame:
    """``df`` without ``text``, with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    ``tokenizer`` is the path of a byte-level BPE ``tokenizers`` file, present on every machine.
    Rows stay in their partitions, nothing is shuffled, and whole texts are counted. A null text
    counts as empty (0 and 0); repeated rows give repeated rows; an empty table gives none;
    columns of ``df`` named like the new ones are replaced.
    """
    rows = fresh(df, "n_bytes", "n_tokens", "over_limit")
    others = [c for c in rows.columns if c != text]
    rows = rows.select(*[F.col(f"`{c}`") for c in others], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = pa.array([count(x.as_py()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=batch.schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "n_tokens")
    return rows.mapInArrow(run, f"{fields}, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
