"""Cuts texts where a byte-level BPE tokenizer never merges across, and remembers the results of the parts.

The pre-tokenizer cuts a text into pieces (mostly words with the space before them), and merges
never cross pieces. A new piece starts at each space that stands between two characters that are
not white space, so texts are first cut there, which is cheap, into chunks. Natural text repeats
its chunks all the time; a chunk that is not known yet is cut into pieces, which repeat even more.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import compress, repeat
from operator import is_

import regex

# The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts looked up at once.
STEP = 100_000
#: A space next to other white space: there the text is not cut. (Python's \s holds all of the pattern's \s.)
_GLUED = re.compile(r"\s | \s|^ | $")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_pieces = regex.compile(PATTERN).findall


def chunks(text: str) -> list[str]:
    """Chunks of ``text`` without the space in front of all but the first."""
    return _CUT.split(text) if _GLUED.search(text) else text.split(" ")


class Remembered[T]:
    """Results of a function of strings, in two generations of about ``limit`` each.

    When the younger is full it becomes the older, whose entries are lost unless used again; so
    memory is bounded and what is frequent stays. Long strings are not kept.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable[T]], limit: int = 400_000, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.young: dict[str, T] = {}
        self.old: dict[str, T] = {}

    def __call__(self, parts: list[str]) -> Iterator[T]:
        for at in range(0, len(parts), STEP):
            yield from self._some(parts[at : at + STEP])

    def _some(self, parts: list[str]) -> list[T]:
        out = list(map(self.young.get, parts))
        if None not in out:
            return out
        missing = set(compress(parts, map(is_, out, repeat(None))))
        if len(self.young) + len(missing) > self.limit:
            self.old, self.young, missing = self.young, {}, set(parts)
        known = {p: self.old[p] for p in missing if p in self.old}
        new = list(missing.difference(known))
        self.young.update(known)
        self.young.update(zip(new, self.compute(new), strict=True))
        out = list(map(self.young.__getitem__, parts))
        for p in new:
            if len(p) > self.longest:
                del self.young[p]
        return out


class Parts[T]:
    """Results of a text from those of its pieces: ``compute`` gives them for pieces, ``join`` puts them together."""

    def __init__(self, compute: Callable[[list[str]], Iterable[T]], join: Callable[[Iterable[T]], T]):
        self.join = join
        self.pieces = Remembered(compute)
        self.spaced = Remembered(self._chunks)

    def _chunks(self, some: list[str]) -> Iterator[T]:
        """Results of chunks with a space in front; the pieces of all of them are looked up together."""
        cut = [_pieces(" " + c) for c in some]
        found = self.pieces([p for ps in cut for p in ps])
        for ps in cut:
            yield self.join([next(found) for _ in ps])

    def __call__(self, text: str) -> T:
        first, *rest = chunks(text)
        return self.join([*self.pieces(_pieces(first)), *self.spaced(rest)])
