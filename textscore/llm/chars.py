"""Text as arrays of code points: runs of characters, their hashes, and an index of hashes.

The operators that look at every word of every text use these arrays instead of Python
strings: a chunk of texts becomes one array, its words become (start, end) pairs, and a
word's hash comes from prefix sums. Only words not seen before become strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import regex

LETTER, DIGIT, SPACE, OTHER, END = range(5)
#: Code points worked on at once; longer texts are cut where white space follows a word.
CHUNK = 1 << 18
_AFTER_WORD = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def chunks(texts: Iterable[str | None], size: int = CHUNK) -> Iterator[tuple[list[int], list[str]]]:
    """(row numbers, pieces) holding about ``size`` code points each.

    A text longer than ``size`` gives several pieces in order, cut before a white-space
    character that follows another one, so that no word is cut. NULL counts as empty.
    """
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        for piece in _pieces(text or "", size):
            rows.append(row)
            parts.append(piece)
            held += len(piece) + 1
            if held >= size:
                yield rows, parts
                rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


def _pieces(text: str, size: int) -> Iterator[str]:
    start = 0
    while len(text) - start > size:
        found = _AFTER_WORD.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


class Alphabet:
    """Class, lower-case form and hash value of each code point, looked up once per code point."""

    def __init__(self) -> None:
        self.kind = np.full(0x110000, 255, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self._powers = np.ones(1, np.uint64)
        self._inverses = np.ones(1, np.uint64)

    def _learn(self, points: np.ndarray) -> None:
        for point in np.unique(points).tolist():
            char = chr(point)
            if regex.match(r"\p{L}", char):
                kind = LETTER
            elif regex.match(r"\p{N}", char):
                kind = DIGIT
            elif regex.match(r"\p{White_Space}", char):
                kind = SPACE
            else:
                kind = OTHER
            self.kind[point] = kind
            self.lower[point] = ord(char.lower()[0])

    def read(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points, kinds, end positions); each part is followed by one END place."""
        points = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kind[points]
        new = kinds == 255
        if new.any():
            self._learn(points[new])
            kinds = self.kind[points]
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        kinds[ends] = END
        return points, kinds, ends

    def hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span, equal for equal spans wherever they stand; never 0.

        A polynomial of the mixed code points modulo 2**64, finally mixed with the length.
        """
        if len(self._powers) <= len(points):
            size = 2 * len(points) + 1
            self._powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE)]), dtype=np.uint64)
            self._inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE)]), dtype=np.uint64)
        mixed = mix(points.astype(np.uint64) + np.uint64(1))
        mixed *= self._powers[: len(points)]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
        value = (sums[ends] - sums[starts]) * self._inverses[starts]
        value = mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        value[value == 0] = 1
        return value


def mix(value: np.ndarray) -> np.ndarray:
    """A mixing step on 64-bit values: every input bit reaches every output bit."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def runs(kinds: np.ndarray, wanted: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of characters whose kind is wanted."""
    inside = np.zeros(len(kinds) + 2, np.int8)
    inside[1:-1] = np.isin(kinds, wanted) if len(wanted) > 1 else kinds == wanted[0]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def counts_per_part(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many spans lie in each part, given the parts' END places."""
    return np.diff(np.searchsorted(starts, ends), prepend=0)


class HashIndex:
    """Numbers 64-bit hashes in the order in which they are added; open addressing in arrays."""

    def __init__(self, bits: int = 17) -> None:
        self.size = 0
        self._bits = bits
        self._keys = np.zeros(1 << bits, np.uint64)
        self._numbers = np.zeros(1 << bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        mask = len(self._keys) - 1
        slots = self._slots(keys)
        held = self._keys[slots]
        out = np.where(held == keys, self._numbers[slots], -1)
        open_ = np.flatnonzero((held != keys) & (held != 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & mask
            held = self._keys[slots[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self._numbers[slots[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number keys that are distinct and not in the index yet."""
        while 2 * (self.size + len(keys)) > len(self._keys):
            old, numbers = self._keys, self._numbers
            self._bits += 1
            self._keys, self._numbers = np.zeros(1 << self._bits, np.uint64), np.zeros(1 << self._bits, np.int64)
            self._place(old[old != 0], numbers[old != 0])
        self._place(keys, np.arange(self.size, self.size + len(keys)))
        self.size += len(keys)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = len(self._keys) - 1
        slots = self._slots(keys)
        while len(keys):
            free = self._keys[slots] == 0
            self._keys[slots[free]] = keys[free]
            own = free & (self._keys[slots] == keys)
            self._numbers[slots[own]] = numbers[own]
            keys, numbers, slots = keys[~own], numbers[~own], (slots[~own] + 1) & mask


class Memo:
    """What was worked out for each distinct span: numbers spans by hash, asks for new ones only.

    ``limit`` bounds the entries kept; beyond it the memo starts afresh, which costs time, not results.
    """

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.index = HashIndex()

    def full(self) -> bool:
        return self.index.size >= self.limit

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each span, places of one span for each number given out just now, in order)."""
        found = self.index.find(hashes)
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found, missing
        keys, first = np.unique(hashes[missing], return_index=True)
        self.index.add(keys)
        found[missing] = self.index.find(hashes[missing])
        return found, missing[first]
