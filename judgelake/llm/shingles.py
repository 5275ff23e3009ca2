"""Word shingles of whole texts as sorted 64-bit hashes, computed a batch at a time with NumPy.

Words are maximal runs of characters other than U+0020 and U+0009..U+000D, after lower-casing A-Z.
A document's set holds the distinct runs of five words; a document of one to four words has its whole
word sequence as its only shingle; an empty or null text has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WORDS = 5
#: Bytes of text hashed at once; a longer text is hashed alone and whole.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table() -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    for upper in range(ord("A"), ord("Z") + 1):
        table[upper] = table[upper + 32]
    return table


_BYTES = _byte_table()
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            step = np.full(size, _BASE, dtype=np.uint64)
            back = np.full(size, _INVERSE, dtype=np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a byte string and the places where they start."""
    raw = np.frombuffer(joined, dtype=np.uint8)
    space = np.concatenate(([True], _IS_SPACE[raw], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start
    up, down = _powers.to(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[raw] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start]), start


def _chunks(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > CHUNK:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


def shingle_sets(texts: Iterable[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes (uint64) of its shingles; an empty array without words."""
    for chunk in _chunks(texts):
        hashes, starts = word_hashes(b" ".join(chunk))
        ends = np.cumsum([len(data) + 1 for data in chunk])
        bound = np.searchsorted(starts, ends)
        full = np.zeros(0, dtype=np.uint64)
        if len(hashes) >= words:
            full = hashes[: len(hashes) - words + 1].copy()
            for k in range(1, words):
                full = mix(full * np.uint64(3) + hashes[k : len(hashes) - words + 1 + k])
        first = 0
        for last in bound:
            n = last - first
            if n >= words:
                found = np.sort(full[first : last - words + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif n:
                one = hashes[first : first + 1] + np.uint64(n)
                for k in range(1, n):
                    one = mix(one * np.uint64(3) + hashes[first + k : first + k + 1])
                yield mix(one ^ np.uint64(0x5851F42D4C957F2D))
            else:
                yield np.zeros(0, dtype=np.uint64)
            first = last
