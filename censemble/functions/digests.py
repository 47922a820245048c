"""md5 of many short numbered labels at once, in numpy: a call per label costs far more than the digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_TURNS = [t for four in ([7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]) for t in four * 4]
_SINES = [int(abs(np.sin(i + 1)) * (1 << 32)) for i in range(64)]
_PLACES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else (7 * i) % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = (1 << 32) - 1
# The longest text of one md5 block, and the labels that are worked on at once: few enough for a core's own cache.
_BLOCK, _AT_ONCE = 55, 1 << 14


def _one_block(same: list[int], varying: dict[int, np.ndarray], count: int) -> list[np.ndarray]:
    """md5 of padded texts of one block, as four rows of words, a column per text.

    ``same``: the 16 little-endian words that all texts share; ``varying``: those that differ, by their place.
    """
    a, b, c, d = _START
    # Until the first word that differs, all texts are in the same state.
    begin = min(varying)
    for i in range(begin):
        f = ((d ^ (b & (c ^ d))) + a + same[i] + _SINES[i]) & _MASK
        f = (f << _TURNS[i] | f >> (32 - _TURNS[i])) & _MASK
        a, b, c, d = d, (f + b) & _MASK, b, c
    a, b, c, d = (np.full(count, x, np.uint32) for x in (a, b, c, d))
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(begin, 64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        place = _PLACES[i]
        if place in varying:
            f += varying[place]
        f += np.uint32((_SINES[i] + (0 if place in varying else same[place])) & _MASK)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=g)
        f <<= np.uint32(_TURNS[i])
        f |= g
        f += b
        # The old a is free for the next round.
        a, b, c, d, f = d, f, b, c, a
    return [x + np.uint32(s) for x, s in zip((a, b, c, d), _START)]


class Numbers:
    """The numbers from ``low`` to below ``high``, all of one length, as the ends of labels."""

    def __init__(self, low: int, high: int) -> None:
        self.low, self.high, self._digits = low, high, len(str(low))
        self._ends: dict[int, dict[int, np.ndarray]] = {}

    def _words(self, at: int) -> dict[int, np.ndarray]:
        """The words with the digits and the bit after them, by their place, if the digits begin at byte ``at``."""
        if at not in self._ends:
            first, last = at // 4, (at + self._digits) // 4
            text = np.zeros((self.high - self.low, (last - first + 1) * 4), np.uint8)
            rest = np.arange(self.low, self.high, dtype=np.uint64 if self.high >> 32 else np.uint32)
            begin = at - first * 4
            for place in range(begin + self._digits - 1, begin - 1, -1):
                rest, digit = np.divmod(rest, rest.dtype.type(10))
                text[:, place] = digit + ord("0")
            text[:, begin + self._digits] = 0x80
            self._ends[at] = dict(enumerate(np.ascontiguousarray(text.view("<u4").T), first))
        return self._ends[at]

    def digests(self, prefix: bytes) -> list[np.ndarray]:
        """The digests of prefix + number, as four rows of little-endian words; digits are laid out once for all prefixes."""
        length = len(prefix) + self._digits
        if length > _BLOCK:
            joined = b"".join([hashlib.md5(prefix + b"%d" % n).digest() for n in range(self.low, self.high)])
            return list(np.frombuffer(joined, "<u4").reshape(-1, 4).T)
        text = prefix.ljust(56, b"\0") + (length * 8).to_bytes(8, "little")
        same = np.frombuffer(text, "<u4").tolist()
        varying = {place: word | np.uint32(same[place]) for place, word in self._words(len(prefix)).items()}
        return _one_block(same, varying, self.high - self.low)


def numbers(low: int, high: int) -> Iterator[Numbers]:
    """The numbers from low to below high, in pieces."""
    while low < high:
        end = min(high, 10 ** len(str(low)), low + _AT_ONCE)
        yield Numbers(low, end)
        low = end


def numbered_digests(prefix: bytes, low: int, high: int) -> bytes:
    """The digests of prefix + number for the numbers from low to below high, one after another."""
    return b"".join(np.stack(n.digests(prefix), axis=1).astype("<u4").tobytes() for n in numbers(low, high))
