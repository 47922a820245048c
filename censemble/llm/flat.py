"""Texts of an Arrow batch as one byte buffer, cut up with numpy instead of loops over words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at once inside a batch; one longer text is a slice of its own.
# Hashing holds several 64-bit numbers for every byte, cutting into equal parts does not.
SLICE_BYTES = 1_000_000
CUT_BYTES = 3_000_000

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_IS_BARE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def sliced(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text, in order."""
    if not batch.num_rows:
        return
    _, at = flat(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def words(buffer: np.ndarray, at: np.ndarray, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every maximal run without white space, and the words before each text.

    ``bare``: ASCII marks part words as white space does.
    """
    if not len(buffer):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = (_IS_BARE if bare else _IS_WORD)[buffer]
    first = np.zeros(len(buffer) + 1, dtype=bool)
    first[at[:-1]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(seed: int) -> np.uint64:
    return np.uint64((seed * 0x9E3779B97F4A7C15 | 1) & (2**64 - 1))


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes at a time, scrambled after each.

    No sum over bytes or powers of a base: words of up to eight bytes and one length never collide,
    longer ones collide by chance only, and other seeds are independent. Words above ``_LONG_WORD``
    bytes, which are few, are digested by a library.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(buffer) + 8, dtype=np.uint8)
    padded[: len(buffer)] = _LOWER[buffer] if lower else buffer
    # Eight bytes from any place on, as one number.
    lanes = np.ndarray((len(buffer) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    key = _odd(seed)
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) + key)
        out = _absorbed(out, lanes[starts], size, key)
        some = np.flatnonzero((size > 8) & (size <= _LONG_WORD))
        at = starts[some] + 8
        while len(some):
            left = ends[some] - at
            out[some] = _absorbed(out[some], lanes[at], left, key)
            more = left > 8
            some, at = some[more], at[more] + 8
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        digest = hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8, key=bytes([seed % 256])).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


_LONG_WORD = 256
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def _absorbed(state: np.ndarray, lane: np.ndarray, left: np.ndarray, key: np.uint64) -> np.ndarray:
    """The state after at most eight more bytes; those past the word's end do not count."""
    return mix((state ^ (lane & _KEEP[np.minimum(left, 8)])) * key)


def windows(hashes: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, and the word at which each begins.

    A sum of the words' hashes, each times an unrelated odd factor of its place, then scrambled.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for factor, j in zip(mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1), range(width), strict=True):
            out += hashes[j : j + n] * factor
    text_end = np.repeat(before[1:], np.diff(before))[:n]
    whole = np.arange(n) + width <= text_end
    return mix(out[whole]), np.flatnonzero(whole)


def joined(buffer: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    kept = np.flatnonzero(keep)
    begins, stops = starts[kept], ends[kept]
    change = np.zeros(len(buffer) + 1, dtype=np.int8)
    change[begins] += 1
    change[stops] -= 1
    stay = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    out = buffer.copy()
    # A kept word that is not its text's first has a white space before it, which becomes the joint.
    doc = np.searchsorted(before, kept, side="right")
    joint = begins[1:][doc[1:] == doc[:-1]] - 1
    out[joint] = 0x20
    stay[joint] = True
    offsets = np.concatenate([[0], np.cumsum(stay)])[at]
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[stay]))


class Cache:
    """A bounded table of byte strings: when the young half is full, it replaces the old half."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], most: int) -> None:
        self.make, self.half = make, most // 2
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def look_up(self, keys: list[bytes]) -> list[bytes]:
        """The value of every key; those that are not at hand are made in one call."""
        young, old = self.young, self.old
        out = [young.get(k) for k in keys]
        new = []
        for i, value in enumerate(out):
            if value is None:
                value = old.get(keys[i])
                if value is None:
                    new.append(i)
                else:
                    out[i] = young[keys[i]] = value
        if new:
            for i, value in zip(new, self.make([keys[i] for i in new]), strict=True):
                out[i] = value
                if len(keys[i]) <= 256:
                    young[keys[i]] = value
        if len(young) > self.half:
            self.old, self.young = young, {}
        return out

    def clear(self) -> None:
        self.young, self.old = {}, {}
