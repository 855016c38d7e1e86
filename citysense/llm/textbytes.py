"""Vectorised word handling on the UTF-8 bytes of Arrow string columns.

Workers get texts as Arrow arrays, whose characters lie in one byte buffer.
Words, lines and n-grams are found there with numpy over a few megabytes at a
time, so no Python loop runs per word and memory follows the slice, not the
batch. A word is known by a 64-bit hash of its bytes; n-grams by a fold of the
hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_U = np.uint64
_BASE = _U(0xD6E8FEB86659FD93)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_FOLD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the public splitmix64 finaliser); one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def fold(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its start and that of its next word."""
    return mix(left * _FOLD + right)


class Runs:
    """Which bytes belong to a run (a word, a line), and a code for each byte.

    ``lower`` gives A-Z the codes of a-z, so hashes ignore ASCII case.
    """

    def __init__(self, breaks: bytes, lower: bool = True):
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(breaks)] = False
        codes = mix(np.arange(1, 257, dtype=np.uint64) * _FOLD)
        if lower:
            codes[65:91] = codes[97:123]
        self.codes = codes

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (byte positions) of the runs of all documents, and for
        each document boundary the number of runs before it."""
        n = len(data)
        inside = self.inside[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | cut[:n]))
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each run, the same wherever it stands."""
        n = len(data)
        powers, inverses = _powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.codes[data] * powers[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


@lru_cache(maxsize=2)
def _powers_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        powers = np.full(size, base, dtype=np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, out=powers))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    usual = SLICE_BYTES + (1 << 16)
    return _powers_to(usual) if n < usual else _powers_to.__wrapped__(n + 1)


#: Words: all but the blank and 0x09-0x0D, with A-Z as a-z or as written; or letters, digits and all beyond ASCII.
BLANK_WORDS = Runs(b" \t\n\x0b\x0c\r")
WRITTEN_WORDS = Runs(b" \t\n\x0b\x0c\r", lower=False)
PLAIN_WORDS = Runs(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
LINES = Runs(b"\n", lower=False)


def slices(texts: pa.Array, target: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of its first row, bytes, offsets) of runs of rows that hold about
    ``target`` bytes, one row at least. A null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    n = len(texts)
    if not n:
        return
    _, where, held = texts.buffers()
    offsets = np.frombuffer(where, dtype=width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + target, side="right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flagged positions lie in each document."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def windows(hashes: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of so many runs inside one document, and where they start."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    out = hashes[:n]
    for k in range(1, length):
        out = fold(out, hashes[k : k + n])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(owner[:n] == owner[length - 1 : length - 1 + n])
    return out[at], at


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window that begins at one of ``starts``."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, n), -1)
    return np.cumsum(steps[:-1]) > 0


def seen_in_document(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equals another of its document, equals an earlier one of its document)."""
    keys = fold(hashes, owner.astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    any_other, earlier = np.zeros((2, len(keys)), dtype=bool)
    any_other[order[1:]] |= same
    any_other[order[:-1]] |= same
    earlier[order[1:]] = same
    return any_other, earlier
