"""Whole texts as byte arrays: words, hashes and counts of a batch at once, with numpy inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)
BLANK = np.isin(np.arange(256), (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Texts:
    """Some texts of a batch: ``data`` holds their bytes one after the other, text i from ``offsets[i]`` to ``offsets[i + 1]``."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of every run of bytes that are ``inside`` and in one text."""
        n = len(self.data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate(([False], inside[:-1]))
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate((inside[1:], [False]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def prefix_sums(self, data: np.ndarray) -> np.ndarray:
        """Sums from which ``span_hashes`` takes the polynomial hash of any span."""
        up, _ = _powers(_room(len(data)))
        return np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))


def _room(n: int) -> int:
    return max(SLICE_BYTES, 1 << max(1, n - 1).bit_length())


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal bytes have equal hashes wherever they stand."""
    _, down = _powers(_room(len(sums) - 1))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def slices(column: pa.Array) -> Iterator[Texts]:
    """The texts of a string column in order, null as empty, in slices of bounded size."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        part = offsets[first : last + 1]
        yield Texts(first, data[part[0] : part[-1]], part - part[0])
        first = last


#: What the chains of the two hashes of a word start from and are multiplied by between eight bytes and the next.
_STARTS = mix64(np.array([0x51ED270B, 0x2545F491], dtype=np.uint64) * _BASE)
_STEPS = mix64(np.array([0x9FB21C65, 0xC2B2AE3D], dtype=np.uint64) * _BASE) | np.uint64(1)
_TAILS = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], np.uint64)
#: Longer spans are hashed one by one.
_LONG = 256


def keyed_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """64-bit hashes of spans of ``data``: a chain that mixes eight bytes after the other into the length. ``which``: 0 or 1.

    Unlike a polynomial modulo 2 ** 64 it has no algebra that patterned bytes could meet. A long span has its part of a
    128-bit BLAKE2b instead.
    """
    length = ends - starts
    out = mix64(length.astype(np.uint64) ^ _STARTS[which])
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from every place on
    active = np.flatnonzero(length <= _LONG)
    for at in range(0, _LONG, 8):
        active = active[length[active] > at]
        if not len(active):
            break
        piece = eight[starts[active] + at] & _TAILS[np.minimum(length[active] - at, 8)]
        out[active] = mix64((out[active] ^ piece) * _STEPS[which])
    for i in np.flatnonzero(length > _LONG):
        digest = blake2b(data[starts[i] : ends[i]], digest_size=16).digest()
        out[i] = int.from_bytes(digest[8 * which : 8 * which + 8], "little")
    return out


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, another hash, text) of every word, in order: A-Z lower-cased, runs of other than the six ASCII blanks."""
    data = LOWER[texts.data]
    starts, ends, text = texts.spans(~BLANK[data])
    return keyed_hashes(data, starts, ends, 0), keyed_hashes(data, starts, ends, 1), text
