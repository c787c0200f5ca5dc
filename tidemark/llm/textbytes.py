"""Vectorised views of text columns inside tasks: words, lines and their 64-bit hashes over UTF-8 bytes.

A block is a run of rows whose texts are joined, each ended by a line feed, so that no word spans two rows.
Memory follows the block (a megabyte, or one text where that is longer), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
SEGMENT = 1 << 18
PRIME = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64

_ALL = np.arange(256)
ASCII_LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
SPACE = np.isin(_ALL, [0x20, *range(0x09, 0x0E)])
NOT_SPACE = ~SPACE
WORD = (_ALL >= 0x80) | ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x41) & (_ALL <= 0x5A)) | ((_ALL >= 0x61) & (_ALL <= 0x7A))
HEAD = (_ALL & 0xC0) != 0x80


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, byte offsets of the rows and the end); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(np.concatenate([[0], pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1]))
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        part = pc.fill_null(texts.slice(lo, hi - lo), "").cast(pa.large_binary())
        joined = pc.binary_join_element_wise(part, pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        joined = joined.combine_chunks() if isinstance(joined, pa.ChunkedArray) else joined
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + hi - lo + 1]
        data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        yield lo, hi, data, offsets - offsets[0]
        lo = hi


def spans(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes for which ``inside`` (by byte value) holds."""
    flag = inside[data].astype(np.int8)
    step = np.diff(flag, prepend=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def per_row(data: np.ndarray, offsets: np.ndarray, *classes: np.ndarray) -> np.ndarray:
    """For each class of byte values, a row of counts by text. Two classes share a pass, in the halves of a word."""
    out = np.zeros((len(classes) + 1 & ~1, len(offsets) - 1), np.int64)
    for i in range(0, len(classes), 2):
        pair = classes[i].astype(np.uint64) | (classes[i + 1].astype(np.uint64) << np.uint64(32) if i + 1 < len(classes) else np.uint64(0))
        for lo in range(0, len(data), SEGMENT):
            hi = min(lo + SEGMENT, len(data))
            a = int(np.searchsorted(offsets, lo, "right")) - 1
            b = int(np.searchsorted(offsets, hi, "left"))
            sums = np.add.reduceat(pair[data[lo:hi]], np.maximum(offsets[a:b] - lo, 0))
            out[i, a:b] += (sums & np.uint64(0xFFFFFFFF)).astype(np.int64)
            out[i + 1, a:b] += (sums >> np.uint64(32)).astype(np.int64)
    return out[: len(classes)]


def pointers(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For spans in order: where the spans of each row begin, and their number at the end."""
    return np.searchsorted(starts, offsets, "left")


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, int, int]:
    inverse = pow(PRIME, -1, 1 << 64)
    up = np.full(SEGMENT, PRIME, np.uint64)
    down = np.full(SEGMENT, inverse, np.uint64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    return up, down, pow(PRIME, SEGMENT, 1 << 64), pow(inverse, SEGMENT, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a polynomial over its bytes by prefix sums, one segment of bytes at a time."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down, up_step, down_step = _powers()
    first, last = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    carry, scale = np.uint64(0), 1
    for lo in range(0, len(data), SEGMENT):
        part = data[lo : lo + SEGMENT].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part, out=total[1:])
        total *= np.uint64(scale)
        total += carry
        for at, into in ((starts, first), (ends, last)):
            a, b = np.searchsorted(at, [lo, lo + len(part)])
            into[a:b] = total[at[a:b] - lo]
            if lo + len(part) == len(data):
                into[b:] = total[-1]
        carry, scale = total[-1], scale * up_step & (1 << 64) - 1
    back = down[starts % SEGMENT]
    rounds = starts // SEGMENT
    if rounds[-1]:
        back = back * np.array([pow(down_step, int(k), 1 << 64) for k in range(int(rounds[-1]) + 1)], np.uint64)[rounds]
    return mix((last - first) * back + (ends - starts).astype(np.uint64))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbours of ``h``; the last k - 1 positions have none."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[i : i + len(out)]
    return mix(out)


def within_rows(ptr: np.ndarray, k: int) -> np.ndarray:
    """Which runs of ``k`` spans lie in one row, for the runs of :func:`rolling`."""
    n = int(ptr[-1])
    ok = np.ones(max(n - k + 1, 0), bool)
    for i in range(1, k):
        cut = ptr[1:-1] - i
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok
