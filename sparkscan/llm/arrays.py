"""Vectorised text kernels: words, hashes and per-document windows over Arrow buffers.

Every kernel works on whole texts.  A *slab* is a run of documents whose texts
together stay under ``SLAB_BYTES`` (one longer document is a slab of its own), so
memory follows the slab and not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLAB_BYTES = 2 << 20
SPACES = b" \t\n\x0b\x0c\r"
_U = np.uint64
# Odd multipliers of the two word hashes and of the rolling window hashes.
_K = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_ROLL = (0x8EBC6AF09C88C6E3, 0xE7037ED1A0B428DB)


def table(members: bytes | range | list[int], negate: bool = False) -> np.ndarray:
    """Membership of each byte value."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return ~out if negate else out


NOT_SPACE = table(SPACES, negate=True)


def slabs(texts: pa.Array, most: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets) of each slab; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, len(texts))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z lowered; all other bytes as they are."""
    return buf + ((buf - np.uint8(65) < 26).astype(np.uint8) << np.uint8(5))


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of members that do not cross a document's edge."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = member[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = member[1:]
    return np.flatnonzero(member & (~before | edge[:n])), np.flatnonzero(member & (~after | edge[1:])) + 1


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First item of each document among sorted starts, with the total at the end."""
    first = np.searchsorted(starts, offsets)
    first[-1] = len(starts)
    return first


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, most: int = 64) -> np.ndarray:
    """64-bit hash of each span's bytes; ``which`` picks one of two independent functions.

    Spans over ``most`` bytes go through xxhash one by one; use one value for hashes that are compared.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    k1, k2 = (_U(x) for x in _K[which])
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    words = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    length = ends - starts
    h = (length.astype(np.uint64) + _U(1)) * k2

    def step(h, at, left):
        take = words[at]
        short = left < 8
        if short.any():
            keep = (_U(1) << (np.minimum(left, 7).astype(np.uint64) * _U(8))) - _U(1)
            take = np.where(short, take & keep, take)
        h = (h ^ take) * k1
        return h ^ (h >> _U(31))

    h = step(h, starts, length)
    more, long = np.flatnonzero((length > 8) & (length <= most)), np.flatnonzero(length > most)
    done = 8
    while len(more) and done < most:
        h[more] = step(h[more], starts[more] + done, length[more] - done)
        done += 8
        more = more[length[more] > done]
    for i in long:
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), which + 1)
    return finish(h)


def roll(hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of each window of ``width`` consecutive items, by its start; windows may cross documents."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n].copy()
    base = _U(_ROLL[which])
    for j in range(1, width):
        h *= base
        h += hashes[j : j + n]
    return finish(h)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of ``width`` items fits into its document."""
    sizes = np.maximum(np.diff(first) - width + 1, 0)
    total = int(sizes.sum())
    return np.repeat(first[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs starts[i] .. starts[i] + sizes[i], one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values within each document; first as from owners()."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
